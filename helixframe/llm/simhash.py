"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has 64 bits: bit ``i`` is 1 if more than half of its shingles' XXH64
values (seed 42) have it. Two texts link at ``NEAR`` = 2 or fewer differing bits.

Pivots are fixed reference fingerprints. The pivot table of a fingerprint holds its Hamming
distances to all of them, for the whole and for parts of the 64 bits; it is made once for
each distinct fingerprint and travels with it. By the triangle inequality no coordinate of
two linked fingerprints differs by more than their distance. That is used twice:

1. The bits are cut into four bands. Two differing bits leave two bands untouched, so all
   coordinates of two bands are equal: each fingerprint goes into six buckets, one for each
   choice of two bands, under the coordinates of both.
2. In a bucket, pairs whose largest difference of a whole-length coordinate exceeds 2 are
   discarded; survivors are verified on their fingerprints.

A bucket of more than ``BUCKET`` fingerprints isn't paired: its members agree in two bands, so
the other two are halved into four narrower bands, and the same argument gives six narrower
buckets. After four such rounds 4 bits are left open, 16 fingerprints at most, so no bucket is
ever paired whole above ``BUCKET``, and no link is lost. Equal texts and equal fingerprints
are one row throughout.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components
from .texthash import utf8_buffers

#: Differing bits up to which fingerprints link. The bands are laid out for this number.
NEAR = 2
SEED, SHINGLE = 42, 3
#: Fingerprints of a bucket that are paired directly.
BUCKET = 64
#: Rows of one number up to which a counted table is broadcast, else shuffled.
SMALL_ROWS = 1_000_000
#: Bytes of one text whose words are held at a time.
PIECE = 1 << 20

#: Reference fingerprints: multiples of an odd constant, mixed; any fixed set does.
PIVOTS = 12
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def pivots(n: int = PIVOTS) -> list[int]:
    """``n`` reference fingerprints, as signed longs."""
    out = []
    for i in range(n):
        x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        x ^= x >> 31
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


# fingerprints -----------------------------------------------------------------------------
def _word_pieces(text: bytes):
    """Lists of words of the text in order, cut between words after about PIECE bytes."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes) -> int:
    """Fingerprint of a text in UTF-8, unsigned; 0 for a text without words."""
    digest = xxhash.xxh64_intdigest
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in _word_pieces(text):
        words = carry + words
        if len(words) >= SHINGLE:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            h = [digest(line[a:b], SEED) for a, b in zip((end - size)[:1 - SHINGLE].tolist(), end[SHINGLE - 1:].tolist())]
            octets = np.array(h, np.uint64).view(np.uint8).reshape(-1, 8)
            ones += np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
            total += len(h)
        carry = words[1 - SHINGLE:]
    if not total and carry:
        return digest(b" ".join(carry), SEED)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def _fingerprints(batches):
    for b in batches:
        data, ends = utf8_buffers(b.column(1))
        got = np.array([fingerprint(data[x:y].tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


# pivot tables -------------------------------------------------------------------------------
def distances(fp: Column, refs: list[int]) -> list[Column]:
    """Whole-length distances to the references, seven to a long, eight bits each."""
    one = [F.bit_count(fp.bitwiseXOR(F.lit(r).cast("long"))).cast("long") for r in refs]
    return [reduce(add, [F.shiftleft(d, 8 * i) for i, d in enumerate(one[at:at + 7])]) for at in range(0, len(one), 7)]


def band_distances(fp: Column, at: Column, width: int, refs: list[int]) -> Column:
    """Distances to the references inside the band of ``width`` bits from bit ``at``, five bits each."""
    mask = F.call_function("shiftleft", F.lit((1 << width) - 1).cast("long"), at)
    one = [F.bit_count(fp.bitwiseXOR(F.lit(r).cast("long")).bitwiseAND(mask)).cast("long") for r in refs]
    return reduce(add, [F.shiftleft(d, 5 * i) for i, d in enumerate(one)])


def within(a: Column, b: Column) -> Column:
    """Whether no eight-bit coordinate of two packed tables differs by more than NEAR = 2.

    Coordinates are 0 to 64, seven to a long, so sums stay positive. a - b + 66 lies in 64 to 68 exactly where they are close: no
    field borrows from its neighbour, bits 3 to 7 tell 64 to 71, and adding 3 to the low
    bits tells 69 and more.
    """
    each = lambda x: F.lit(int.from_bytes(bytes([x]) * 7, "big")).cast("long")
    t = a + each(66) - b
    top = t.bitwiseAND(each(0xF8)) == each(0x40)
    return top & ((t.bitwiseAND(each(7)) + each(3)).bitwiseAND(each(8)) == 0)


def _halved(rows: DataFrame, width: int, refs: list[int]) -> DataFrame:
    """Buckets of ``rows`` (key, o1, o2: open bits from o1 and from o2, ``width`` each), six a row.

    Both open ranges are halved; of the four bands two agree (their coordinates join the
    key) and two stay open.
    """
    half = width // 2
    starts = [F.col("o1"), F.col("o1") + half, F.col("o2"), F.col("o2") + half]
    tabled = rows.withColumns({f"b{i}": band_distances(F.col("fp"), s, half, refs) for i, s in enumerate(starts)})
    choices = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    options = []
    for n, (i, j) in enumerate(choices):
        k, m = (x for x in range(4) if x not in (i, j))
        options.append(F.struct(F.xxhash64("key", F.lit(n), f"b{i}", f"b{j}").alias("key"), starts[k].alias("o1"), starts[m].alias("o2")))
    table = [c for c in rows.columns if c.startswith("d")]
    return tabled.select("fp", *table, F.explode(F.array(*options)).alias("o")).select("fp", *table, "o.key", "o.o1", "o.o2")


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, of all linked fingerprints that share a bucket."""
    table = [c for c in rows.columns if c.startswith("d")]
    side = lambda s: rows.select("key", F.col("fp").alias(s), *[F.col(c).alias(s + c) for c in table])
    close = reduce(lambda x, y: x & y, [within(F.col("a" + c), F.col("b" + c)) for c in table])
    met = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & close)
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR).select("a", "b")


def links(fps: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: every two of the distinct fingerprints ``fp`` at NEAR or fewer bits."""
    refs = pivots()
    table = {f"d{i}": c for i, c in enumerate(distances(F.col("fp"), refs))}
    rows = fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("o1"), F.lit(32).alias("o2")).withColumns(table)
    found, width = None, 32
    while True:
        rows = _halved(rows, width, refs)
        width //= 2
        crowded = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"), "crowded")
        n = crowded.count()
        keys = F.broadcast(crowded) if n <= SMALL_ROWS else crowded
        # two open bands of one bit hold four fingerprints
        done = n == 0 or width == 1
        mine = _pairs(rows if done else rows.join(keys, "key", "left_anti"))
        found = mine if found is None else found.unionAll(mine)
        if done:
            return found.distinct()
        rows = scratch.save(rows.join(keys, "key", "left_semi"), "split")


def component_ids(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable by
    links. A null, empty or blank text has fingerprint 0, which links like any other.
    Repeated rows and rows of one doc_id keep one result row each; a null doc_id is never
    the smallest, and a component of null doc_ids only has a null component_id. Texts of any
    length are read whole, a mebibyte of words at a time. Other columns are left out, whatever
    their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs), "fingerprints")
    kinds = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    edges = scratch.save(links(kinds.select("fp"), scratch, bucket), "links")
    comps = components(edges, scratch)
    rooted = kinds.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "named")
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

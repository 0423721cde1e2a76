"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their 5-word shingle sets is at least
0.75 (``num / den``). With ``o = ceil(num / den * n)`` the least overlap that a set of
``n`` needs with any partner, and all sets sorted in one global order, partners share at
least ``l`` tokens among the first ``n - o + l`` of each. A document may pick its own
``l``: a pair then shares at least the smaller of its two ``l``.

1. Every text becomes its set; equal sets form one class (64-bit key of the set).
2. Token support: each class sends the prefix for ``l = 15 % of n`` in hash order, packed
   in blocks, to token buckets. A class of which fewer than ``l`` of these tokens occur in
   another class has no partner and leaves. A token met twice inside a block is counted
   there and sent on once, so a very common token puts one entry a block into its bucket.
3. The classes left get exact token frequencies (of classes left) and are sorted by them.
   Each takes the ``l`` with the lowest estimated cost, scanned postings plus candidates
   that remain to be verified.
4. Leader rounds: in each posting list and size class one class leads, first the one whose
   tokens are the most frequent (the likely origin of a group of copies), later a random
   one; each class is verified against the leader it shares most prefix tokens with, and
   found links are merged to components.
5. The rest: pairs of classes of different components that meet in a posting list, of
   fitting sizes and with the smaller of both ``l`` shared prefix tokens, are verified. A
   parity sketch of 512 bits bounds their overlap from above, so near misses in a large
   group of copies end inside the join. The first token that a pair shares lies in both
   prefixes for ``l = 1``, so only these meet, and a pair is given where none of the
   ``BEFORE`` tokens ahead on either side is shared as well: at its first token always,
   at a later one hardly ever, however many it shares. The shared tokens are counted on
   the two prefixes afterwards. Pairs inside a component need no test: they can't change it.

No link is lost: steps 4 and 5 leave out only pairs that already lie in one component.
A class key collides with probability n^2 / 2^65 over n classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components
from .texthash import mix, set_key, shingle_sets

#: Share of a set by which the prefix of the support step is lengthened (its ``l``).
SUPPORT_SHARE = 0.15
#: Tokens of a packed block, and tokens that a bucket of the support step gets about.
BLOCK_TOKENS = 1 << 19
BUCKET_TOKENS = 1_500_000
#: Numbers of shared prefix tokens from which each document picks.
CHOICES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Prefix tokens ahead of a posting that are compared to tell whether its pair was met before.
BEFORE = 6
#: Leader rounds at most; the exact step follows in any case. The first HUB_ROUNDS of them
#: take hubs for leaders.
LEADER_ROUNDS, HUB_ROUNDS = 4, 2
#: Rows of two or three numbers up to which a counted table is broadcast, else shuffled.
SMALL_ROWS = 1_000_000


def _need(n, num, den):
    """Least overlap of a set of n with any partner."""
    return (n * num + den - 1) // den


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _signatures(k):
    def run(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            n, key = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, h in shingle_sets(text, k):
                n[i], key[i] = len(h), set_key(h)
            rest = [b.column(i) for i, f in enumerate(b.schema) if f.name != "text"]
            names = [f.name for f in b.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n), pa.array(key)], names=[*names, "n", "ck"])

    return run


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, th, n, ck) of every row: hash of the text, set size and class key."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signatures(k), "doc_id long, th long, n long, ck long")


def _pack(k, num, den, buckets):
    """Blocks of prefix tokens by bucket: tokens, owners and tokens an owner; also support counted here."""

    def flush(owners, prefixes):
        lens = np.array([len(p) for p in prefixes], np.int64)
        tok = np.concatenate(prefixes)
        own = np.repeat(np.array(owners, np.int64), lens)
        bucket = ((tok & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((tok, bucket))
        tok, own, bucket = tok[order], own[order], bucket[order]
        new = np.ones(len(tok), bool)
        new[1:] = tok[1:] != tok[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(tok)))
        many = count > 1
        # counted here: tokens that two or more classes of this block have
        here, c = np.unique(own[np.repeat(many, count)], return_counts=True)
        small = (tok[start] >> np.uint64(32)).astype(np.uint32)
        single = own[start]
        single[many] = 0
        edge = np.searchsorted(bucket[start], np.arange(buckets + 1))
        out = {"bucket": [], "tok": [], "own": [], "many": []}
        for i in range(buckets):
            a, b = edge[i], edge[i + 1]
            if b > a:
                o = np.argsort(single[a:b], kind="stable")
                own_i = single[a:b][o]
                head = np.ones(b - a, bool)
                head[1:] = own_i[1:] != own_i[:-1]
                at = np.flatnonzero(head)
                out["bucket"].append(i)
                out["tok"].append(small[a:b][o].tobytes())
                out["own"].append(own_i[at].tobytes() + np.diff(np.append(at, b - a)).astype(np.uint32).tobytes())
                out["many"].append(np.packbits(many[a:b][o]).tobytes())
        yield _packed_batch(out)
        if len(here):
            yield _packed_batch({"bucket": [-1], "tok": [c.astype(np.uint32).tobytes()], "own": [here.tobytes()], "many": [b""]})

    def run(batches):
        owners, prefixes, held, seen = [], [], 0, set()
        for b in batches:
            for _, h in shingle_sets(b.column(0), k):
                n = len(h)
                if not n or (key := set_key(h)) in seen:
                    continue
                if len(seen) < 500_000:  # copies beyond are merely sent again
                    seen.add(key)
                ell = max(1, int(np.ceil(SUPPORT_SHARE * n)))
                p = h[:n - _need(n, num, den) + ell]
                owners.append(key)
                prefixes.append(p)
                held += len(p)
                if held >= BLOCK_TOKENS:
                    yield from flush(owners, prefixes)
                    owners, prefixes, held = [], [], 0
        if owners:
            yield from flush(owners, prefixes)

    return run


def _packed_batch(out):
    return pa.RecordBatch.from_arrays(
        [pa.array(out["bucket"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("tok", "own", "many"))],
        names=["bucket", "tok", "own", "many"],
    )


def _support(parts: int):
    """Of one bucket: for each class, how many of its tokens another class has as well.

    Rows of bucket -1 hold such counts ready made. The counts leave in packed blocks by
    class.
    """
    def run(t: pa.Table) -> pa.Table:
        return _bucket_counts(t, parts)

    return run


def _total(t: pa.Table) -> pa.Table:
    """Adds up the packed counts of one part of the classes."""
    key = np.concatenate([np.frombuffer(x, np.int64) for x in t["key"].to_pylist()])
    cnt = np.concatenate([np.frombuffer(x, np.uint32) for x in t["cnt"].to_pylist()])
    key, inv = np.unique(key, return_inverse=True)
    return pa.table({"ck": pa.array(key), "cnt": pa.array(np.bincount(inv, cnt, len(key)).astype(np.int64))})


def _bucket_counts(t: pa.Table, parts: int) -> pa.Table:
    tok, own, many, ready, counts = [], [], [], [], []
    for a, b, c, k in zip(t["tok"].to_pylist(), t["own"].to_pylist(), t["many"].to_pylist(), t["bucket"].to_pylist()):
        x = np.frombuffer(a, np.uint32)
        if k < 0:
            ready.append(np.frombuffer(b, np.int64))
            counts.append(x.astype(np.int64))
            continue
        m = len(b) // 12
        tok.append(x)
        own.append(np.repeat(np.frombuffer(b, np.int64, m), np.frombuffer(b, np.uint32, m, 8 * m)))
        many.append(np.unpackbits(np.frombuffer(c, np.uint8), count=len(x)).astype(bool))
    if tok:
        ready_key, ready_count = _shared_tokens(*map(np.concatenate, (tok, own, many)))
        ready.append(ready_key)
        counts.append(ready_count)
    if not sum(map(len, ready)):
        return pa.table({"part": pa.array([], pa.int32()), "key": pa.array([], pa.binary()), "cnt": pa.array([], pa.binary())})
    key, cnt = np.concatenate(ready), np.concatenate(counts)
    part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    key, cnt, part = key[order], cnt[order], part[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    cuts = list(zip(at.tolist(), np.append(at[1:], len(part)).tolist()))
    return pa.table({
        "part": pa.array(part[at], pa.int32()),
        "key": pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary()),
        "cnt": pa.array([cnt[a:b].astype(np.uint32).tobytes() for a, b in cuts], pa.binary()),
    })


def _shared_tokens(tok, own, many):
    order = np.argsort(tok, kind="stable")
    tok, own, many = tok[order], own[order], many[order]
    new = np.ones(len(tok), bool)
    new[1:] = tok[1:] != tok[:-1]
    start = np.flatnonzero(new)
    lo, hi = np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)
    shared = (lo != hi) | np.logical_or.reduceat(many, start)
    use = np.repeat(shared, np.diff(np.append(start, len(tok)))) & ~many
    tok, own = tok[use], own[use]
    if len(tok):  # a class counts a token once, however often its copies sent it
        order = np.lexsort((tok, own))
        tok, own = tok[order], own[order]
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
        own = own[keep]
    return np.unique(own, return_counts=True)


#: 64-bit words of a class's parity sketch.
WORDS = 8
_SKETCH = [f"w{i}" for i in range(WORDS)]


def _sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes at each bit. Two sets differ in as many elements at
    least as their sketches differ in bits."""
    odd = np.bincount((mix(h) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(k):
    def run(batches):
        for b in batches:
            keys, sizes, flat, ends, bits = [], [], [], [0], []
            for _, h in shingle_sets(b.column(0), k):
                if len(h):
                    keys.append(set_key(h))
                    sizes.append(len(h))
                    bits.append(_sketch(h))
                    flat.append(h.view(np.int64))
                    ends.append(ends[-1] + len(h))
                if ends[-1] > BLOCK_TOKENS:
                    yield _set_batch(keys, sizes, flat, ends, bits)
                    keys, sizes, flat, ends, bits = [], [], [], [0], []
            if keys:
                yield _set_batch(keys, sizes, flat, ends, bits)

    return run


def _set_batch(keys, sizes, flat, ends, bits):
    toks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
    words = [pa.array(np.ascontiguousarray(w)) for w in np.array(bits).T]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), toks, *words], names=["ck", "n", "toks", *_SKETCH])


def _choose(num, den):
    """Sorts a class's shared tokens by frequency and gives the prefix of the cheapest l.

    ``first`` of the prefix's tokens make the prefix for l = 1.
    """

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            df = flat.field(0).to_numpy(zero_copy_only=False)
            tok = flat.field(1).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            out, toks, ends = {c: [] for c in ("ck", "n", "ell", "hub", "first")}, [], [0]
            for i, (key, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                d, t = df[at[i]:at[i + 1]], tok[at[i]:at[i + 1]]
                need = int(_need(n, num, den))
                if len(d) < need:
                    continue  # too few tokens that anyone else has
                order = np.lexsort((t, d))
                scan = np.cumsum(d[order] - 1)
                best, cost, size = 1, None, 0
                for ell in CHOICES:
                    if ell > need:
                        break
                    r = len(d) - need + ell
                    c = scan[r - 1] * (1.0 + n / (8.0 * ell))
                    if cost is None or c < cost:
                        best, cost, size = ell, c, r
                for c, v in zip(out, (key, n, best, int(d.sum() // n), size - best + 1)):
                    out[c].append(v)
                toks.append(t[order[:size]])
                ends.append(ends[-1] + size)
            if toks:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                arrays = [pa.array(v, kind) for v, kind in zip(out.values(), kinds)]
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(toks)))
                yield pa.RecordBatch.from_arrays([*arrays, prefix], names=[*out, "prefix"])

    return run


_PREFIX = "ck long, n long, ell int, hub long, first int, prefix array<long>"


def _verify(pairs: DataFrame, tested: int, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those with enough overlap. Sets that no pair needs aren't moved."""
    left = sets.select(F.col("ck").alias("a"), F.col("toks").alias("ta"), F.col("n").alias("na"))
    right = sets.select(F.col("ck").alias("b"), F.col("toks").alias("tb"), F.col("n").alias("nb"))
    right = right.join(_small(pairs.select("b").distinct(), tested), "b", "left_semi")
    x = F.size(F.array_intersect("ta", "tb"))
    both = left.join(_small(pairs.select("a", "b"), tested), "a").join(right, "b").withColumn("x", x)
    return both.where(F.col("x") * den >= (F.col("na") + F.col("nb") - F.col("x")) * num).select("a", "b")


def _fits(num, den):
    """Size condition on columns n and m."""
    return (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)


def classes(docs: DataFrame, num: int = 75, den: int = 100, k: int = 5, scratch: Scratch | None = None):
    """(rows, comps): signatures of all rows, and (ck, root) of classes that have a link."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    rows = scratch.save(signatures(docs, k), "signatures")
    total = rows.agg(F.sum("n"), F.count(F.lit(1))).first()
    prefix = (total[0] or 0) * (1 - num / den + SUPPORT_SHARE)
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(width, -(-int(prefix) // BUCKET_TOKENS))

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _pack(k, num, den, buckets), "bucket int, tok binary, own binary, many binary"
    )
    # one pass over the texts makes both the blocks and the support counted inside them
    deal = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("own"), F.lit(buckets)).cast("int"))
    counted = packed.withColumn("slot", deal).groupBy("slot").applyInArrow(_support(width), "part int, key binary, cnt binary")
    counted = counted.groupBy("part").applyInArrow(_total, "ck long, cnt long")
    cls = rows.where("n > 0").groupBy("ck").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "th")).alias("pick"))
    least = F.greatest(F.lit(1), F.ceil(F.lit(SUPPORT_SHARE) * F.col("n")))
    left = scratch.save(
        counted.join(cls, "ck").where(F.col("cnt") >= least).select("ck", F.col("pick.doc_id").alias("id"), F.col("pick.th").alias("th")),
        "supported",
    )
    # texts of one row a class; rows that only share the identifier leave by the key below
    named = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    ids = _small(left.select(F.col("id").alias("doc_id"), "th").distinct(), left.count())
    near = named.join(ids, named["doc_id"].eqNullSafe(ids["doc_id"]) & (named["th"] == ids["th"]), "left_semi")
    sets = near.select("text").mapInArrow(_sets(k), "ck long, n long, toks array<long>, " + ", ".join(f"{w} long" for w in _SKETCH))
    # repeated rows of one text give the same set
    sets = scratch.save(sets.dropDuplicates(["ck"]), "sets")

    tok = sets.select("ck", "n", F.explode("toks").alias("t"))
    freq = tok.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = tok.join(freq, "t").groupBy("ck").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "t")).alias("l"))
    post = scratch.save(lists.mapInArrow(_choose(num, den), _PREFIX), "prefixes")

    comps = None
    for turn in range(LEADER_ROUNDS):
        pairs, tested = _lead(post, comps, turn, num, den, scratch)
        links = 0
        if tested:
            comps, links = _merge(comps, _verify(pairs, tested, sets, num, den), scratch)
        if turn + 1 >= HUB_ROUNDS and links * 10 < tested or not tested:
            break
    met = scratch.save(_rest(_live(post, comps), sets, num, den), "met")
    pairs = scratch.save(_enough(met, met.count(), post), "rest")
    if tested := pairs.count():
        comps, _ = _merge(comps, _verify(pairs, tested, sets, num, den), scratch)
    if comps is None:
        return rows, spark.createDataFrame([], "node long, root long")
    return rows, comps[0]


def _live(post: DataFrame, comps) -> DataFrame:
    """Prefixes with the component of each class."""
    if comps is None:
        return post.withColumn("comp", F.col("ck"))
    table, size = comps
    live = post.join(_small(table, size), post["ck"] == table["node"], "left")
    return live.withColumn("comp", F.coalesce("root", "ck")).drop("node", "root")


def _merge(comps, found: DataFrame, scratch: Scratch):
    """Components (table, rows) with the new links, and the number of these."""
    found = scratch.save(found, "links")
    links = found.count()
    if links:
        edges = found
        if comps is not None:
            edges = found.unionAll(comps[0].select(F.col("node").alias("a"), F.col("root").alias("b")))
        table = scratch.save(components(edges, scratch), "components")
        comps = (table, table.count())
    return comps, links


def _lead(post, comps, turn, num, den, scratch):
    """Pairs of each class and the leader of another component that it meets most often.

    Size classes are powers of den / num, shifted by half a class in every other round.
    """
    size = F.floor(F.log("n") / F.log(F.lit(den / num)) + 0.5 * (turn % 2)).cast("int")
    live = _live(post, comps).select("ck", "n", F.explode("prefix").alias("t"), "comp", "hub", size.alias("s"))
    first = -F.col("hub") if turn < HUB_ROUNDS else F.xxhash64("ck", F.lit(turn))
    lead = F.min(F.struct(first.alias("r"), "ck", "n", "comp")).alias("lead")
    heads = live.groupBy("t", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), lead).where("lo <> hi").select("t", "s", "lead")
    led = live.join(heads, ["t", "s"]).select(
        "ck", "n", "comp", F.col("lead.ck").alias("lead"), F.col("lead.n").alias("m"), F.col("lead.comp").alias("to")
    )
    hits = led.where((F.col("comp") != F.col("to")) & _fits(num, den)).groupBy("ck", "lead").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy(F.col("ck").alias("a")).agg(F.max_by("lead", F.struct("hits", "lead")).alias("b"))
    pairs = scratch.save(best, "led")
    return pairs, pairs.count()


def _rest(live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes of different components that share a token of their prefixes for
    l = 1, and whose sketches don't rule the overlap out."""
    ahead = lambda p: F.transform(p, lambda t, i: F.struct(t.alias("t"), F.slice(p, F.greatest(i - (BEFORE - 1), F.lit(1)), F.least(i, F.lit(BEFORE))).alias("ahead")))
    post = live.select("ck", "n", "comp", F.slice("prefix", F.lit(1), F.col("first")).alias("p")).select("ck", "n", "comp", F.inline(ahead(F.col("p"))))
    open_ = post.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t")
    mine = post.join(open_, "t").join(sets.select("ck", *_SKETCH), "ck")
    names = {"ck": "b", "n": "m", "comp": "comp2", "ahead": "ahead2", **{w: f"v{w}" for w in _SKETCH}}
    other = mine.select("t", *[F.col(c).alias(v) for c, v in names.items()])
    apart = F.lit(0)
    for w in _SKETCH:
        apart = apart + F.bit_count(F.col(w).bitwiseXOR(F.col(f"v{w}")))
    both = F.col("n") + F.col("m")
    may = (both - apart) * (num + den) >= both * (2 * num)
    once = ~F.arrays_overlap("ahead", "ahead2")
    met = mine.withColumnRenamed("ck", "a").join(other, (mine["t"] == other["t"]) & (F.col("comp") < F.col("comp2")) & _fits(num, den) & may & once)
    return met.select("a", "b").distinct()


def _enough(pairs: DataFrame, met: int, post: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that share the smaller of both l among their prefixes."""
    left = post.select(F.col("ck").alias("a"), F.col("ell").alias("la"), F.col("prefix").alias("pa"))
    right = post.select(F.col("ck").alias("b"), F.col("ell").alias("lb"), F.col("prefix").alias("pb"))
    right = right.join(_small(pairs.select("b").distinct(), met), "b", "left_semi")
    both = left.join(_small(pairs, met), "a").join(right, "b")
    return both.where(F.size(F.array_intersect("pa", "pb")) >= F.least("la", "lb")).select("a", "b")


def _rooted(docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """component_ids with the root of each row's component: a class key, null without shingles."""
    rows, comps = classes(docs, num, den, k)
    cls = rows.where("n > 0").groupBy("ck").agg(F.min("doc_id").alias("first"))
    label = cls.join(comps, cls["ck"] == comps["node"], "left").select("ck", "first", F.coalesce("root", "ck").alias("root"))
    least = label.groupBy("root").agg(F.min("first").alias("component_id"))
    label = label.join(least, "root").select("ck", "component_id", "root")
    linked = rows.where("n > 0").join(label, "ck").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "root")
    return linked.unionAll(rows.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def component_ids(docs: DataFrame, num: int = 75, den: int = 100, k: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, th, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, the row's own included. Null
    or blank texts have no shingles, link with nothing and keep their own doc_id. Null
    doc_ids take part and are passed over when the smallest is chosen; repeated doc_ids
    are told apart by their texts. Other columns of ``docs`` are not looked at.
    """
    return _rooted(docs, num, den, k).drop("root")


def keep_first(docs: DataFrame, num: int = 75, den: int = 100, k: int = 5) -> DataFrame:
    """Rows of ``docs`` without near copies: of each group the one with the smallest doc_id stays.

    Groups are told apart by their root, since a repeated doc_id may be the smallest of
    several and null ones of none. A null doc_id stays only where its group has no other.
    All columns pass through. Rows without words stay. Of rows that agree in doc_id and
    text one stays.
    """
    scratch = Scratch(docs.sparkSession, "first")
    rows = scratch.save(_rooted(docs, num, den, k), "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    best = rows.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
    best = best.where("size > 1").select("root", "best")
    tagged = rows.where("n_shingles > 0").select("root", order.alias("own"), "doc_id", "th")
    drop = scratch.save(tagged.join(best, "root").where("own <> best").select(F.col("doc_id").alias("__hf_id"), F.col("th").alias("__hf_th")).distinct(), "drop")
    again = rows.where("n_shingles > 0").groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("__hf_id"), F.col("th").alias("__hf_th"))
    again = scratch.save(again, "again")
    n_drop, n_again = drop.count(), again.count()
    drop, again = _small(drop, n_drop), _small(again, n_again)
    tagged = docs.withColumn("__hf_h", F.xxhash64("text"))
    same = lambda side: tagged["doc_id"].eqNullSafe(side["__hf_id"]) & (tagged["__hf_h"] == side["__hf_th"])
    kept = tagged.join(drop, same(drop), "left_anti")
    if n_again:
        single = kept.join(again, kept["doc_id"].eqNullSafe(again["__hf_id"]) & (kept["__hf_h"] == again["__hf_th"]), "left_anti")
        twice = kept.join(again, kept["doc_id"].eqNullSafe(again["__hf_id"]) & (kept["__hf_h"] == again["__hf_th"]), "left_semi")
        kept = single.unionAll(twice.dropDuplicates(["doc_id", "__hf_h"]))
    return kept.drop("__hf_h")

"""Read tables made from the driver's documents: whole texts, cut into reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import balanced
from ..operators.tallies import READS

#: Letters of a read, and the factor that leaves room for a document's reads in read_id.
READ_LENGTH, ROOM = 96, 1 << 20

# What each letter stands for; J, Q and X stay ambiguous.
LETTERS, STANDS_FOR = "ABCDEFGHIKLMNOPRSTUVWYZ", "ACGTACGTACGTACGTACGTACG"

#: Bytes of texts that are cut at a time.
TOGETHER = 1 << 20

_BASE = np.zeros(256, np.uint8)  # 0: no letter
for _c in map(chr, range(ord("A"), ord("Z") + 1)):
    _BASE[ord(_c)] = _BASE[ord(_c.lower())] = ord(dict(zip(LETTERS, STANDS_FOR)).get(_c, "N"))
# The quality at i (from 1) is 33 + (13 i + 7 read_id) mod 41, a row for each remainder of read_id
_QUALS = (33 + (np.arange(1, READ_LENGTH + 1) * 13 + np.arange(41)[:, None] * 7) % 41).astype(np.uint8)


def _cut(first: pa.Array, texts: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """Reads of texts with ``n`` bytes each; ``first``: the read_id of each one's first read."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    # every byte of a character beyond ASCII is above 127, so bytes tell letters
    bases = _BASE[(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0]:ends[-1]]]
    letter = bases > 0
    bases = bases[letter]
    before = np.zeros(len(letter) + 1, np.int64)
    np.cumsum(letter, out=before[1:])
    last = np.cumsum(n)
    size = before[last] - before[last - n]
    parts = -(-size // READ_LENGTH)
    of = np.repeat(np.arange(len(n)), parts)
    part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    # the reads of a text follow each other in its letters
    at = np.append((np.cumsum(size) - size)[of] + part * READ_LENGTH, len(bases)).astype(np.int32)
    unknown = first.is_null().to_numpy(zero_copy_only=False)[of]
    ids = first.fill_null(0).to_numpy()[of] + part
    marks = _QUALS[ids % 41][np.arange(READ_LENGTH) < np.diff(at)[:, None]]
    text = lambda x: pa.StringArray.from_buffers(len(of), pa.py_buffer(at), pa.py_buffer(x))
    quals = text(marks)
    if unknown.any():
        quals = pc.if_else(pa.array(unknown), pa.scalar(None, pa.string()), quals)
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=unknown), text(bases), quals], names=["read_id", "bases", "quals"])


def cut(batches):
    """Batches of reads of those of texts."""
    for b in batches:
        first, texts = b.column(0), b.column(1).fill_null("").cast(pa.binary())
        n = pc.binary_length(texts).to_numpy().astype(np.int64)
        # texts up to TOGETHER bytes at a time, a longer one by itself
        for i in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // TOGETHER)) + 1):
            if len(i):
                yield _cut(first.slice(i[0], len(i)), texts.slice(i[0], len(i)), n[i])


def uncut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first, text) of each document: what ``cut`` makes reads of."""
    docs = balanced(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    return docs.select((F.col("doc_id") * ROOM).cast("long").alias("first"), "text")


def derived_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, bases, quals): each document's letters as bases, in reads of READ_LENGTH.

    Letters of many texts become bases as one array; null texts have no reads, and reads of null ids no qualities.
    """
    return uncut(spark, sf_dir).mapInArrow(cut, READS)

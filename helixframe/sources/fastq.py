"""FASTQ files read in byte ranges: one scan, each record by the task in whose range it begins.

A task that starts inside a file doesn't know which of a record's four lines it sees first. It
goes to the next line and looks ahead: the first of four lines that begins with ``@``, with a
line that begins with ``+`` two below and equal lengths of the lines after both, is a header. A
quality line may begin with ``@`` too, but two lines below it stand the next record's bases,
which never begin with ``+``. The task then reads on to the end of the last record that begins in
its range, wherever that ends. No line is moved between tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .sequences import READS, file_sizes
from .tables import open_file

#: Bytes that are fetched at a time, and past the end of a range.
BLOCK, PAST = 4 << 20, 64 << 10
_ID = re.compile(rb"@?(\d{1,18})")


class Malformed(ValueError):
    """A file that isn't a sequence of four-line records."""


class _Lines:
    """Lines of a file from a byte on, with the byte at which each begins."""

    def __init__(self, file, start: int, end: int, path: str, block: int):
        self.file, self.path, self.end, self.block = file, path, end, block
        self.at = start  # byte of the first one of the lines not yet taken
        self.rest, self.eof = b"", False
        file.seek(start)

    def fetch(self) -> None:
        want = min(self.block, max(self.end - self.at - len(self.rest), min(PAST, self.block)))
        got = self.file.read(want)
        self.eof = not got
        self.rest += got

    def skip_line(self) -> None:
        """Past the next line feed."""
        while (i := self.rest.find(b"\n")) < 0 and not self.eof:
            self.at += len(self.rest)
            self.rest = b""
            self.fetch()
        n = i + 1 if i >= 0 else len(self.rest)
        self.at, self.rest = self.at + n, self.rest[n:]

    def take(self, least: int) -> tuple[list[bytes], list[int]]:
        """Whole lines, ``least`` at least unless the file ends, and where they begin."""
        while self.rest.count(b"\n") < least and not self.eof:
            self.fetch()
        cut = len(self.rest) if self.eof else self.rest.rfind(b"\n") + 1
        lines = self.rest[:cut].split(b"\n")
        if not lines[-1]:
            lines.pop()  # nothing after the last line feed
        starts, at = [], self.at
        for x in lines:
            starts.append(at)
            at += len(x) + 1
        self.at, self.rest = self.at + cut, self.rest[cut:]
        return lines, starts


def first_header(lines: list[bytes]) -> int | None:
    """Which of these lines is the first header; None if none of them is known to be one."""
    lines = [x.strip() for x in lines]
    for j in range(len(lines) - 3):
        if lines[j][:1] == b"@" and lines[j + 2][:1] == b"+" and len(lines[j + 1]) == len(lines[j + 3]):
            return j
    return None


def _aligned(lines: _Lines, start: int) -> tuple[list[bytes], list[int]]:
    """Lines from the first header on that begins at ``start`` or later."""
    if not start:
        return lines.take(4)
    lines.skip_line()
    got, starts = lines.take(7)
    blank = 0
    while blank < len(got) and not got[blank].strip():
        blank += 1
    # four phases: a header is among four lines that are followed by three more
    j = first_header(got[blank:blank + 7])
    if j is None:
        # fewer than four lines left: the end of a record that begins before
        if lines.eof and len([x for x in got if x.strip()]) < 4:
            return [], []
        if lines.eof or len(got) - blank >= 7:
            raise Malformed(f"{lines.path}: no record after byte {start}")
        more, far = lines.take(14)
        got, starts = got + more, starts + far
        j = first_header(got[blank:blank + 7])
        if j is None:
            raise Malformed(f"{lines.path}: no record after byte {start}")
    return got[blank + j:], starts[blank + j:]


def _columns(records: list[tuple[bytes, ...]]) -> pa.RecordBatch:
    ids = [int(m[1]) if (m := _ID.match(r[0])) else None for r in records]
    text = lambda i: pa.array([r[i].decode("utf-8", "replace") for r in records], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), text(1), text(3)], names=["read_id", "bases", "quals"])


def read_range(file, path: str, start: int, end: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Records whose header begins in [start, end) of an open binary file."""
    # the line that begins at ``start`` is told by the line feed before it
    lines = _Lines(file, max(0, start - 1), end, path, block)
    got, starts = _aligned(lines, start)
    while got:
        whole = len(got) // 4 * 4
        records = []
        for i in range(0, whole, 4):
            if starts[i] >= end:
                break
            r = tuple(x.strip() for x in got[i:i + 4])
            if not any(r):
                continue  # empty lines at the end of a file
            if not all(r):
                raise Malformed(f"{path}: blank line in the record at byte {starts[i]}")
            if r[2][:1] != b"+":
                raise Malformed(f"{path}: no + line in the record at byte {starts[i]}")
            records.append(r)
        if records:
            yield _columns(records)
        left, after = got[whole:], starts[whole:]
        if lines.eof:
            if any(x.strip() for x in left) and after[0] < end:
                raise Malformed(f"{path}: the record at byte {after[0]} is cut off")
            return
        if (starts[whole] if left else lines.at) >= end:
            return
        more, far = lines.take(4)
        got, starts = left + more, after + far


class FastqRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.split = int(options["splitbytes"])

    def partitions(self) -> list[FastqRange]:
        return [FastqRange(path, at, min(size, at + self.split)) for path, size in self.files for at in range(0, size, self.split)]

    def read(self, partition: FastqRange) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            yield from read_range(f, partition.path, partition.start, partition.end)


class FastqSource(DataSource):
    """Format ``fastq``; options files (JSON list of path and length) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def _bytes(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", text.lower())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) << 10 * " kmgt".index(m[2] or " ")


def read_fastq_splits(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(read_id, bases, quals) of all files of a path, as ``sequences.read_fastq`` gives them with ``strict``.

    Ranges hold ``split_bytes`` bytes, by default those of Spark's own file readers. A record with an empty line, without its ``+``
    line or cut off at the end is an error; empty lines at the end of a file are passed over. Names and
    lengths of files are listed by Spark, contents are read by the tasks, so folders and
    patterns work. Bases must not begin with ``+``.
    """
    spark.dataSource.register(FastqSource)
    size = split_bytes or _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    files = [[r.path, r.length] for r in file_sizes(spark, path).orderBy("path").collect()]
    return spark.read.format("fastq").option("files", json.dumps(files)).option("splitBytes", size).load()

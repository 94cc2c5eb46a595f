"""FASTQ files as relations: records found inside byte ranges of a file.

A record begins at a line that begins with '@' and whose next but one begins
with '+'.  A quality line may begin with '@' too, but the line two below it is
a sequence, which has no '+': so a task that starts anywhere finds the first
record by looking at seven lines.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

SCHEMA = "name string, seq string, qual string, path string"
ENDINGS = (".fq", ".fastq", ".fq.gz", ".fastq.gz")
BATCH = 16384


@dataclass
class Piece(InputPartition):
    """Records of a file that begin in bytes [start, end); a compressed file is one piece."""

    path: str
    start: int
    end: int


def _parts(source, at: int, size: int, step: int = 1 << 20):
    while at < size:
        part = source.read_at(min(step, size - at), at)
        yield part
        at += len(part)


def _inflated(parts):
    """The content of a gzip file of one or more members."""
    engine = zlib.decompressobj(31)
    for part in parts:
        while part:
            out = engine.decompress(part)
            if out:
                yield out
            part = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def _lines(parts, at: int):
    """(place, line) of the lines of a stream of bytes; the last may lack its end."""
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        for line in whole:
            yield at, line.rstrip(b"\r")
            at += len(line) + 1
    if rest:
        yield at, rest.rstrip(b"\r")


def _starting(lines, middle: bool):
    """The lines from the first record's on; middle: the first line is the end of one that began before."""
    if middle:
        next(lines, None)
    held = [x for _, x in zip(range(7), lines)]
    for i in range(min(4, len(held))):
        if held[i][1].startswith(b"@") and i + 2 < len(held) and held[i + 2][1].startswith(b"+"):
            held = held[i:]
            break
    else:
        if not middle and any(x[1] for x in held):
            raise ValueError("not a FASTQ file of four lines a record")
        held = []
    yield from held
    yield from lines


def records(lines, end: float):
    """(name, sequence, quality) of the records that begin before `end`."""
    while True:
        four = []
        for place, line in lines:
            if not four and not line:
                continue  # an empty line between records
            if not four and place >= end:
                return
            four.append(line)
            if len(four) == 4:
                break
        if not four:
            return
        if len(four) < 4 or not four[0].startswith(b"@") or not four[2].startswith(b"+") or len(four[1]) != len(four[3]):
            raise ValueError(f"a broken record: {b' / '.join(four)[:200]!r}")
        yield (four[0][1:].split() or [b""])[0].decode(), four[1].decode(), four[3].decode()


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", files.SPLIT))

    def partitions(self):
        out = []
        for path, size in files.found(self.path, ENDINGS):
            out += [Piece(path, a, b) for a, b in (files.ranges(size, self.split) if not path.endswith(".gz") else [(0, size)])]
        return out or [Piece("", 0, 0)]

    def read(self, piece):
        if piece.end == 0:
            return
        with files.opened(piece.path) as source:
            size = source.size()
            if piece.path.endswith(".gz"):
                own = records(_starting(_lines(_inflated(_parts(source, 0, size)), 0), False), float("inf"))
            else:
                # One byte before the range tells whether a line begins with it.
                at = max(piece.start - 1, 0)
                own = records(_starting(_lines(_parts(source, at, size), at), piece.start > 0), piece.end)
            rows = []
            for row in own:
                rows.append(row)
                if len(rows) == BATCH:
                    yield self._batch(rows, piece.path)
                    rows = []
            if rows:
                yield self._batch(rows, piece.path)

    @staticmethod
    def _batch(rows, path):
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*rows)), pa.array([path] * len(rows))], names=["name", "seq", "qual", "path"])


class FastqSource(DataSource):
    """Format `fastq`; options: path of a file or a folder, split (bytes)."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)


def fastq(spark: SparkSession, path: str, split: int = files.SPLIT) -> DataFrame:
    """(name, seq, qual, path): records of four lines; the name ends at the first blank.  A broken record is an error."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("split", split).load(path)

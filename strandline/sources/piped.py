"""Text that comes through a pipe, as a stream that can be read again.

A pipe forgets what was read.  :func:`spool` copies it to a file in the shared
folder, whole lines at a time; the stream ``spooled_lines`` reads that file by byte
offsets, so that Spark's checkpoint says where to go on and a failed batch is read again.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one partition of a batch, and of one copy.
PART_BYTES = 8 << 20
COPY_BYTES = 1 << 16


def spool(pipe: BinaryIO, path: str, copy_bytes: int = COPY_BYTES) -> int:
    """Appends what a pipe gives to a file until it ends; the number of bytes.

    Only whole lines are written (a last one without an end gets one), each time to the
    disk.  A file that a broken copy left in the middle of a line is cut back first.
    """
    with open(path, "ab+") as out:
        size = _whole_lines(out)
        out.truncate(size)
        rest, written = b"", 0
        while block := (pipe.read1(copy_bytes) if hasattr(pipe, "read1") else pipe.read(copy_bytes)):
            lines, end, rest = (rest + block).rpartition(b"\n")
            if end:
                written += out.write(lines + end)
                out.flush()
                os.fsync(out.fileno())
        if rest:
            written += out.write(rest + b"\n")
        out.flush()
        os.fsync(out.fileno())
    return written


def _whole_lines(file: BinaryIO) -> int:
    """Bytes of a file up to the end of its last whole line."""
    at = file.seek(0, os.SEEK_END)
    while at:
        low = max(0, at - COPY_BYTES)
        file.seek(low)
        k = file.read(at - low).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        at = low
    return 0


@dataclass
class Stretch(InputPartition):
    """Lines that begin in [begin, end) of a file."""

    begin: int
    end: int

    def __post_init__(self) -> None:
        self.value = (self.begin, self.end)


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def initialOffset(self):
        return {"bytes": 0}

    def latestOffset(self):
        if not os.path.exists(self.path):
            return {"bytes": 0}
        with open(self.path, "rb") as f:
            return {"bytes": _whole_lines(f)}

    def partitions(self, start, end):
        cuts = [*range(start["bytes"], end["bytes"], self.part_bytes), end["bytes"]]
        return [Stretch(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, part):
        with open(self.path, "rb") as f:
            at = part.begin
            if at:  # a line that begins before is the part's before
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            offsets, lines = [], []
            while at < part.end:
                line = f.readline()
                offsets.append(at)
                lines.append(line.rstrip(b"\n").decode("utf-8", "replace"))
                at += len(line)
                if len(lines) == 10_000:
                    yield pa.RecordBatch.from_pydict({"offset": pa.array(offsets, pa.int64()), "value": lines})
                    offsets, lines = [], []
            if lines:
                yield pa.RecordBatch.from_pydict({"offset": pa.array(offsets, pa.int64()), "value": lines})

    def commit(self, end):
        pass  # the file stays, so that any batch can be read again


class SpooledLines(DataSource):
    @classmethod
    def name(cls):
        return "spooled_lines"

    def schema(self):
        return "offset long, value string"

    def streamReader(self, schema):
        return LineReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def read_spooled(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Stream of (offset, value): the lines of a file that :func:`spool` writes, with the byte at which each begins."""
    spark.dataSource.register(SpooledLines)
    return spark.readStream.format("spooled_lines").option("part_bytes", part_bytes).load(path)

"""A stream over growing files of lines: each line once, from the byte at which the last batch ended.

Spark's own file streams take a file whole, once, when it first appears. Logs that are appended to
need an offset a file: here the stream's offset is a map from file to bytes, which Spark keeps in the
checkpoint, so a restart goes on where it was. A line counts once its end is written; what follows the
last one waits. Long stretches are dealt to several tasks, each taking the lines that begin in its part.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
#: Bytes of a part, and bytes looked through at once for the last line's end.
PART_BYTES, LOOK_BYTES = 32 << 20, 1 << 16


def ended_bytes(path: str, known: int = 0) -> int:
    """Up to which byte the file's lines are complete; `known` bytes are known to be. A file that is shorter than that was written anew: 0 onwards counts again."""
    size = os.path.getsize(path)
    if size < known:
        known = 0
    with open(path, "rb") as file:
        at = size
        while at > known:
            low = max(known, at - LOOK_BYTES)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return known


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin at bytes low..high; its complete part ends at `end`."""

    path: str
    low: int
    high: int
    end: int

    def __init__(self, path: str, low: int, high: int, end: int):
        self.path, self.low, self.high, self.end = path, low, high, end


def lines_of(part: Stretch) -> Iterator[tuple[str, int, str]]:
    """(file, offset, line) of the stretch; bytes that aren't UTF-8 are replaced, a carriage return at the end goes."""
    with open(part.path, "rb") as file:
        at = part.low
        if at:  # a line that began before belongs to the stretch before
            file.seek(at - 1)
            at = at - 1 + len(file.readline())
        else:
            file.seek(0)
        while at < part.high:
            line = file.readline()
            if not line or at + len(line) > part.end:
                return
            yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.seen: dict[str, int] = {}

    def _files(self) -> list[str]:
        pattern = os.path.join(self.pattern, "*") if os.path.isdir(self.pattern) else self.pattern
        return sorted(f for f in glob.glob(pattern) if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = {path: ended_bytes(path, self.seen.get(path, 0)) for path in self._files()}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, upto in sorted(end.items()):
            low = start.get(path, 0)
            if upto < low:  # written anew
                low = 0
            out += [Stretch(path, at, min(at + self.part_bytes, upto), upto) for at in range(low, upto, self.part_bytes)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        return lines_of(partition)


class GrowingLines(DataSource):
    """Option path: a folder, a file or a pattern, on a disk that driver and executors share. Files in a folder that begin with . or _ are left out."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options)


def growing_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of (file, offset, value): the lines of growing files."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).options(path=path, **options).load()

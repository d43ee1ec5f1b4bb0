"""Exports as they are downloaded: zip archives and folders of JSON shards, a row a document.

Archives are read whole, one to a task's row (Spark's binary files are bounded by 2 GB), their members
one after the other. What a member says of its size isn't trusted: reading stops at the budget.
Members that are broken, too large or not text give an error row, and the others are read.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Shards of a chat export.
SHARDS = r"(?:^|/)conversations(?:-\d+)?\.json$"
MEMBER_BYTES, ARCHIVE_BYTES = 256 << 20, 1 << 30
_STEP = 1 << 20


def _text(chunks: Iterator[bytes], most: int) -> tuple[str | None, str | None, int]:
    """(text, error, bytes) of what chunks give, read up to the budget."""
    held, size = [], 0
    for chunk in chunks:
        size += len(chunk)
        if size > most:
            return None, f"more than {most} bytes", size
        held.append(chunk)
    try:
        return b"".join(held).decode("utf-8-sig"), None, size
    except UnicodeDecodeError as error:
        return None, f"not UTF-8 at byte {error.start}", size


def _steps(file) -> Iterator[bytes]:
    while chunk := file.read(_STEP):
        yield chunk


def documents_of(content: bytes, pattern: re.Pattern, member_bytes: int, archive_bytes: int) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(member, text, error) of an archive's matching members by name, or of a file that is no archive."""
    if not content.startswith(b"PK"):
        text, error, _ = _text(iter([content]), member_bytes)
        yield None, text, error
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        yield None, None, f"broken archive: {error}"
        return
    names = sorted({m.filename for m in archive.infolist() if pattern.search(m.filename)})
    if not names:
        yield None, None, "no documents in the archive"
    left = archive_bytes
    for name in names:
        if left <= 0:
            yield name, None, f"the archive has more than {archive_bytes} bytes"
            continue
        try:
            with archive.open(name) as file:
                text, error, size = _text(_steps(file), min(member_bytes, left))
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError) as broken:
            text, error, size = None, f"broken member: {broken}", 0
        left -= size
        yield name, text, error


def export_documents(spark: SparkSession, path: str, *, pattern: str = SHARDS, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """file, member, id, content, error: a row per document of the files under path; content is null where there is an error, and the other way round.

    id names file and member. Files that are no archives are documents themselves (member null). Rows of readers in `imports` are id and content.
    """
    chosen = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for member, text, error in documents_of(content.as_py(), chosen, member_bytes, archive_bytes):
                    name = file.as_py()
                    yield pa.RecordBatch.from_pylist([{"file": name, "member": member, "id": f"{name}#{member}" if member else name, "content": text, "error": error}], schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, member string, id string, content string, error string")


_SCHEMA = pa.schema([(n, pa.string()) for n in ("file", "member", "id", "content", "error")])


def conversations(documents: DataFrame) -> DataFrame:
    """id, content: the conversations of export documents, each by its document's id and its place; documents may hold one or a list. Broken ones give none."""
    from pyspark.sql import functions as F

    body = F.trim("content")
    many = F.from_json(body, "array<string>")
    held = F.when(body.startswith("["), many).when(body.startswith("{"), F.array(body))
    rows = documents.filter("content IS NOT NULL").select("id", F.posexplode(held).alias("place", "content")).filter("content IS NOT NULL")
    return rows.select(F.concat_ws("#", "id", F.col("place").cast("string")).alias("id"), "content")

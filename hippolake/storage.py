"""Tables in, and intermediate results on storage that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, lazily; only Spark's reader touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, where its files are so few that some would stay idle; large tables come back as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, jobs that start hand Python workers at most `most` bytes at once (but a row at least)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one, if all runs on this machine; on a cluster, an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"hippolake-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: What materialize has written and release has not removed.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove all that materialize has written so far. For long applications: call it once results that read it are written themselves."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def release_one(df: DataFrame) -> None:
    """Remove a table that materialize has written and nothing reads any more."""
    names = df.inputFiles()
    for path in [p for p in _WRITTEN if any(p.rsplit("/", 1)[1] in name for name in names)]:
        _WRITTEN.remove(path)
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Best effort: at exit the session may be gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    It cuts the lineage like checkpoint(), survives lost executors, and keeps columns apart, so
    that later readers take only what they need. The files go when the process ends, or with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hippolake/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(path)
    return spark.read.schema(schema).parquet(path)

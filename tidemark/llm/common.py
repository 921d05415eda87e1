"""What several operators share: the shared folder, written tables, word splitting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space. ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names. Only on one machine (a local master, as in tests)
    a temporary folder is made and set as the checkpoint folder where that is unset; on a cluster a
    missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    store(df, path, partition_by)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    remove(df.sparkSession, df.scratch_path)


@contextmanager
def fading(keep: str) -> Iterator[None]:
    """At its end, what ``written`` wrote inside goes, but for tables that were named ``keep``."""
    before = len(_written)
    yield
    for spark, path in _written[before:]:
        if not path.rsplit("/", 1)[1].startswith(f"{keep}-"):
            remove(spark, path)


def store(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` to ``path``."""
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of what is now written


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system, so that any shared store works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
            continue


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables inside loops."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()  # as in ``store``
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch, one at a time; a null text is an empty one."""
    for x in column(batch, name):
        yield x.as_py() or ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str = "text"):
    """Words in a text column (null: 0), inside whole-stage code."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")

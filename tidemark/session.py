"""Session settings and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tidemark_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidemark", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def local_session(cpus: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only on one machine (a local master) a temporary folder takes its place where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/bars/{name}-{uuid.uuid4().hex}"


_stored: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, nothing is computed twice.

    The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    _stored.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """As ``stored``, for what comes in parts (one at least): each is written before the next one is asked for."""
    path, schema = None, None
    for i, df in enumerate(parts):
        if path is None:
            spark, schema, path = df.sparkSession, df.schema, shared_path(df.sparkSession, name)
            _stored.append((spark, path))
        df.write.parquet(f"{path}/part={i}")
    return spark.read.schema(schema).parquet(f"{path}/part=*")


@atexit.register
def _clear() -> None:
    for spark, path in _stored:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
            continue

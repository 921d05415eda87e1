"""Fits that don't change once registered, and scores of what came later.

A registered fit is a document: its fields as JSON, the time up to which it saw data (``boundary_ns``) and the
SHA-256 of both. Reading it checks every digest; a changed document is refused. Scoring takes cases after
the boundary only and never refits. As a stream it is idempotent: a case is scored once, whatever is sent
again, and a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.bars import SERIES
from . import residuals

#: The fields of a fit, in the order of their names.
FIELDS = ("dev", "high", "low", "mean", "slope_down", "slope_range", "slope_up")
BODY = ", ".join(f"{c} double" for c in FIELDS)


def _digest() -> Column:
    return F.sha2(F.concat_ws("|", "instrument_id", "timeframe", "feature", F.col("boundary_ns").cast("string"), "document"), 256)


def register(fitted: DataFrame, feature: str, boundary: DataFrame, path: str) -> None:
    """Write the fits of ``residuals.fit`` (one row for each series) with ``boundary`` (SERIES, boundary_ns).

    A path that has fits is not written again.
    """
    made = fitted.join(boundary, SERIES).select(*SERIES, F.lit(feature).alias("feature"), "boundary_ns", F.to_json(F.struct(*FIELDS)).alias("document"))
    made.withColumn("sha256", _digest()).write.mode("errorifexists").parquet(path)


def registered(spark: SparkSession, path: str) -> DataFrame:
    """SERIES, feature, boundary_ns, the fields and sha256 of the fits at ``path``; a ValueError names a
    document that doesn't have its digest."""
    rows = spark.read.parquet(path)
    changed = rows.where(~_digest().eqNullSafe(F.col("sha256"))).select(*SERIES).limit(1).collect()
    if changed:
        raise ValueError(f"the registered fit of {changed[0].instrument_id} {changed[0].timeframe} was changed")
    return rows.withColumn("body", F.from_json("document", StructType.fromDDL(BODY))).select(*SERIES, "feature", "boundary_ns", *[F.col(f"body.{c}").alias(c) for c in FIELDS], "sha256")


def score(cases: DataFrame, fits: DataFrame, feature: str) -> DataFrame:
    """Cases (SERIES, at, actual, p_up, p_range, p_down, the feature) after their fit's boundary, with Brier
    scores as forecast and corrected, where the feature lies (BELOW, WITHIN, ABOVE its range in the fit, or
    MISSING) and the digest of the fit. Cases without a fit give no row."""
    own = fits.where(F.col("feature") == feature).drop("feature")
    known = cases.select(*SERIES, "at", "actual", *[f"p_{n}" for n in residuals.NAMES], F.col(feature).alias("x")).withColumn("brier", residuals.brier())
    later = known.join(own.select(*SERIES, "boundary_ns"), SERIES).where("at > boundary_ns").drop("boundary_ns")
    moved = residuals.apply(later, "x", own, SERIES).withColumn("corrected_brier", residuals.brier())
    z = (F.col("x") - F.col("mean")) / F.col("dev")
    place = F.when(F.col("x").isNull(), "MISSING").when(z < F.col("low"), "BELOW").when(z > F.col("high"), "ABOVE").otherwise("WITHIN")
    return moved.join(own, SERIES).select(*SERIES, "at", "actual", "brier", "corrected_brier", place.alias("support"), "sha256")


def score_stream(cases: DataFrame, fits: DataFrame, feature: str, path: str, checkpoint: str) -> StreamingQuery:
    """Score a stream of cases into ``path``, what is there first, then end; call it again for what is new.

    Rows are in folders by batch. A batch drops cases that other batches have scored, and repeated ones, and
    replaces its own folder, so that a batch that failed half-way leaves nothing twice.
    """
    spark = fits.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        fresh = score(batch, fits, feature).dropDuplicates([*SERIES, "at"])
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        if there:
            done = spark.read.schema("instrument_id string, timeframe string, at long, batch long").parquet(path).where(F.col("batch") != number)
            fresh = fresh.join(done, [*SERIES, "at"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cases.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

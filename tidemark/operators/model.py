"""Profiles as models: fitted from bars and frames, kept as tables, loaded to vote on later frames.

``ProfileEstimator(bars).fit(frames)`` gives a ``ProfileModel``. Every size follows from the numbers of bars and
frames of a series; the last isqrt(n) of its n frames are a test that no parameter sees, as many before them
choose the distance limit, the power and the gates, and all earlier ones fit normalisation and barrier.

A model is four tables, each keyed by series: ``settings`` (a row), ``axes`` (a row for each dimension),
``library`` (the normalised samples of training and validation) and ``reliability`` (a row for each class that
the test votes name). ``refused`` tells why a series has no profile: FEW_BARS (under 16), FEW_FRAMES (under 8, or
under 4 before the validation frames), NO_BARRIER (no excursion above 0), FEW_LABELS (under 4 in training,
none in validation or test), NO_DISTANCE (no validation row is at a finite distance from a training row).

Bars: SERIES, close_time_ns, high, low, close. Frames: SERIES, timestamp_ns, vector (null where a dimension
isn't available); other columns are left aside. A frame at whose time no bar, or more than one, closes is an
error. Empty tables give an empty model, whose votes are empty.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources.bars import SERIES
from . import align, labels, walk
from . import samples as S
from .audits import upper_median
from .metric_index import MetricIndex
from .scoring import ORDER, ratio_bp, wilson_lower_bp

LEAST_BARS, LEAST_FRAMES, LEAST_TRAIN = 16, 8, 4
#: The smallest distance limit, the double epsilon.
LEAST_DISTANCE = 2.0**-52
TABLES = ("settings", "axes", "library", "reliability", "refused")


class ProfileModel(Model):
    """Fitted profiles; see the module."""

    def __init__(self, **tables: DataFrame):
        super().__init__()
        for name in TABLES:
            setattr(self, name, tables[name])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The vote of each frame: SERIES, timestamp_ns, predicted (UNRESOLVED without support), the basis
        points and the number of neighbours. A frame of a series without a profile gives no row; frames that
        repeat a time of their series are an error."""
        asked = dataset.select(*SERIES, F.col("timestamp_ns").alias("at"), "vector")
        met = walk.scale(asked, self.axes).drop("effective").withColumn("direction", F.lit(None).cast("string"))
        queries = stored(met.join(self.settings.select(*SERIES, "k", "most", "power", "least_support"), SERIES), "queries")
        twice = queries.groupBy(*SERIES, "at").count().where("count > 1").limit(1).count()
        if twice:
            raise ValueError("two frames of a series at one time")
        most_k = self.settings.agg(F.max("k")).first()[0] or 1
        found = MetricIndex(self.library).search(queries, most_k, F.col("most"))[0].where("rank <= q_k")
        votes = walk.judged(found, queries, self.settings, F.col("q_power"))
        return votes.drop("actual").withColumnRenamed("at", "timestamp_ns")

    def save(self, path: str) -> None:
        """Write the tables below ``path``; one that has a model is not written again."""
        for name in TABLES:
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ProfileModel:
        return ProfileModel(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})


class ProfileEstimator(Estimator):
    """Fits a profile for each series of ``bars``; see the module."""

    def __init__(self, bars: DataFrame):
        super().__init__()
        self.bars = bars

    def _fit(self, dataset: DataFrame) -> ProfileModel:
        bars = stored(self.bars.select(*SERIES, "close_time_ns", "high", "low", "close"), "bars")
        frames = stored(align.frames_with_bars(dataset.select(*SERIES, "timestamp_ns", "vector"), bars).select(*SERIES, F.col("timestamp_ns").alias("at"), "vector"), "frames")
        plan = stored(_sizes(bars, frames), "sizes")
        refused = plan.where("reason IS NOT NULL").select(*SERIES, "reason")
        plan = plan.where("reason IS NULL").drop("reason")

        def without(kept: DataFrame, reason: str) -> DataFrame:
            """Series of ``plan`` that ``kept`` doesn't have, refused for ``reason``."""
            return refused.unionByName(plan.select(*SERIES).join(kept, SERIES, "left_anti").withColumn("reason", F.lit(reason)))

        # The split, the barrier from training bars alone, and the labels.
        parted = stored(walk.split(frames.join(plan.select(*SERIES), SERIES), frames), "parted")
        first = lambda part: F.min(F.when(F.col("part") == part, F.col("at")))
        plan = plan.join(parted.groupBy(*SERIES).agg(first(walk.VALIDATION).alias("validation_ns"), first(walk.EVALUATION).alias("split_ns")), SERIES)
        sized = bars.join(plan.select(*SERIES, "lookback", "horizon", "validation_ns"), SERIES)
        barrier = stored(labels.symmetric_barrier(sized, "lookback", "horizon", train=F.col("close_time_ns") < F.col("validation_ns")).select(*SERIES, "barrier"), "barriers")
        refused, plan = without(barrier, "NO_BARRIER"), plan.join(barrier, SERIES)
        told = labels.first_passage(sized.join(barrier, SERIES), "lookback", "horizon", F.col("barrier"), F.col("barrier")).where("direction <> 'CENSORED'")
        rows = stored(parted.join(told.select(*SERIES, F.col("close_time_ns").alias("at"), "direction", "first_passage_bars"), [*SERIES, "at"]), "labelled")
        here = lambda part: F.count_if(F.col("part") == part)
        counts = rows.groupBy(*SERIES).agg(here(walk.TRAIN).alias("train"), here(walk.VALIDATION).alias("validation"), here(walk.EVALUATION).alias("test"), F.min("at").alias("start_ns"), F.max("at").alias("end_ns"))
        counts = stored(counts.where(F.col("train") >= LEAST_TRAIN).where("validation > 0 AND test > 0"), "counts")
        refused, plan = without(counts, "FEW_LABELS"), plan.join(counts, SERIES)
        plan = stored(plan.join(walk.settings(rows).drop("train"), SERIES), "plan")

        # Normalisation from training rows, the distance limit from the validation rows' k-th distances.
        axes = stored(S.fit_normalization(rows.where(F.col("part") == walk.TRAIN), SERIES).join(plan.select(*SERIES), SERIES, "left_semi"), "axes")
        ready = stored(walk.scale(rows, axes).join(plan.select(*SERIES, "k"), SERIES), "samples")
        most_k = plan.agg(F.max("k")).first()[0] or 1
        train = MetricIndex(ready.where(F.col("part") == walk.TRAIN))
        validation = ready.where(F.col("part") == walk.VALIDATION)
        met = stored(train.search(validation, most_k)[0].where("rank <= q_k").select(*[f"q_{c}" for c in (*SERIES, "at")], "l_direction", "distance"), "met")
        own = [F.col(f"q_{c}").alias(c) for c in SERIES]
        limits = stored(met.groupBy(*own).agg(F.greatest(F.max("distance"), F.lit(LEAST_DISTANCE)).alias("most")).where("most < double('infinity')"), "limits")
        refused, plan = stored(without(limits, "NO_DISTANCE"), "refused"), stored(plan.join(limits, SERIES), "limited")

        # All k nearest are within the limit, which is the largest of these very distances. Power 2 has to be
        # right strictly more often.
        asked = validation.join(limits.select(*SERIES), SERIES, "left_semi")
        cases = {p: stored(walk.judged(met, asked, plan, p), "validation") for p in (1.0, 2.0)}
        tally = [_tally(cases[p]).select(*SERIES, F.col("evaluated").alias(f"evaluated_{int(p)}"), F.col("correct").alias(f"correct_{int(p)}")) for p in (1.0, 2.0)]
        second = F.col("correct_2") > F.col("correct_1")
        chosen = tally[0].join(tally[1], SERIES).select(*SERIES, F.when(second, 2.0).otherwise(1.0).alias("power"), F.when(second, F.col("correct_2")).otherwise(F.col("correct_1")).alias("right"), F.when(second, F.col("evaluated_2")).otherwise(F.col("evaluated_1")).alias("of"))
        chosen = stored(chosen.select(*SERIES, "power", wilson_lower_bp(F.col("right"), F.col("of")).alias("least_reliability_bp")), "powers")
        right = cases[1.0].withColumn("power", F.lit(1.0)).unionByName(cases[2.0].withColumn("power", F.lit(2.0))).join(chosen.select(*SERIES, "power"), [*SERIES, "power"]).where("predicted = actual")
        ranked = F.sort_array(F.array("up_bp", "range_bp", "down_bp"), asc=False)
        edges = upper_median(right.withColumn("edge", ranked[0] - ranked[1]), SERIES, "edge").withColumnRenamed("upper_median", "edge_bp")
        effective = axes.groupBy(*SERIES).agg(F.count_if("effective").alias("dimensions"))
        plan = stored(plan.join(chosen, SERIES).join(edges, SERIES, "left").withColumn("edge_bp", F.coalesce("edge_bp", F.lit(10_000))).join(effective, SERIES), "settings")

        # What is frozen now votes on the test rows.
        library = stored(ready.where(F.col("part") != walk.EVALUATION).join(plan.select(*SERIES), SERIES, "left_semi").drop("k", "part", "effective"), "library")
        empty = library.sparkSession.createDataFrame([], "instrument_id string, timeframe string, direction string, cases long, precision_bp long, lower_bp long")
        model = ProfileModel(settings=plan, axes=axes.join(plan.select(*SERIES), SERIES, "left_semi"), library=library, reliability=empty, refused=refused)
        test = rows.where(F.col("part") == walk.EVALUATION)
        votes = model.transform(test.withColumnRenamed("at", "timestamp_ns")).withColumnRenamed("timestamp_ns", "at")
        frequency = library.groupBy(*SERIES).agg(F.count("*").alias("library"), *[F.count_if(F.col("direction") == d).alias(d.lower()) for d in ORDER])
        scored = stored(votes.join(test.select(*SERIES, "at", F.col("direction").alias("actual")), [*SERIES, "at"]).join(frequency, SERIES), "scored")
        merits = walk.metrics(scored).select(*SERIES, F.col("resolved").alias("evaluated"), "correct", ratio_bp(F.col("correct"), F.col("resolved")).alias("reliability_bp"), wilson_lower_bp(F.col("correct"), F.col("resolved")).alias("lower_bp"), "balanced_accuracy", "brier", "climatology", "skill", "calibration_error")
        model.settings = stored(plan.join(merits, SERIES), "settings")
        named = scored.where("predicted <> 'UNRESOLVED'").groupBy(*SERIES, F.col("predicted").alias("direction")).agg(F.count("*").alias("cases"), F.count_if(F.col("predicted") == F.col("actual")).alias("correct"))
        model.reliability = stored(named.select(*SERIES, "direction", "cases", ratio_bp(F.col("correct"), F.col("cases")).alias("precision_bp"), wilson_lower_bp(F.col("correct"), F.col("cases")).alias("lower_bp")), "reliability")
        return model


def _sizes(bars: DataFrame, frames: DataFrame) -> DataFrame:
    """bars, frames, lookback, horizon of each series of ``frames`` and the reason that refuses it, if any."""
    n = bars.groupBy(*SERIES).agg(F.count("*").alias("bars"))
    m = frames.groupBy(*SERIES).agg(F.count("*").alias("frames"))
    held = F.floor(F.sqrt("frames"))
    reason = F.when(F.col("bars") < LEAST_BARS, "FEW_BARS").when((F.col("frames") < LEAST_FRAMES) | (F.col("frames") - 2 * held < LEAST_TRAIN), "FEW_FRAMES")
    return n.join(m, SERIES).select(*SERIES, "bars", "frames", F.greatest(F.floor(F.sqrt("bars")), F.lit(2)).cast("int").alias("lookback"), F.greatest(F.length(F.bin("bars")), F.lit(2)).alias("horizon"), reason.alias("reason"))


def _tally(cases: DataFrame) -> DataFrame:
    there = F.col("predicted") != "UNRESOLVED"
    return cases.groupBy(*SERIES).agg(F.count_if(there).alias("evaluated"), F.count_if(there & (F.col("predicted") == F.col("actual"))).alias("correct"))

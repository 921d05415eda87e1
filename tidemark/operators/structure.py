"""From kernel rows to a feature vector.

The kernel itself is not part of this library: its rows are an input table (instrument_id, timeframe,
timestamp_ns, delta, delta_tilde, xi, A, lambda, theta, M, G). Everything here is causal, and what is
"prior" is strictly prior. Window arithmetic is Spark's; linear algebra and the state machine run once
for each series in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from . import ledger
from .scan import LEAST_FACTOR, scan


def by():
    """Each series in order."""
    return Window.partitionBy(*SERIES).orderBy("timestamp_ns")

#: Fixed values. Rows that a centre and a scale are taken from, and rows of a path.
PRIOR = 32
PATH = 16
READY = 8
#: Least movement of an active path, and the thresholds of the observer.
ACTIVITY = 0.5
COHERENT, RECURRENT, CONTRACTING = 0.5, 0.3, 0.25
LAG, RADIUS, RIDGE, RESIDUAL_FLOOR, LEAST_TRANSITIONS = 2, 0.5, 0.001, 0.05, 8
GRACE, TAU = 4, 16
TINY = 1e-12
AXES = ("delta", "xi_occupancy", "capacity", "margin", "trend", "accumulated_excess")


def squash(x: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(x / (1 + F.greatest(x, F.lit(0.0))))


def _clip(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def bounded_state(rows: DataFrame, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """Six coordinates in [0, 1] of each kernel row."""
    theta = F.greatest(F.col("theta"), F.lit(TINY))
    made = [squash(F.col("delta_tilde")), _clip(F.col("xi") / theta), _clip((F.col("lambda") - low) / (high - low)), 0.5 + 0.5 * F.tanh(F.col("M") / theta), 0.5 + 0.5 * F.tanh("G"), squash(F.col("A"))]
    return rows.select(*SERIES, "timestamp_ns", *[c.alias(a) for c, a in zip(made, AXES, strict=True)])


def _median(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, F.greatest(mid - 1, F.lit(0))) + F.get(s, mid)) / 2)


def robust_geometry(states: DataFrame) -> DataFrame:
    """Coordinates relative to the strictly prior rows: 0.5 where there are none or they are constant."""
    frame = by().rowsBetween(-PRIOR, -1)
    out = states.select(*SERIES, "timestamp_ns", *AXES, *[F.collect_list(a).over(frame).alias(f"{a}_prior") for a in AXES])
    for a in AXES:
        prior = F.col(f"{a}_prior")
        out = out.withColumn("centre", _median(prior))
        deviation = _median(F.transform(f"{a}_prior", lambda x: F.abs(x - F.col("centre"))))
        half = (F.array_max(prior) - F.array_min(prior)) / 2
        out = out.withColumn("mad", deviation).withColumn("scale", F.when(F.col("mad") > 0, F.col("mad")).otherwise(half))
        out = out.withColumn(a, F.when(F.coalesce(F.col("scale"), F.lit(0.0)) > 0, 0.5 + 0.5 * F.tanh((F.col(a) - F.col("centre")) / F.when(F.col("scale") > 0, F.col("scale")))).otherwise(0.5))
    return out.select(*SERIES, "timestamp_ns", *AXES)


def step_length(columns: tuple[str, ...] = AXES) -> Column:
    parts = [F.pow(F.col(a) - F.lag(a).over(by()), 2) for a in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.sqrt(total / len(columns))


def paths(geometry: DataFrame) -> DataFrame:
    """``geometry`` with path_length over the last 16 states and whether there are 8 of them."""
    return geometry.withColumn("step", step_length()).withColumns({"path_length": F.coalesce(F.sum("step").over(by().rowsBetween(2 - PATH, 0)), F.lit(0.0)), "ready": F.least(F.row_number().over(by()), F.lit(PATH)) >= READY}).drop("step")


def recurrence_intensity(x: np.ndarray) -> float:
    """How near the last state of a window comes to earlier ones more than LAG steps away."""
    n = len(x)
    i, j = np.triu_indices(n, LAG + 1)
    far = np.sqrt(((x[i] - x[j]) ** 2).mean(1))
    far = far[far > TINY]
    if not len(far) or n <= LAG + 1:
        return 0.0
    radius = max(RADIUS * float(np.median(far)), TINY)
    return float(np.maximum(0.0, 1.0 - np.sqrt(((x[: n - LAG - 1] - x[-1]) ** 2).mean(1)) / radius).max())


def ridge_coherence(x: np.ndarray, t: int) -> tuple[float, float, int]:
    """(coherence, residual, transitions) of a linear prediction of row t from earlier transitions."""
    last = t - 1
    first = max(0, last - PRIOR)
    if t < 2 or last - first < LEAST_TRANSITIONS:
        return np.nan, np.nan, max(0, last - first)
    a, b = x[first:last], x[first + 1 : last + 1]
    w = np.linalg.solve(a.T @ a + RIDGE * np.eye(x.shape[1]), a.T @ b)
    residual = float(np.sqrt(((x[last] @ w - x[t]) ** 2).mean()))
    moves = np.sqrt(((b - a) ** 2).mean(1))
    moves = moves[moves > TINY]
    return float(np.exp(-residual / max(RESIDUAL_FLOOR, float(np.median(moves)) if len(moves) else TINY))), residual, last - first


def variation_capacity(x: np.ndarray) -> float:
    """Effective rank of the active steps of a window, scaled to [0, 1]; NaN with fewer than three."""
    steps = np.diff(x, axis=0)
    steps = steps[np.sqrt((steps**2).mean(1)) > TINY]
    if len(steps) < 3:
        return np.nan
    centred = steps - steps.mean(0)
    values = np.maximum(np.linalg.eigvalsh(centred.T @ centred), 0.0)
    values = values[values > TINY]
    if not len(values):
        return 0.0
    p = values / values.sum()
    return float(np.clip((np.exp(-(p * np.log(p)).sum()) - 1) / (x.shape[1] - 1), 0.0, 1.0))


OBSERVED = "transport string, state string, movement double, coherence double, residual double, transitions int, recurrence double, variation double, contraction double, deficit double, cumulative_deficit double"


class Machine:
    """The observer of one series, row by row. What it holds is bounded: the last rows that a prediction or a
    window reads, as many intensities and capacities as their means and maxima take, and run lengths."""

    #: Rows held: the transitions of a ridge, with both ends and the row predicted.
    HELD = PRIOR + 3

    def __init__(self, rows=(), intensity=(), capacities=(), seen=0, regime=None, broken=0, crystal=0, first=-1, owed=0.0):
        self.rows, self.intensity, self.capacities = [list(r) for r in rows], list(intensity), [np.nan if c is None else c for c in capacities]
        self.seen, self.regime, self.broken, self.crystal, self.first, self.owed = seen, regime, broken, crystal, first, owed

    def step(self, row: list[float], length: float, ready: bool) -> tuple:
        """The columns of ``OBSERVED`` for the next row."""
        t, self.seen = self.seen, self.seen + 1
        self.rows = [*self.rows, row][-self.HELD :]
        x = np.array(self.rows, float)
        window = x[-PATH:]
        self.intensity = [*self.intensity, recurrence_intensity(window)][-PATH:]
        active = bool(ready and length > ACTIVITY)
        recurrence = float(np.mean(self.intensity)) if active else 0.0
        coherence, residual, support = ridge_coherence(x, len(x) - 1) if active else (np.nan, np.nan, 0)
        self.capacities = [*self.capacities, variation_capacity(window) if ready else np.nan][-PRIOR:]
        capacity, known = self.capacities[-1], [c for c in self.capacities if not np.isnan(c)]
        contraction = np.nan if np.isnan(capacity) else max(0.0, 1.0 - capacity / max(known)) if max(known) > TINY else 0.0
        judged = not np.isnan(coherence)
        if judged and self.first < 0:
            self.first = t
        if not ready or (active and not judged):
            self.broken = self.crystal = 0
            transport, state = "UNRESOLVED", "TRANSPORT_UNRESOLVED"
        elif not active:
            self.broken = self.crystal = 0
            self.regime, transport, state = None, "INACTIVE", "STAGNANT"
        elif coherence >= COHERENT:
            both = recurrence >= RECURRENT and contraction >= CONTRACTING
            self.broken, self.crystal = 0, self.crystal + 1 if both else 0
            state = ("CRYSTALLIZED" if self.crystal >= TAU else "CRYSTALLIZING") if both else "RECURRENT" if recurrence >= RECURRENT else "VIABLE"
            self.regime, transport = state, "COHERENT"
        else:
            self.broken, self.crystal = self.broken + 1, 0
            held = self.regime == "VIABLE" and self.broken <= GRACE
            transport, state = ("PROVISIONAL", "VIABLE") if held else ("DISRUPTED", "TRANSPORT_DISRUPTED")
        deficit = max(0.0, (COHERENT - coherence) / COHERENT) if judged else np.nan
        if self.first >= 0 and t >= self.first + TAU and judged:
            self.owed += deficit
        return transport, state, length, coherence, residual, support, recurrence, capacity, contraction, deficit, self.owed

    def run(self, g: pd.DataFrame) -> pd.DataFrame:
        """The rows of ``paths`` of one series, with what is observed."""
        g = g.sort_values("timestamp_ns", ignore_index=True)
        rows = [self.step(r, n, k) for r, n, k in zip(g[list(AXES)].to_numpy(float).tolist(), g["path_length"].tolist(), g["ready"].tolist(), strict=True)]
        return pd.concat([g[["instrument_id", "timeframe", "timestamp_ns"]], pd.DataFrame(rows, columns=OBSERVED_NAMES)], axis=1)


OBSERVED_NAMES = [c.split()[0] for c in OBSERVED.split(", ")]
OBSERVED_ROW = f"instrument_id string, timeframe string, timestamp_ns long, {OBSERVED}"


def without_nan(found: DataFrame) -> DataFrame:
    """Null where an observation isn't available."""
    null = F.lit(None).cast("double")
    return found.withColumns({c: F.nanvl(c, null) for c in ("coherence", "residual", "variation", "contraction", "deficit")})


def observer(geometry: DataFrame) -> DataFrame:
    """State of each row of ``paths``: transport, structural state, coherence, recurrence, contraction,
    deficit. A run-length machine over one series in order; ``streaming.states`` runs it on a stream."""
    return without_nan(geometry.groupBy(*SERIES).applyInPandas(lambda g: Machine().run(g), OBSERVED_ROW))


def exponential_memory(rows: DataFrame, value: str, tau: float = 32.0) -> DataFrame:
    """Memory of ``value`` before and after each row; a null neither updates nor decays it.

    A blocked scan of two recurrences: the memory, and whether there was a value at all.
    """
    keep = float(np.exp(-1.0 / tau))

    def stage(block: dict[str, np.ndarray], first: int, before: dict[str, float], carries: list[np.ndarray]):
        known = ~np.isnan(block["value"])
        if not carries:
            z = 0.0
            for v in block["value"][known].tolist():
                z = keep * z + (1.0 - keep) * v
            return {}, [(max(keep ** int(known.sum()), LEAST_FACTOR), z), (1.0, float(known.sum()))]
        z, seen = carries[0].tolist()
        prior, after = [], []
        for v, k in zip(block["value"].tolist(), known.tolist(), strict=True):
            prior.append(z if seen else np.nan)
            if k:
                z, seen = keep * z + (1.0 - keep) * v, True
            after.append(z if seen else np.nan)
        return {"prior_memory": np.array(prior), "memory": np.array(after)}, []

    return scan(rows.withColumn("value", F.col(value)), "timestamp_ns", ["value"], stage, 1, ["prior_memory", "memory"])


def weighted_mean(rows: DataFrame, value: str, window: int, decay: float) -> DataFrame:
    """Mean of the last ``window`` values, the newest weighing 1 and each older one ``decay`` times less."""
    held = F.collect_list(value).over(by().rowsBetween(1 - window, 0))
    n = F.size("held")
    weight = lambda i: F.pow(F.lit(decay), (n - i - 1).cast("double"))
    out = rows.select(*SERIES, "timestamp_ns", held.alias("held"))
    top = F.aggregate(F.transform("held", lambda x, i: x * weight(i)), F.lit(0.0), lambda s, x: s + x)
    bottom = F.aggregate(F.transform("held", lambda x, i: weight(i)), F.lit(0.0), lambda s, x: s + x)
    return out.select(*SERIES, "timestamp_ns", F.try_divide(top, bottom).alias("weighted_mean"))


def relative_magnitude(rows: DataFrame, value: str, least: int = 8) -> DataFrame:
    """|x| / (|x| + median of |x| over the 32 strictly prior rows), null with fewer than ``least``.

    A median of 0 gives 0 where x is 0 too, and null elsewhere.
    """
    prior = by().rowsBetween(-PRIOR, -1)
    size = F.abs(F.col(value))
    usual = F.when(F.count(size).over(prior) >= least, F.percentile(size, F.lit(0.5)).over(prior))
    known = rows.select(*SERIES, "timestamp_ns", size.alias("size"), usual.alias("usual"))
    return known.select(*SERIES, "timestamp_ns", F.when(F.col("usual") > 0, F.col("size") / (F.col("size") + F.col("usual"))).when((F.col("usual") == 0) & (F.col("size") == 0), 0.0).alias("relative"))


def differential(rows: DataFrame, cost: str, benefit: str) -> DataFrame:
    """cost - benefit, its change, and the cumulative positive exposure. Null if either side is."""
    gap = F.col(cost) - F.col(benefit)
    out = rows.select(*SERIES, "timestamp_ns", gap.alias("differential"))
    return out.withColumns({"trend": F.col("differential") - F.lag("differential").over(by()), "exposure": F.coalesce(F.sum(F.greatest("differential", F.lit(0.0))).over(by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))})


def vector_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """values, mask and a digest of both for each row; names are the columns, in order."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    mask = F.transform(values, lambda x: x.isNotNull())
    return rows.select(*SERIES, "timestamp_ns", values.alias("values"), mask.alias("mask")).withColumn("digest", F.sha2(F.to_json(F.struct("values", "mask")), 256))


def snapshot(rows: DataFrame) -> DataFrame:
    """The last row of each series as one document."""
    rest = [c for c in rows.columns if c not in SERIES]
    return rows.groupBy(*SERIES).agg(F.max_by(F.to_json(F.struct(*rest)), "timestamp_ns").alias("document"), F.max("timestamp_ns").alias("timestamp_ns"))


def stack(kernel_rows: DataFrame, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """All of the above: one row for each kernel row, with its 14-dimensional vector."""
    state = bounded_state(kernel_rows, low, high)
    seen = observer(paths(robust_geometry(state)))
    memory = exponential_memory(seen, "deficit")
    place = [*SERIES, "timestamp_ns"]
    known = kernel_rows.select(*place, "xi", "A", "lambda", "theta", "G").join(seen.select(*place, "coherence", "contraction"), place)
    costs = ledger.ledger(known).select(*place, *ledger.DIFFERENTIALS)
    joined = state.join(seen, place).join(costs, place).join(memory, place)
    return vector_of(joined, [*AXES, "movement", "coherence", "recurrence", "contraction", "deficit", *ledger.DIFFERENTIALS, "prior_memory"])

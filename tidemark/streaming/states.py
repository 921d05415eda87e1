"""The structural observer on a stream: keyed state, checkpointed with the query.

The state of a series is that of ``structure.Machine``: 35 rows of six coordinates, 16 intensities, 32 capacities
and six numbers, however long the series is. A lost executor's partitions reload it from the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.structure import AXES, OBSERVED_ROW, Machine, without_nan
from ..sources.bars import SERIES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "cells array<double>, intensity array<double>, capacities array<double>, seen long, regime string, broken long, crystal long, first long, owed double, last_ns long"


class _Observe(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("observer", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine, last = Machine(), None
        if self.state.exists():
            cells, intensity, capacities, seen, regime, broken, crystal, first, owed, last = self.state.get()
            machine = Machine(np.array(cells, float).reshape(-1, len(AXES)).tolist(), intensity, capacities, seen, regime, broken, crystal, first, owed)
        g = pd.concat(list(rows), ignore_index=True).drop_duplicates("timestamp_ns")  # the rows of one micro-batch
        if last is not None:
            g = g[g["timestamp_ns"] > last]
        if len(g):
            yield machine.run(g)
            m = machine
            flat = [float(v) for r in m.rows for v in r]
            self.state.update((flat, [float(v) for v in m.intensity], [float(v) for v in m.capacities], int(m.seen), m.regime, int(m.broken), int(m.crystal), int(m.first), float(m.owed), int(g["timestamp_ns"].max())))

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store, which comes with Spark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def observer_stream(paths: DataFrame) -> DataFrame:
    """``structure.observer`` of a stream of ``paths`` rows that come in order of time from one micro-batch to
    the next (in any order within one).

    A row at or before the last one observed of its series gives nothing: a repeated delivery is harmless, and a
    late row can't be put in without changing what was said. Call ``prepare`` once before.
    """
    rows = paths.select(*SERIES, "timestamp_ns", *AXES, "path_length", "ready")
    return without_nan(rows.groupBy(*SERIES).transformWithStateInPandas(_Observe(), OBSERVED_ROW, "append", "none"))

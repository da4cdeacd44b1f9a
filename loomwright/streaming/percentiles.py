"""Percentiles over the last samples of each label, kept in the state of a stream."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW = 1000
QUANTILES = (0.5, 0.95, 0.99)
#: The state of these streams is in RocksDB: set spark.sql.streaming.stateStore.providerClass to it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastSamples(StatefulProcessor):
    """Holds a label's last samples, oldest first, as a list state; a row out for each row in."""

    def __init__(self, label: str, order: list[str], value: str, window: int, quantiles: tuple[float, ...]) -> None:
        self.label, self.order, self.value, self.window, self.quantiles = label, order, value, window, quantiles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = deque(v for (v,) in self.samples.get())
        ranked = sorted(held)
        x = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for v in x[self.value]:
            if not pd.isna(v):
                held.append(v)
                insort(ranked, v)
                if len(held) > self.window:
                    ranked.pop(bisect_left(ranked, held.popleft()))
            n = len(ranked)
            out.append((n, *[ranked[int(q * (n - 1))] if n else None for q in self.quantiles]))
        self.samples.put([(float(v),) for v in held])
        told = pd.DataFrame(out, columns=["samples", *names(self.quantiles)])
        for c in self.order[::-1]:
            told.insert(0, c, x[c].to_numpy())
        told.insert(0, self.label, key[0])
        yield told

    def close(self) -> None:
        pass


def names(quantiles: tuple[float, ...]) -> list[str]:
    return [f"p{round(q * 100):02d}" for q in quantiles]


def percentiles(events: DataFrame, label: str, value: str, order: list[str], window: int = WINDOW, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(label, order.., samples, p..) of each row of a stream: percentiles of the last `window` samples of its label, itself included.

    A percentile is the sample at place int(q * (n - 1)) of the n sorted ones, as `evaluation.rolling_percentile` has it.
    Rows of a micro-batch are taken by `order`; those of later ones come after, however old. A null sample counts as
    none. The state holds `window` numbers a label at most.
    """
    kinds = T.StructType([events.schema[label], *[events.schema[c] for c in order], T.StructField("samples", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names(quantiles)]])
    x = events.select(label, *order, F.col(value).cast("double").alias(value))
    return x.groupBy(label).transformWithStateInPandas(statefulProcessor=LastSamples(label, order, value, window, quantiles), outputStructType=kinds, outputMode="Append", timeMode="None")

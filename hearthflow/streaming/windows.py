"""Windows of the last rows of a key on a stream, from a ring of rows in the state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import micros
from ..operators.timeline import anomalies
from .processors import AT, in_order, late_rows, sorted_by_key

#: Rows whose windows are worked out at once.
PORTION = 20_000


def history_summary(name: str, windows: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, least and largest of each row of values; NaN stands for no value."""
    some = ~np.isnan(windows)
    n = some.sum(axis=1)
    total = np.where(some, windows, 0.0).sum(axis=1)
    none = n == 0
    with np.errstate(invalid="ignore", divide="ignore"):
        out = {
            f"{name}_mean": total / n,
            f"{name}_min": np.where(some, windows, np.inf).min(axis=1),
            f"{name}_max": np.where(some, windows, -np.inf).max(axis=1),
        }
    return {k: np.where(none, np.nan, v) for k, v in out.items()}


def spread_summary(name: str, windows: np.ndarray) -> dict[str, np.ndarray]:
    """Mean and sample deviation of each row of values, from the values themselves: nothing is
    carried from row to row, so errors do not add up however long a stream runs."""
    some = ~np.isnan(windows)
    n = some.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(some, windows, 0.0).sum(axis=1) / n
        apart = np.where(some, windows - mean[:, None], 0.0)
        std = np.sqrt((apart * apart).sum(axis=1) / (n - 1))
    return {f"{name}_mean": mean, f"{name}_std": np.where(n > 1, std, np.nan)}


class RingProcessor(StatefulProcessor):
    """Summaries of the last `rows` rows of a key, this one included.

    Rows come in time order (see `processors.sorted_by_key`); a portion of them is held at a time.
    The state is a list of at most rows - 1 rows of the channels' values, oldest first, and the
    newest time. Rows that are late (see `processors.late_rows`) are passed on and marked.
    """

    def __init__(
        self,
        rows: int,
        channels: Sequence[str],
        order: Sequence[str],
        summary: Callable[[str, np.ndarray], dict[str, np.ndarray]],
        names: Sequence[str],
    ):
        self.rows, self.channels, self.order = rows, list(channels), list(order)
        self.summary, self.names = summary, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        ring = T.StructType([T.StructField(c, T.DoubleType()) for c in self.channels])
        self.ring = handle.getListState("ring", ring)
        self.newest = handle.getValueState("newest", "newest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        known = newest = self.newest.get()[0] if self.newest.exists() else None
        before = np.array([tuple(r) for r in self.ring.get()], dtype=float)
        before = before.reshape(-1, len(self.channels))
        for arrived in rows:
            late = late_rows(arrived, key, known)
            fresh = arrived[~late]
            if len(fresh):
                newest = int(in_order(fresh, newest)[-1])
                values = np.concatenate([before, fresh[self.channels].to_numpy(dtype=float)])
                for lo in range(0, len(fresh), PORTION):
                    part = fresh.iloc[lo : lo + PORTION]
                    yield part.assign(**self._summed(values, len(before) + lo, len(part)), late=False)
                before = values[max(0, len(values) - (self.rows - 1)) :]
            if late.any():
                yield arrived[late].assign(**{n: None for n in self.names}, late=True)
        if newest is not None:
            if len(before):
                self.ring.put([tuple(float(x) for x in r) for r in before])
            self.newest.update((newest,))

    def _summed(self, values: np.ndarray, at: int, n: int) -> dict[str, np.ndarray]:
        """The summaries of the windows that end at n rows from place `at` on."""
        begin = max(0, at - self.rows + 1)
        lacking = self.rows - 1 - (at - begin)
        out = {"history_rows": np.minimum(np.arange(at, at + n) + 1, self.rows)}
        for i, c in enumerate(self.channels):
            column = np.concatenate([np.full(lacking, np.nan), values[begin : at + n, i]])
            out |= self.summary(c, np.lib.stride_tricks.sliding_window_view(column, self.rows))
        return {k: v for k, v in out.items() if k in self.names}

    def close(self) -> None:
        pass


def _ring(df, rows, channels, key, order, summary, names) -> DataFrame:
    counted = [n for n in names if n == "history_rows"]
    schema = T.StructType(
        [
            *df.schema, T.StructField(AT, T.LongType()),
            *[T.StructField(n, T.LongType() if n in counted else T.DoubleType()) for n in names],
            T.StructField("late", T.BooleanType()),
        ]
    )
    timed = sorted_by_key(df.withColumn(AT, micros("event_time")), key, order)
    out = timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=RingProcessor(rows, channels, order, summary, names),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )
    # pandas has one mark for missing numbers
    return out.withColumns({n: F.nanvl(n, F.lit(None)) for n in names if n not in counted}).drop(AT)


def history(
    df: DataFrame,
    rows: int = 50,
    key: str = "device_id",
    channels: Sequence[str] = ("temperature", "gas_raw"),
    order: Sequence[str] = ("event_time", "reading_id"),
) -> DataFrame:
    """Streaming twin of timeline.history, plus `late`."""
    names = ["history_rows", *[f"{c}_{s}" for c in channels for s in ("mean", "min", "max")]]
    return _ring(df, rows, channels, key, order, history_summary, names)


def rolling_features(
    df: DataFrame,
    rows: int = 50,
    z: float = 3.0,
    key: str = "device_id",
    channels: Sequence[str] = ("temperature", "gas_raw", "flame_raw", "humidity"),
    order: Sequence[str] = ("event_time", "reading_id"),
) -> DataFrame:
    """Streaming twin of timeline.rolling_features, plus `late`."""
    names = [f"{c}_{s}" for c in channels for s in ("mean", "std")]
    return anomalies(_ring(df, rows, channels, key, order, spread_summary, names), channels, z)

"""Stateful streaming: the batch walks, kept per key in the state store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import micros
from ..operators.alerts import level
from ..operators.folds import AlertWalk, RoomBaselineWalk, Walk
from ..operators.normalise import baseline_inputs
from ..operators.rules import fusion_verdict

AT = "at_us"


def late_rows(arrived: pd.DataFrame, key, newest: int | None) -> pd.Series:
    """Rows that must not touch the state: without a time or a key, or older than what it has."""
    late = arrived[AT].isna() | (key[0] is None)
    if newest is not None:
        late |= arrived[AT] < newest
    return late


def sorted_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of a stream by key, each key's in order, so that a processor may take them portion by portion.

    Spark sorts, and spills to disk what does not fit. Grouping on the same key adds no exchange and no
    sort of its own after that. Spark refuses any sort on a stream, as a table that grows has no
    order; here only the rows of one micro-batch are sorted, so the refusal is switched off."""
    df.sparkSession.conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")
    return df.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order])


def in_order(fresh: pd.DataFrame, newest: int | None, at: str = AT) -> np.ndarray:
    """Times of the rows; an error if they are not sorted, or older than those before them."""
    times = fresh[at].to_numpy(dtype="int64")
    if (np.diff(times, prepend=times[0] if newest is None else newest) < 0).any():
        raise RuntimeError("the rows of a key came out of order; sort the stream with sorted_by_key")
    return times


class WalkProcessor(StatefulProcessor):
    """Runs a Walk over the rows of a micro-batch, which come in time order (see `sorted_by_key`). No
    more than a portion of them is held at a time.

    Rows older than the newest one already applied, rows without a time and rows without a key
    are passed on with `late` set and leave the state alone, so no row is lost. A key that was
    silent for longer than `forget_ms` (in event time) starts anew.
    """

    def __init__(
        self,
        walk: Walk,
        forget_ms: int | None = None,
        keep_ms: int | None = None,
    ):
        self.walk = walk
        self.forget_ms, self.keep_ms = forget_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType(
            [T.StructField(n, T.DoubleType()) for n in self.walk.state_names]
            + [T.StructField("newest", T.LongType())]
        )
        self.handle = handle
        self.state = handle.getValueState("walk", schema, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        stored = self.state.get() if self.state.exists() else None
        start = self.walk.start
        state, known = start, None
        if stored is not None:
            state = tuple(type(s)(x) for s, x in zip(start, stored[:-1]))
            known = stored[-1]
        newest = known
        for arrived in rows:
            late = late_rows(arrived, key, known)
            fresh = arrived[~late]
            if len(fresh):
                at = in_order(fresh, newest)
                columns = [fresh[c].tolist() for c in self.walk.inputs]
                cuts = [0, *self._silences(at, newest), len(fresh)]
                done = []
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo or len(cuts) > 2 and cuts[1] == 0:
                        state = start
                    if lo < hi:
                        state, _, out = self.walk.walk(state, [c[lo:hi] for c in columns])
                        done.append(out)
                newest = int(at[-1])
                self.state.update((*[float(x) for x in state], newest))
                joined = [[x for part in parts for x in part] for parts in zip(*done)]
                yield fresh.assign(**dict(zip(self.walk.outputs, joined)), late=False)
            if late.any():
                yield arrived[late].assign(**{n: None for n in self.walk.outputs}, late=True)

    def _silences(self, at: np.ndarray, newest: int | None) -> list[int]:
        """Places of the rows before which the key was silent for too long."""
        if not self.forget_ms:
            return []
        before = at[0] if newest is None else newest
        return np.flatnonzero(np.diff(at, prepend=before) > self.forget_ms * 1000).tolist()

    def close(self) -> None:
        pass


def walk_stream(
    df: DataFrame,
    walk: Walk,
    key: str,
    order: Sequence[str] = ("event_time", "reading_id"),
    forget_ms: int | None = None,
    keep_ms: int | None = None,
) -> DataFrame:
    """Input columns, the walk's outputs and `late`; needs the `at_us` column.

    `forget_ms` is a matter of results: a key that was silent for longer, in event time, starts
    anew. `keep_ms` is a matter of storage: the state of a key is dropped once nothing has
    arrived for that long by the clock; it should be longer than any outage. There is no
    watermark, so neither drops rows.
    """
    schema = T.StructType(
        [
            *df.schema,
            *[T.StructField(n, t) for n, t in walk.outputs.items()],
            T.StructField("late", T.BooleanType()),
        ]
    )
    return sorted_by_key(df, key, order).groupBy(key).transformWithStateInPandas(
        statefulProcessor=WalkProcessor(walk, forget_ms, keep_ms),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime" if keep_ms else "None",
    )


def room_baseline(
    df: DataFrame, alpha: float = 0.01, key: str = "room_id", forget_ms: int | None = None
) -> DataFrame:
    """Streaming twin of plans.calibrate.classify, plus `late`."""
    filled = baseline_inputs(df).withColumn(AT, micros("event_time"))
    walked = walk_stream(filled, RoomBaselineWalk(alpha), key, forget_ms=forget_ms)
    return fusion_verdict(walked).drop(AT)


def alert_state(
    df: DataFrame, reminder: float = 60.0, state: str = "fire_state", key: str = "device_id"
) -> DataFrame:
    """Streaming twin of alerts.rate_limit, plus `late`."""
    leveled = df.withColumns({AT: micros("event_time"), "alert_level": level(state)})
    out = walk_stream(leveled, AlertWalk(reminder), key).drop(AT, "alert_level")
    return out.withColumn("should_alert", F.col("alert_kind").isNotNull())


class WatchdogProcessor(StatefulProcessor):
    """Emits a row for each time that a key stays silent for longer than the timeout (event
    time): as soon as the next packet shows it, else when the watermark passes its end."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        known = newest = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            times = pdf["at_ms"].dropna().to_numpy()
            if known is not None:
                times = times[times > known]
            if not len(times):
                continue
            in_order(pd.DataFrame({"at_ms": times}), newest, "at_ms")
            if newest is not None:
                times = np.concatenate([[newest], times])
            newest = int(times[-1])
            since = times[:-1][np.diff(times) > self.timeout_ms].astype("int64")
            if len(since):
                yield pd.DataFrame({"device": key[0], "silent_since_ms": since})
        if newest != known:
            if known is not None:
                self.handle.deleteTimer(known + self.timeout_ms + 1)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.timeout_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        since = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"device": [key[0]], "silent_since_ms": [since]})

    def close(self) -> None:
        pass


def watchdog(
    df: DataFrame, timeout_ms: int = 1500, watermark: str = "30 seconds", key: str = "device_id"
) -> DataFrame:
    """(device, silent_since_ms) of every silence longer than the timeout."""
    dated = df.filter(F.col("event_time").isNotNull() & F.col(key).isNotNull())
    timed = dated.select(key, "event_time", F.unix_millis("event_time").alias("at_ms"))
    timed = timed.withWatermark("event_time", watermark)
    return sorted_by_key(timed, key, ["at_ms"]).groupBy(key).transformWithStateInPandas(
        statefulProcessor=WatchdogProcessor(timeout_ms),
        outputStructType="device string, silent_since_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )

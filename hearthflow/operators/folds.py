"""Sequential state per key: small step functions, one driver for batch and stream.

A `Walk` turns (state, rows in order) into (state, output columns). State is a flat
tuple of numbers. The same `walk` runs over sorted Arrow batches in a batch job and
over one micro-batch at a time in a streaming query, so both give the same rows.

Keys that fit one task are walked from start to end in one pass. For a key cut into
chunks (see `series`), every chunk is walked at once from an assumed start state, and
each reports its end state together with how strongly that end moves with the start.
From these the true starts are worked out, chunks whose start changed are walked again,
and so on until no start changes; the last pass then emits the rows. The first chunk's
start is always right, so the loop ends after at most one round per chunk; it usually
needs two or three, because old state fades out. Alerts, whose state need not fade, have
their starts from `reminders` instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reminders import alert_starts
from .rules import (
    FIRE_GAS_Z,
    FIRE_RATE,
    FIRE_RISE,
    FLAME_VOLTS,
    PRE_FIRE_GAS_Z,
    PRE_FIRE_RATE,
    PRE_FIRE_RISE,
)
from .series import CHUNK, Series

SEED = "seed"
ROWS_PER_TASK = 2_000_000


class Walk:
    """One sequential step. Subclasses set the fields and define `walk`."""

    inputs: tuple[str, ...] = ()
    outputs: dict[str, T.DataType] = {}
    state_names: tuple[str, ...] = ()
    start: tuple[float, ...] = ()

    def walk(
        self, state: tuple, columns: Sequence[list]
    ) -> tuple[tuple, tuple, tuple[list, ...]]:
        """Return (end state, gain per state field, output columns).

        The gain is how much the end value changes per unit of change in the start
        value, for the decisions taken on these rows; 0 when the rows decide it alone.
        """
        raise NotImplementedError

    def starts(self, series: Series) -> dict:
        """True start state of every (key, chunk) of a chunked series."""
        return chunk_starts(series, self)


class RoomBaselineWalk(Walk):
    """Adaptive room baseline that stops learning while a fire or pre-fire is seen."""

    inputs = ("at_us", "temperature", "humidity", "gas_raw", "flame_voltage", "flame_digital")
    outputs = {
        "seen": T.LongType(),
        "gap_seconds": T.DoubleType(),
        "temp_rate": T.DoubleType(),
        "gas_rate": T.DoubleType(),
        "flame_rate": T.DoubleType(),
        "temp_mean_before": T.DoubleType(),
        "temp_std_before": T.DoubleType(),
        "humidity_mean_before": T.DoubleType(),
        "gas_mean_before": T.DoubleType(),
        "gas_std_before": T.DoubleType(),
        "temp_mean": T.DoubleType(),
        "humidity_mean": T.DoubleType(),
        "gas_mean": T.DoubleType(),
        "pressure_mean": T.DoubleType(),
        "flame_mean": T.DoubleType(),
    }
    state_names = (
        "seen", "temp_mean", "temp_var", "temp_std", "humidity_mean", "pressure_mean",
        "gas_mean", "gas_var", "gas_std", "flame_mean", "last_at", "last_temp", "last_gas",
        "last_flame",
    )
    # The profile a room has before its first reading.
    start = (0, 25.0, 1.0, 1.0, 50.0, 1013.0, 1500.0, 100.0, 10.0, 3.0, 0, 0.0, 0.0, 0.0)

    def __init__(self, alpha=0.01, temp_floor=0.3, gas_floor=15.0, gap=(0.1, 30.0)):
        self.inputs = (*RoomBaselineWalk.inputs, "pressure")
        self.alpha, self.temp_floor, self.gas_floor, self.gap = alpha, temp_floor, gas_floor, gap

    def walk(self, state, columns):
        (n, tm, tv, ts, hm, pm, gm, gv, gs, fm, at0, t0, g0, f0) = state
        size = len(columns[0])
        # What needs only the previous reading is worked out for all rows at once.
        at, temp, humidity, gas, flame_v, lit, pressure = (np.asarray(c) for c in columns)
        low, high = self.gap
        passed = np.diff(at, prepend=at0 if n else at[0]) / 1e6
        gap = np.where((passed >= low) & (passed <= high), passed, 1.0)
        t_rate = np.diff(temp, prepend=t0 if n else temp[0]) / gap
        g_rate = np.diff(gas, prepend=g0 if n else gas[0]) / gap
        f_rate = np.diff(flame_v, prepend=f0 if n else flame_v[0]) / gap
        flame = ((lit == 1) | (flame_v < FLAME_VOLTS)).tolist()

        alpha, keep = self.alpha, 1.0 - self.alpha
        temp_floor, gas_floor, sqrt = self.temp_floor, self.gas_floor, math.sqrt
        before = (tm, ts, hm, gm, gs)
        rows, learned, first = [], 0, 0
        _, temps, humids, gases, flames, _, pressures = columns
        if not n:
            tm, hm, pm, gm, fm = temps[0], humids[0], pressures[0], gases[0], flames[0]
            rows.append((tm, ts, hm, gm, gs, pm, fm))
            first = 1
        steps = zip(
            temps[first:], humids[first:], gases[first:], flames[first:], pressures[first:],
            flame[first:], t_rate[first:].tolist(),
        )
        for t, h, g, f, p, burning, rate in steps:
            dt = t - tm
            dg = g - gm
            gz = dg / gs
            # The profile holds still while rules.fusion_verdict sees a fire or pre-fire. The
            # calmer verdicts it tests in between need a lower gas score or a smaller rise.
            if not (
                burning
                or (gz > PRE_FIRE_GAS_Z and (dt > PRE_FIRE_RISE or rate > PRE_FIRE_RATE))
                or (rate > FIRE_RATE and dt > FIRE_RISE and gz > FIRE_GAS_Z)
            ):
                learned += 1
                tm += alpha * dt
                tv = keep * tv + alpha * (dt * dt)
                ts = sqrt(tv)
                if ts < temp_floor:
                    ts = temp_floor
                hm = keep * hm + alpha * h
                pm = keep * pm + alpha * p
                gm += alpha * dg
                gv = keep * gv + alpha * (dg * dg)
                gs = sqrt(gv)
                if gs < gas_floor:
                    gs = gas_floor
                fm = keep * fm + alpha * f
            rows.append((tm, ts, hm, gm, gs, pm, fm))

        after = np.array(rows).T
        out = (
            np.arange(n + 1, n + size + 1),
            gap, t_rate, g_rate, f_rate,
            *(np.concatenate(([b], a[:-1])) for b, a in zip(before, after)),
            after[0], after[2], after[3], after[5], after[6],
        )
        fade = keep**learned
        mean = 0.0 if first else fade
        still = 0.0 if learned else 1.0
        gains = (1, mean, fade, still, mean, mean, mean, fade, still, mean, 0, 0, 0, 0)
        end = (n + size, tm, tv, ts, hm, pm, gm, gv, gs, fm,
               columns[0][-1], temps[-1], gases[-1], flames[-1])
        return end, gains, out


class EdgeThermalWalk(Walk):
    """Fast temperature average, its rate per minute, and a slow average of calm times."""

    inputs = ("at_us", "temperature")
    outputs = {
        "ema": T.DoubleType(),
        "rate_per_min": T.DoubleType(),
        "slow_baseline": T.DoubleType(),
    }
    state_names = ("seen", "ema", "slow_baseline", "last_at")
    start = (0, 0.0, 0.0, 0)

    def __init__(self, fast=0.25, slow=0.02, warn_temp=40.0, warn_rate=3.0):
        self.fast, self.slow, self.warn_temp, self.warn_rate = fast, slow, warn_temp, warn_rate

    def walk(self, state, columns):
        seen, ema, base, at0 = state
        fast, slow = self.fast, self.slow
        seeded, rows, calm = False, 0, 0
        out = ([], [], [])
        for at, t in zip(*columns):
            if not seen:
                seen, ema, base, at0, seeded = 1, t, t, at, True
            was = ema
            ema = fast * t + (1.0 - fast) * ema
            elapsed = (at - at0) / 1000.0
            rate = (ema - was) * 60000.0 / elapsed if elapsed > 0 else 0.0
            if ema < self.warn_temp and rate < self.warn_rate:
                base = slow * ema + (1.0 - slow) * base
                calm += 1
            at0 = at
            rows += 1
            out[0].append(ema)
            out[1].append(rate)
            out[2].append(base)
        gain = (0.0, 0.0) if seeded else ((1.0 - fast) ** rows, (1.0 - slow) ** calm)
        return (seen, ema, base, at0), (0, *gain, 0), out


class PersistenceWalk(Walk):
    """Counter of hits against misses, kept between 0 and the cap."""

    inputs = ("flame_hit",)
    outputs = {"persistence": T.IntegerType()}
    state_names = ("count",)
    start = (0,)

    def __init__(self, cap=255):
        self.cap = cap

    def walk(self, state, columns):
        (count,) = state
        cap, free, out = self.cap, 1, []
        for hit in columns[0]:
            if hit:
                if count < cap:
                    count += 1
                else:
                    free = 0
            elif count > 0:
                count -= 1
            else:
                free = 0
            out.append(count)
        return (count,), (free,), (out,)


class AlertWalk(Walk):
    """Alert on a change into danger, every `reminder` seconds of it, and on all-clear."""

    inputs = ("at_us", "alert_level")
    outputs = {"alert_kind": T.StringType()}
    state_names = ("last_level", "last_alert_at")
    start = (0, 0)

    def __init__(self, reminder=60.0):
        self.wait = int(reminder * 1_000_000)

    def walk(self, state, columns):
        last, alerted_at = state
        quiet, out = 1, []
        for at, level in zip(*columns):
            kind = None
            if level >= 2:
                if level != last:
                    kind = "TRANSITION"
                elif at - alerted_at >= self.wait:
                    kind = "REMINDER"
            elif level == 0 and last >= 2:
                kind = "ALL_CLEAR"
            if kind:
                alerted_at, quiet = at, 0
            if level < 2:
                # Entering danger alerts at once, so the last alert no longer matters.
                alerted_at, quiet = 0, 0
            last = level
            out.append(kind)
        return (last, alerted_at), (0, quiet), (out,)

    def starts(self, series):
        return alert_starts(series, self.wait)


# ---------------------------------------------------------------------------
# driver


def _segments(batch: pa.RecordBatch, key: Sequence[str]) -> list[tuple[int, int]]:
    """Row ranges of equal key in a batch sorted by key."""
    size = batch.num_rows
    change = np.zeros(max(size - 1, 0), dtype=bool)
    for name in key:
        values = batch.column(batch.schema.get_field_index(name))
        differs = pc.fill_null(pc.not_equal(values[1:], values[:-1]), False)
        nulls = pc.not_equal(pc.is_null(values[1:]), pc.is_null(values[:-1]))
        change |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), size]
    return list(zip(cuts[:-1], cuts[1:]))


def _walk_batches(batches, walk: Walk, key, chunk_starts=None):
    """Yield (batch, key values, chunk, start, end state, gains, outputs) per key range."""
    current, state = object(), walk.start
    for batch in batches:
        if not batch.num_rows:
            continue
        index = [batch.schema.get_field_index(k) for k in key]
        chunk_at = batch.schema.get_field_index(CHUNK) if chunk_starts is not None else -1
        columns = [
            batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).tolist()
            for c in walk.inputs
        ]
        seed_at = batch.schema.get_field_index(SEED)
        for begin, end in _segments(batch, key):
            group = tuple(batch.column(i)[begin].as_py() for i in index)
            chunk = batch.column(chunk_at)[begin].as_py() if chunk_starts is not None else None
            fresh = group != current
            if fresh:
                current = group
                state = walk.start
                if chunk_starts is not None:
                    known = chunk_starts.get((group, chunk), walk.start)
                    state = _as_state(walk, known)
            seed = batch.column(seed_at)[begin].as_py() if seed_at >= 0 else None
            if seed is not None:
                # A saved state comes before the readings of its key and has no output.
                state = _as_state(walk, seed)
                blank = tuple([None] for _ in walk.outputs)
                none = tuple(0 for _ in walk.start)
                yield batch, begin, begin + 1, group, chunk, fresh, state, none, blank
                begin, fresh = begin + 1, False
            if begin < end:
                state, gains, out = walk.walk(state, [c[begin:end] for c in columns])
                yield batch, begin, end, group, chunk, fresh, state, gains, out


def _as_state(walk: Walk, values: Sequence[float]) -> tuple:
    return tuple(type(s)(x) for s, x in zip(walk.start, values))


def _emit_rows(walk: Walk, key, chunk_starts=None):
    names, kinds = list(walk.outputs), [_arrow(t) for t in walk.outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        for batch, _, end, *_, out in _walk_batches(batches, walk, key, chunk_starts):
            for column, values, kind in zip(held, out, kinds):
                column.append(pa.array(values, type=kind))
            if end == batch.num_rows:
                arrays = [pa.concat_arrays(column) for column in held]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *arrays], [*batch.schema.names, *names]
                )
                held = [[] for _ in names]

    return run


def _emit_ends(walk: Walk, key, chunk_starts):
    """One row per (key, chunk): its end state and total gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, tag, state, gain, kinds = [], None, None, None, None
        for batch, _, _, group, chunk, fresh, end_state, gains, _ in _walk_batches(
            batches, walk, key, chunk_starts
        ):
            kinds = [batch.schema.field(k).type for k in key]
            if fresh and tag is not None:
                done.append((*tag, state, gain))
            if fresh:
                tag, gain = (group, chunk), gains
            else:
                gain = tuple(a * b for a, b in zip(gain, gains))
            state = end_state
        if tag is not None:
            done.append((*tag, state, gain))
        if done:
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([d[0][i] for d in done], k) for i, k in enumerate(kinds)],
                    pa.array([d[1] for d in done], pa.int32()),
                    pa.array([[float(x) for x in d[2]] for d in done], pa.list_(pa.float64())),
                    pa.array([[float(x) for x in d[3]] for d in done], pa.list_(pa.float64())),
                ],
                [*key, CHUNK, "state", "gain"],
            )

    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    return {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.StringType(): pa.string(),
    }[kind]


def _same(a: tuple, b: tuple) -> bool:
    """Equal to the last bit, so that a split key gives what the whole key gives."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _ends_schema(series: Series) -> T.StructType:
    return T.StructType(
        [f for f in series.df.schema if f.name in series.key]
        + [
            T.StructField(CHUNK, T.IntegerType()),
            T.StructField("state", T.ArrayType(T.DoubleType())),
            T.StructField("gain", T.ArrayType(T.DoubleType())),
        ]
    )


def _narrow(series: Series, walk: Walk) -> DataFrame:
    extra = [c for c in (CHUNK, SEED) if c in series.df.columns]
    keep = [*series.key, *extra, *walk.inputs]
    if not series.chunked:
        keep += [c for c in series.order if c not in keep]
    return series.df.select(*keep)


def chunk_starts(series: Series, walk: Walk) -> dict:
    """True start state of every (key, chunk) of a chunked series.

    Only one short record per chunk reaches the driver: at most
    rows / max_rows chunks plus one per large key.
    """
    df, schema = _narrow(series, walk), _ends_schema(series)
    starts: dict = {}
    ends: dict = {}
    todo = df
    while True:
        run = _emit_ends(walk, series.key, dict(starts))
        for row in todo.mapInArrow(run, schema).collect():
            group = tuple(row[k] for k in series.key)
            ends[group, row[CHUNK]] = (tuple(row["state"]), tuple(row["gain"]))
        changed = set()
        last_group, start = None, None
        for group, chunk in sorted(ends, key=lambda e: (str(e[0]), e[1])):
            if group != last_group:
                start = tuple(float(x) for x in walk.start)
            used = tuple(float(x) for x in starts.get((group, chunk), walk.start))
            end, gain = ends[group, chunk]
            if not _same(start, used):
                changed.add(chunk)
                end = tuple(e + k * (s - u) for e, k, s, u in zip(end, gain, start, used))
            starts[group, chunk] = start
            last_group, start = group, end
        if not changed:
            return starts
        todo = df.filter(F.col(CHUNK).isin(*sorted(changed)))


def _ordered(series: Series, df: DataFrame) -> DataFrame:
    """Whole keys, each in order within one partition."""
    spark = df.sparkSession
    parts = max(
        spark.sparkContext.defaultParallelism, math.ceil(series.total_rows / ROWS_PER_TASK)
    )
    return df.repartition(parts, *series.key).sortWithinPartitions(*series.key, *series.order)


def walk_series(series: Series, walk: Walk) -> DataFrame:
    """Input columns plus the walk's outputs."""
    schema = T.StructType(
        [*series.df.schema, *[T.StructField(n, t) for n, t in walk.outputs.items()]]
    )
    if series.chunked:
        starts = walk.starts(series)
        return series.df.mapInArrow(_emit_rows(walk, series.key, starts), schema)
    return _ordered(series, series.df).mapInArrow(_emit_rows(walk, series.key), schema)


def final_states(series: Series, walk: Walk) -> DataFrame:
    """One row per key: the state after its last row, a column per state field."""
    df = _narrow(series, walk)
    if series.chunked:
        starts = walk.starts(series)
        ends = df.mapInArrow(_emit_ends(walk, series.key, starts), _ends_schema(series))
        ends = ends.groupBy(*series.key).agg(F.max_by("state", CHUNK).alias("state"))
    else:
        ends = _ordered(series, df).mapInArrow(
            _emit_ends(walk, series.key, None), _ends_schema(series)
        )
    return ends.select(
        *series.key,
        *[F.get("state", F.lit(i)).alias(n) for i, n in enumerate(walk.state_names)],
        # Keeps the shape of the chunked and the plain part alike.
        F.lit(0).alias(CHUNK),
    )

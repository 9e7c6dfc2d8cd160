"""Ordered work per key that stays spread out when one key holds much of the data.

Most keys fit one task, and an ordinary window over the key is the best plan for
them. A key with more than `max_rows` rows would make one task do all of its work,
so its rows are cut by Spark's range partitioner into consecutive chunks of about
`max_rows` rows, ordered like the key itself. A step written against `Series` runs
on both kinds:

* `bounded` - frames that reach a fixed number of rows back or ahead. Each chunk
  borrows just those rows from its neighbours.
* `running` - frames from the start of the key. Each chunk works on its own rows and
  then adds what the chunks before it came to.
* `folds.walk_series` - truly sequential state, see that module.

Nothing is sampled, capped or dropped; chunk numbers are fixed by a checkpoint before
they are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import ready_to_checkpoint

CHUNK = "_chunk"
BORROWED = "_borrowed"
MAX_ROWS_CONF = "hearthflow.series.maxRowsPerTask"
MAX_ROWS = 10_000_000


@dataclass(frozen=True)
class Series:
    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    total_rows: int
    chunked: bool = False

    @property
    def parts(self) -> list[str]:
        return [*self.key, CHUNK] if self.chunked else list(self.key)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> "Series":
        # A chunked step reads its input twice, so its result is written down between steps.
        return replace(self, df=df.checkpoint() if self.chunked else df)

    def bounded(
        self,
        build: Callable[[DataFrame, WindowSpec], DataFrame],
        before: int = 0,
        after: int = 0,
    ) -> "Series":
        """Apply `build(df, window)`, whose frames reach at most `before`/`after` rows away."""
        if not self.chunked:
            return self.with_df(build(self.df, self.window))
        body = self.df.withColumn(BORROWED, F.lit(False))
        pieces = [body]
        if before:
            pieces.append(self._neighbours(before, forward=True))
        if after:
            pieces.append(self._neighbours(after, forward=False))
        joined = reduce(DataFrame.unionByName, pieces)
        done = build(joined, self.window).filter(~F.col(BORROWED)).drop(BORROWED)
        return self.with_df(done)

    def _neighbours(self, count: int, forward: bool) -> DataFrame:
        """Per chunk, the `count` rows of the same key just before it (after it if not forward)."""
        names = self.df.columns
        toward = [F.asc(c) if forward else F.desc(c) for c in self.order]
        away = [F.desc(c) if forward else F.asc(c) for c in self.order]
        edge = (
            self.df.withColumn(
                "_n", F.row_number().over(Window.partitionBy(*self.parts).orderBy(*away))
            )
            .filter(F.col("_n") <= count)
            .drop("_n")
        )
        along = Window.partitionBy(*self.key).orderBy(*toward)
        first_of_chunk = F.lag(CHUNK).over(along) != F.col(CHUNK)
        return (
            edge.withColumn("_first", first_of_chunk)
            .withColumn(
                "_near",
                F.collect_list(F.struct(*names)).over(along.rowsBetween(-count, -1)),
            )
            .filter("_first")
            .select(F.col(CHUNK).alias("_target"), F.explode("_near").alias("_row"))
            .select("_target", "_row.*")
            .withColumn(CHUNK, F.col("_target"))
            .drop("_target")
            .withColumn(BORROWED, F.lit(True))
        )

    def running(self, **specs: tuple[str, Column]) -> "Series":
        """Add columns that summarise the key up to each row: (kind, value), kind is
        one of sum, min, max, last (last non-null)."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self.df.select(
            "*", *[_over(kind, value, frame).alias(name) for name, (kind, value) in specs.items()]
        )
        if not self.chunked:
            return self.with_df(local)
        per_chunk = self.df.groupBy(*self.parts).agg(
            *[self._total(kind, value).alias(name) for name, (kind, value) in specs.items()]
        )
        earlier = (
            Window.partitionBy(*self.key)
            .orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = per_chunk.select(
            *self.parts,
            *[
                _over(kind, F.col(name), earlier).alias(f"_carry_{name}")
                for name, (kind, _) in specs.items()
            ],
        )
        joined = local.join(carried, self.parts, "left")
        done = joined.select(
            *self.df.columns,
            *[
                _combine(kind, F.col(name), F.col(f"_carry_{name}")).alias(name)
                for name, (kind, _) in specs.items()
            ],
        )
        return self.with_df(done)

    def _total(self, kind: str, value: Column) -> Column:
        if kind == "last":
            present = F.when(value.isNotNull(), F.struct(*self.order))
            return F.max_by(value, present)
        return getattr(F, kind)(value)


def _over(kind: str, value: Column, frame: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return getattr(F, kind)(value).over(frame)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def over_series(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    step: Callable[[Series], DataFrame],
    max_rows: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Run `step` over each key in order; keys above `max_rows` rows run in chunks.

    The sizes come from one grouped count of the key columns (of `sized_by` when `df` is
    costly and `sized_by` holds at least its rows). `order` must be unique within a key.
    """
    spark = df.sparkSession
    key = (key,) if isinstance(key, str) else tuple(key)
    order = tuple(order)
    if max_rows is None:
        max_rows = int(spark.conf.get(MAX_ROWS_CONF, str(MAX_ROWS)))
    sizes = (df if sized_by is None else sized_by).groupBy(*key).agg(F.count("*").alias("_rows"))
    overall = sizes.agg(F.sum("_rows").alias("total"), F.max("_rows").alias("largest")).first()
    total = overall["total"] or 0
    if (overall["largest"] or 0) <= max_rows:
        return step(Series(df, key, order, total))

    ready_to_checkpoint(spark)
    # At most total / max_rows keys can be this large, so the list is short by construction.
    large = sizes.filter(F.col("_rows") > max_rows).checkpoint()
    large_rows = large.agg(F.sum("_rows")).first()[0]
    match = reduce(
        lambda a, b: a & b, [F.col(f"all.{k}").eqNullSafe(F.col(f"big.{k}")) for k in key]
    )
    big = F.broadcast(large.alias("big"))
    rest = df.alias("all").join(big, match, "left_anti")
    split = (
        df.alias("all")
        .join(big, match, "left_semi")
        .repartitionByRange(math.ceil(large_rows / max_rows) + 1, *key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn(CHUNK, F.spark_partition_id())
        .checkpoint()
    )
    small = step(Series(rest, key, order, total - large_rows))
    chunks = step(Series(split, key, order, large_rows, chunked=True))
    return small.drop(CHUNK).unionByName(chunks.drop(CHUNK))

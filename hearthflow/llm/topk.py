"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are scaled and floored to integers. For a cut of the components into segments, a vector is
described by the mean and the deviation of each segment; with segments of length l,

    <q, x>  <=  sum over segments of  l * (mean_q * mean_x + dev_q * dev_x)

(equivalently a lower bound of the squared distance |q|^2 + |x|^2 - 2 <q, x>). The bound gets
tighter from one segment to many. A group of queries meets the vectors block by block: the
coarsest bound is taken for the whole block, pairs below the k-th best score so far are dropped,
the next resolution is taken for blocks where pairs are left, and the exact integer score is
worked out for the survivors only. The bound is raised by a slack above its rounding error, so no
pair is lost, and ties stay in.

The vectors are shuffled once, into portions of a bounded number of components, so that no task
grows with the table. Each portion meets every query (a stated query set against all rows, in
blocks): it holds its vectors with their statistics, the queries stream by in groups of a bounded
size, and each group gets the portion's own k best; a window takes the k best of those.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without id. Only vectors of equal length are compared. The query's own id is no candidate.
Repeated equal queries count once, repeated candidate rows each. Scaled components beyond 64 bits
saturate; scores must fit 64 bits. A query with fewer candidates returns all of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, offsets, spread, table

#: Queries that meet the vectors of a portion side by side.
GROUP = 512
#: Vectors whose bounds are taken side by side.
BLOCK = 2048
#: Components of the vectors of a portion, and the fewest portions.
PORTION = 1 << 22
LEAST_TASKS = 64
RESOLUTIONS = (1, 4, 16)


def integers(vector: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, null unless all components are finite."""
    usable = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & (F.size(vector) > 0)
    return F.when(
        usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    )


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to smaller ids."""
    usable = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), integers(vec_col).alias("v"), queries.alias("asks")
    ).where("id is not null and v is not null")
    usable = usable.withColumn("dim", F.size("v"))
    components = usable.agg(F.sum(F.col("dim").cast("bigint"))).first()[0] or 0
    portions = max(LEAST_TASKS, math.ceil(components / PORTION))
    asked = usable.where("asks").select("id", "v", "dim").distinct()
    held = usable.withColumn("row", F.monotonically_increasing_id())
    held = held.select("dim", spread("row", parts=portions).alias("s"), F.lit(0).alias("kind"), "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(portions - 1))).alias("s")
    met = held.unionByName(asked.select("dim", every, F.lit(1).alias("kind"), "id", "v"))
    met = met.repartition("dim", "s").sortWithinPartitions("dim", "s", "kind")
    best = map_batches(met, _search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search(k: int):
    def run(batches):
        portion, ids, rows, blocks = None, [], [], None

        def blocks_of_portion() -> list[Block]:
            held = np.concatenate(ids), np.concatenate(rows)
            cuts = range(0, len(held[0]), BLOCK)
            return [Block(*(part[at : at + BLOCK] for part in held)) for at in cuts]

        def answers():
            best = Best(np.concatenate(ids), np.concatenate(rows), k)
            for block in blocks:
                best.meet(block)
            return best.result()

        for key, these_ids, these in _stretches(batches):
            if key[:2] != portion:
                if blocks and ids:
                    yield answers()
                portion, ids, rows, blocks = key[:2], [], [], None
            if key[2] == 1 and blocks is None:  # the first queries after the vectors
                blocks = blocks_of_portion() if ids else []
                ids, rows = [], []
            if key[2] == 0:
                ids.append(these_ids)
                rows.append(these)
                continue
            for at in range(0, len(these_ids), GROUP):
                ids.append(these_ids[at : at + GROUP])
                rows.append(these[at : at + GROUP])
                if blocks and sum(map(len, ids)) >= GROUP:
                    yield answers()
                    ids, rows = [], []
            if not blocks:
                ids, rows = [], []  # no vectors of this length in the portion
        if blocks and ids:
            yield answers()

    return run


def _stretches(batches):
    """((dim, portion, kind), ids, vectors) of consecutive rows of one key."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        ids = batch.column(3).to_numpy(zero_copy_only=False)
        flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        at = offsets(keys[0])
        edges = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(ids)]):
            if lo < hi:
                yield tuple(keys[:, lo]), ids[lo:hi], flat[at[lo] : at[hi]].reshape(hi - lo, -1)


class Block:
    """Some vectors with their statistics at every resolution."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors.astype(np.int64)
        self.stats = [_described(self.x, n) for n in _resolutions(vectors.shape[1])]
        self.largest = float(np.abs(self.x.astype(float)).max())


class Best:
    """The best scores so far of a group of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries.astype(np.int64), k
        self.stats = [_described(self.q, n) for n in _resolutions(queries.shape[1])]
        self.top_ids = np.zeros((len(ids), k), dtype=np.int64)
        self.top = np.zeros((len(ids), k), dtype=np.int64)
        self.filled = np.zeros(len(ids), dtype=np.int64)

    def bar(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity where there are fewer."""
        return np.where(self.filled == self.k, self.top[:, -1].astype(np.float64), -np.inf)

    def meet(self, block: Block) -> None:
        ids, x = block.ids, block.x
        alive = self.ids[:, None] != ids[None, :]
        size = float(np.abs(self.q.astype(float)).max() * block.largest)
        slack = 1e-9 * x.shape[1] * max(size, 1.0)
        for mine, theirs in zip(self.stats, block.stats):
            bound = mine @ theirs.T + slack
            if np.any(self.filled < self.k):  # the first block: score the most promising
                likely = np.where(alive, bound, -np.inf)
                first = np.argsort(-likely, axis=1, kind="stable")[:, : self.k]
                chosen = np.zeros_like(alive)
                np.put_along_axis(chosen, first, True, axis=1)
                chosen &= alive
                self.score(ids, x, chosen, size)
                alive &= ~chosen
            alive &= bound >= self.bar()[:, None]
            if not alive.any():
                return
        self.score(ids, x, alive, size)

    def score(self, ids, x, chosen, size: float) -> None:
        """Exact scores of the chosen pairs, merged into the best."""
        if size * x.shape[1] < 2.0**53:
            a, b = self.q.astype(np.float64), x.astype(np.float64)
        else:
            a, b = self.q, x
        rows, cols = np.nonzero(chosen)
        if len(rows) * 4 > chosen.size:
            scores = (a @ b.T)[rows, cols].astype(np.int64)
        else:
            scores = np.concatenate(
                [np.zeros(0, dtype=np.int64)]
                + [
                    np.einsum("ij,ij->i", a[rows[i : i + 65536]], b[cols[i : i + 65536]]).astype(np.int64)
                    for i in range(0, len(rows), 65536)
                ]
            )
        old_rows, old_cols = np.nonzero(np.arange(self.k)[None, :] < self.filled[:, None])
        row = np.concatenate([old_rows, rows])
        score = np.concatenate([self.top[old_rows, old_cols], scores])
        who = np.concatenate([self.top_ids[old_rows, old_cols], ids[cols]])
        order = np.lexsort((who, -score, row))
        row, score, who = row[order], score[order], who[order]
        begins = np.searchsorted(row, np.arange(len(self.ids)))
        place = np.arange(len(row)) - begins[row]
        keep = place < self.k
        self.top[row[keep], place[keep]] = score[keep]
        self.top_ids[row[keep], place[keep]] = who[keep]
        self.filled = np.minimum(np.bincount(row, minlength=len(self.ids)), self.k)

    def result(self) -> dict:
        rows, cols = np.nonzero(np.arange(self.k)[None, :] < self.filled[:, None])
        return {
            "query_id": self.ids[rows],
            "vec_id": self.top_ids[rows, cols],
            "score": self.top[rows, cols],
        }


def _resolutions(dim: int) -> list[int]:
    return [n for n in RESOLUTIONS if n <= dim]


def _described(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that a product of two rows is the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    x = x.astype(np.float64)
    long = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / long
    rest = x - np.repeat(mean, long, axis=1)
    dev = np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1) / long)
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([long, long]))


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 256) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score,
    (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM (SELECT q.vec_id AS query_id, x.vec_id,
          list_inner_product(q.v, x.v)::BIGINT AS score
        FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id
          AND len(q.v) = len(x.v)))
WHERE rank <= 5"""

"""Word shingles, exact verification of buckets and connected components, shared by the
near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import map_batches

WIDTH = 5
THRESHOLD = 0.8
#: Rows of a bucket that are compared with one another in one piece of work.
BLOCK = 512
#: Columns of the incidence matrix held at once.
STRIP = 4096


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(
        map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)
    )


def shingles(hashed: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word runs; fewer words than the width are one run."""
    n = len(hashed)
    if n == 0:
        return hashed
    take = min(n, width)
    out = np.zeros(n - take + 1, dtype=np.uint64)
    for i in range(take):
        out = (out ^ hashed[i : n - take + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    if n < width:
        out ^= np.uint64(n)
    return np.unique(out)


def minhashes(sets: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """For each salt, the smallest hash of a non-empty set."""
    mixed = sets[None, :] ^ salts[:, None]
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(30)
    return mixed.min(axis=1)


def salts(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64)


def set_key(sets: np.ndarray) -> str:
    """128-bit hash of a set, equal for equal sets."""
    return xxhash.xxh3_128_hexdigest(sets.tobytes())


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct arrays."""
    if len(left) * len(right) <= 16:
        return np.array(
            [[np.intersect1d(a, b, assume_unique=True).size for b in right] for a in left]
        )
    every = np.concatenate(left + right)
    names, place, times = np.unique(every, return_inverse=True, return_counts=True)
    common = times > 1  # the others meet nothing
    renumber = np.cumsum(common) - 1
    of = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    keep = common[place]
    row, col = of[keep], renumber[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, int(common.sum()), STRIP):
        a, b = np.searchsorted(col, (lo, lo + STRIP))
        matrix = np.zeros((len(left) + len(right), STRIP), dtype=np.float32)
        matrix[row[a:b], col[a:b] - lo] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out.astype(np.int64)


def alike(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have at least that Jaccard similarity."""
    both = overlaps(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return both >= threshold * (sizes - both) - 1e-9


def blocked(members: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Members of buckets (column `n`: the bucket's size, `spot`: a stable number that spreads its
    members), dealt so that any two members of a bucket meet in exactly one piece of work
    (bucket, `bi`, `bj`); `side` tells on which side of a piece of two blocks a row stands.

    Buckets of at most `block` members are one piece. Larger ones are dealt into blocks, and each
    pair of blocks is one piece, so no task holds more than about two blocks of a bucket."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod("spot", F.col("_blocks")).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("_mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        dealt.withColumn("_other", other)
        .withColumn("bi", F.least("_mine", "_other"))
        .withColumn("bj", F.greatest("_mine", "_other"))
        .withColumn("side", (F.col("_mine") > F.col("_other")).cast("int"))
        .drop("_blocks", "_mine", "_other")
    )


def pieces_of_work(batches, key_columns: int):
    """Groups rows of sorted partitions by their first columns; yields (key, rows)."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:key_columns] != key:
                if held:
                    yield key, held
                key, held = row[:key_columns], []
            held.append(row[key_columns:])
    if held:
        yield key, held


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes with edges (a, b).

    Large-star and small-star steps in turn (Kiveris et al. 2014), with hot nodes kept apart by
    grouped minima instead of gathered neighbours; each round is written to the shared folder. An
    error if they are not settled after so many rounds."""
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = staged(edges, "edges")
    before = None
    for _ in range(rounds):
        # large star: larger neighbours of a node go to the smallest one in its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.where("a <> b").distinct()
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = staged(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "edges",
        )
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select("b", "b").toDF("node", "root")).distinct()


def edges_and_counts(alike_: np.ndarray, left: list, right: list, weight_l, weight_r, same: bool):
    """For one piece of work: links per row, weighted by the size of the other side's class, and
    edges of a spanning forest of the pairs found (never more than the rows)."""
    hit = alike_.copy()
    if same:
        np.fill_diagonal(hit, False)
    links_l = hit @ np.asarray(weight_r, dtype=np.int64)
    links_r = None if same else hit.T @ np.asarray(weight_l, dtype=np.int64)
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    rows = [("l", i) for i in range(len(left))]
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        for j in np.flatnonzero(hit[i]).tolist():
            x, y = find(rows[i]), find(("l", j) if same else ("r", j))
            if x != y:
                parent[x] = y
                forest.append((left[i], left[j] if same else right[j]))
    return links_l, links_r, forest


__all__ = [
    "alike", "blocked", "components", "edges_and_counts", "map_batches", "minhashes",
    "pieces_of_work", "salts", "set_key", "shingles", "word_hashes",
]

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthflow.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows, k):
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = defaultdict(list)
    for q, a in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        for i, b in usable:
            if i != q and len(a) == len(b):
                out[q].append((-sum(x * y for x, y in zip(a, b)), i))
    return {
        (q, rank + 1, i, -score)
        for q, found in out.items()
        for rank, (score, i) in enumerate(sorted(found)[:k])
    }


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dim) / math.sqrt(dim)).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_against_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 3)
    rows = vectors(700, dim, dim)
    got = {tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()}
    assert got == brute(rows, 5)


def test_tasks_stay_small_however_many_queries(spark, monkeypatch):
    """Portions hold a bounded number of components, and vectors are shuffled once."""
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "PORTION", 400)
    monkeypatch.setattr(topk, "LEAST_TASKS", 1)
    rows = vectors(6400, 4, 5)  # 128 queries: 64 groups; 64 portions of about 100 vectors
    search = topk._search

    def counted(k):
        run, by_portion, shuffled = search(k), *seen

        def work(batches):
            held = list(batches)
            dealt = [r for b in held for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            shuffled.add(sum(kind == 0 for _, kind in dealt))
            largest = max((dealt.count((s, 0)) for s in {s for s, _ in dealt}), default=0)
            by_portion.add(int(largest > 150))
            return run(iter(held))

        return work

    monkeypatch.setattr(topk, "_search", counted)
    got = {tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()}
    assert seen[0].value == 0 and seen[1].value == 6400
    assert got == brute(rows, 5)


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = vectors(200, 8, 9)
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # ties
    rows += [(2000, None), (2050, []), (2100, [None] * 8), (2150, [float("nan")] * 8)]
    rows += [(2200, [float("inf")] * 8), (None, [0.1] * 8), (2250, [0.25, 0.5]), (2251, [1.0, 1.0])]
    rows += [(2300, [1e9] * 8), (2301, [-1e9] * 8), (100, rows[100][1])]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(brute(rows, 5))


def test_no_rows_and_no_queries(spark):
    asked = F.col("vec_id") % 50 == 0
    assert topk.top_k(frame(spark, []), asked).collect() == []
    assert topk.top_k(frame(spark, [(1, [1.0]), (2, [1.0])]), asked).collect() == []
    assert topk.top_k(frame(spark, [(50, [1.0])]), asked).collect() == []


def test_bound_is_never_below_the_score():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-300, 300, (20, 37)), rng.integers(-300, 300, (50, 37))
    exact = q @ x.T
    for n in topk.RESOLUTIONS:
        assert np.all(topk._described(q, n) @ topk._described(x, n).T >= exact - 1e-6)

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthflow.llm import jaccard, similar

from .conftest import prose, words


def sets_of(text):
    w = re.findall(r"\w+", (text or "").lower())
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, threshold=0.8):
    """doc_id: (class_id, n_links) by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out, seen = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            seen |= {j: group for j in group}
        out[rows[i][0]] = (min(rows[j][0] for j in seen[i]), len(links[i]))
    return out


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(words(5, seed + 1))
    return " ".join(w)


@pytest.fixture(scope="module")
def near():
    rows = []
    for g in range(25):
        base = prose(150, 900 + g)
        rows += [(100 * g + k, edited(base, k % 7, 7 * g + k)) for k in range(12)]
    shared = prose(30, 1)
    rows += [(5000 + i, shared + " " + prose(60, 4000 + i)) for i in range(80)]
    rows += [(6000, "a b"), (6001, "A, b!"), (6002, "a b c"), (6003, ""), (6004, None), (6005, " ")]
    return rows


def got(frame):
    return {
        r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(frame).collect()
    }


def test_against_all_pairs(documents, near):
    assert got(documents(near)) == brute(near)


def test_deep_splits_and_blocks_lose_nothing(documents, near, monkeypatch):
    """With tiny buckets every shared passage is split and every group is compared in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(similar.blocked, "__defaults__", (4,))
    frame = documents(near)
    found, want = got(frame), brute(near)
    assert found.keys() == want.keys()
    wrong = [i for i in want if found[i] != want[i]]
    assert len(wrong) <= 2  # 0.999 of the links at the threshold


def test_odd_rows(documents, odd_rows):
    out = jaccard.near_duplicates(documents(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert by[1] == [(1, 2)] and by[2] == [(1, 2)] and by[8] == [(1, 2)]
    assert by[3] == [(3, 0)] and by[4] == [(4, 0)] and by[5] == [(5, 0)]
    assert by[9] == [(9, 1), (9, 1)]
    assert by[7] == [(7, 0)]
    frame = documents(odd_rows)
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    stay = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None)
    assert [i for i, _ in stay] == [1, 3, 4, 5, 6, 7, 9, 10, 11]
    assert kept.where("doc_id is null").count() == 2


def test_no_documents(documents):
    assert jaccard.near_duplicates(documents([])).collect() == []
    assert jaccard.one_of_each(documents([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=12))
def test_overlaps(sets):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    want = [[len(a & b) for b in sets] for a in sets]
    assert similar.overlaps(arrays, arrays).tolist() == want


def test_components_that_are_not_settled(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        similar.components(path, rounds=2)


def test_components(spark):
    rng, edges = random.Random(2), []
    for c in range(30):
        nodes = [1000 * c + i for i in range(rng.randint(2, 40))]
        edges += [(a, rng.choice(nodes[: i + 1])) for i, a in enumerate(nodes[1:])]
    edges += [(10**6 + i, 10**6 + i + 1) for i in range(200)]  # a long chain
    out = similar.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(out) == len({r["node"] for r in out}) == len({n for e in edges for n in e})
    roots = {r["node"]: r["root"] for r in out}
    assert all(roots[a] == roots[b] <= min(a, b) for a, b in edges)
    assert len(set(roots.values())) == 31


def test_blocks_bring_any_two_members_together_once(spark):
    from pyspark.sql import functions as F

    members = spark.range(23).select(F.lit(1).alias("key"), "id", F.lit(23).alias("n"))
    rows = similar.blocked(members.withColumn("spot", F.xxhash64("id")), ["key"], 5).collect()
    met = {}
    for r in rows:
        met.setdefault((r["bi"], r["bj"]), ([], []))[r["side"]].append(r["id"])
    pairs = []
    for (bi, bj), (left, right) in met.items():
        if bi == bj:
            pairs += [frozenset((a, b)) for a in left for b in left if a < b]
        else:
            pairs += [frozenset((a, b)) for a in left for b in right]
    assert len(pairs) == len(set(pairs)) == 23 * 22 // 2

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthflow.llm import quality, toxicity
from hearthflow.llm.common import held_out, table

from .conftest import prose, words

MEDIUM = "/root/testdata/sf0.1"


def test_held_out_is_the_crc_of_the_text_of_the_id(spark):
    rows = spark.range(-5, 200).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def kneser_ney(counts, shared, gram):
    """P(last symbol | the others) by the textbook formula over a dict of counts."""
    context = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
    lower = shared(gram[1:])
    if not context:
        return lower
    values = list(counts.values())
    once, twice = values.count(1), values.count(2)
    d = once / (once + 2 * twice) if once and twice else 0.5
    return max(counts.get(gram, 0) - d, 0) / sum(context) + d * len(context) / sum(context) * lower


def test_ratios_against_the_formula():
    rng = random.Random(1)
    texts = {c: ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(6)] for c in (0, 1)}
    dense, counts = np.zeros((2, toxicity.SYMBOLS**4), dtype=np.int64), ({}, {})
    for c in (0, 1):
        for t in texts[c]:
            padded = "   " + t
            found = toxicity.grams(t)
            np.add.at(dense[c], found, 1)
            for i in range(len(t)):
                g = padded[i : i + 4]
                counts[c][g] = counts[c].get(g, 0) + 1
    pooled = set(counts[0]) | set(counts[1])

    def continuation(n):
        longer = pooled if n == 3 else set(continuation(n + 1))
        out = {}
        for g in longer:
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    def shared(gram):
        if not gram:
            return 1 / toxicity.SYMBOLS
        return kneser_ney(continuation(len(gram)), shared, gram)

    found = toxicity.ratios(dense[1], dense[0])
    number = {" ": 0, "a": 1, "b": 2, "c": 3}
    for gram in [*list(pooled)[:40], "abca", "aaaa", "cccc", "bbb "]:
        at = 0
        for symbol in gram:
            at = at * toxicity.SYMBOLS + number[symbol]
        want = np.log(kneser_ney(counts[1], shared, gram) / kneser_ney(counts[0], shared, gram))
        assert found[at] == pytest.approx(want, abs=1e-4)


@pytest.fixture(scope="module")
def marked(spark, documents):
    """Ordinary texts, of which some hold slurs; odd documents without labels."""
    rng = random.Random(3)
    slurs = ["zoqkwux", "vyxxuq", "wuzzyk"]
    rows, labels, vocabulary = [], [], words(400, 1)
    for i in range(700):
        w, toxic = rng.choices(vocabulary, k=rng.randint(20, 200)), int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(slurs))
        rows.append((i, " ".join(w)))
        if i % 10:
            labels.append((i, None if i % 97 == 0 else 1, None if i % 89 == 0 else toxic))
    rows += [(2000, None), (2001, ""), (None, "abc zoqkwux"), (2002, "x" * 200_000), (2002, "")]
    labels += [(2000, 1, 0), (2002, 1, 0), (9999, 0, 1), (None, 0, 1), (1, 1, 0)]
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxic_documents_are_told_apart(marked):
    docs, labels = marked
    out = toxicity.score(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == want
    unseen = [r for r in out if r["held_out"] and r["doc_id"] < 700]
    right = sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in unseen)
    assert right / len(unseen) > 0.95


def test_labels_of_held_out_rows_change_nothing(marked):
    docs, labels = marked
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, labels).collect()}
    b = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, flipped).collect()}
    assert a == b


def test_toxicity_without_labels_or_documents(spark, documents, odd_rows, marked):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(documents(odd_rows), none).count() == len(odd_rows)
    assert toxicity.score(documents([]), marked[1]).collect() == []


def test_toxicity_on_the_given_tables(spark):
    """One in ten toxic documents of this table holds no expression that others hold, too."""
    out = toxicity.score(table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels"))
    known = out.join(table(spark, MEDIUM, "labels"), "doc_id").where("held_out")
    rows = known.select("predicted", "toxic").collect()
    hit = sum(r["predicted"] == r["toxic"] == 1 for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.6
    assert hit / sum(r["predicted"] for r in rows) > 0.85
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.94


def test_quality_on_the_given_tables(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    model = quality.fit(docs, labels, usable=~held_out())
    out = quality.scored(docs, model).join(labels, "doc_id").where(held_out())
    rows = out.select((F.col("_score") >= 0.5).alias("good"), "quality").collect()
    assert sum(r["good"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.97
    clean = [r for r in rows if r["quality"] == 1]
    assert sum(r["good"] for r in clean) / len(clean) > 0.99


def test_quality_of_odd_rows(spark, documents, odd_rows):
    rows = [(1000 + i, prose(60, i)) for i in range(80)]
    rows += [(3000 + i, ("### %s !! " % words(1, i)[0]) * 40) for i in range(40)]
    labels = [(1000 + i, 1, 0) for i in range(60)] + [(3000 + i, 0, 0) for i in range(30)]
    labels += [(None, 0, 0), (1, None, None), (1000, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = documents(rows + odd_rows)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {*range(1000, 1080)} <= set(ids) and not {*range(3000, 3040)} & set(ids)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.keep_good(docs, none).count() == docs.count()
    assert quality.keep_good(documents([]), marks).collect() == []


def test_increasing_curve_never_falls():
    rng = np.random.default_rng(2)
    curve = quality._increasing(rng.integers(0, 9, 60), rng.integers(0, 9, 60), 0.5)
    assert len(curve) == 60 and all(a <= b for a, b in zip(curve, curve[1:]))

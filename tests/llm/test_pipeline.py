from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthflow.llm.common import table
from hearthflow.llm.decontaminate import Matcher

from .test_jaccard import brute
from .test_lines import by_sql
from .test_packing import WORDS, check_placed, plain_ids

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and returned, by the smallest tables."""
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        out.append((docs, made))
        docs = made
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def test_all_but_the_last_return_documents(steps):
    for name, (given, made) in steps.items():
        if name != "packing":
            assert made.dtypes == given.dtypes


def test_quality_keeps_the_good_and_drops_the_bad(spark, steps):
    given, made = steps["quality"]
    labels = table(spark, SMALL, "labels").select("doc_id", "quality")
    kept = {r["doc_id"] for r in made.collect()}
    known = {r["doc_id"]: r["quality"] for r in given.join(labels, "doc_id").collect()}
    good, bad = ([d for d, q in known.items() if q == v] for v in (1, 0))
    assert sum(d in kept for d in good) / len(good) > 0.97
    assert sum(d in kept for d in bad) / len(bad) < 0.2


def test_lines_against_sql(steps):
    given, made = steps["line_dedup"]
    want = Counter((i, t) for (i, t, _) in by_sql([(r["doc_id"], r["text"]) for r in given.collect()]))
    assert Counter((r["doc_id"], r["text"]) for r in made.collect()) == want
    assert made.where(F.col("n_chars") != F.length("text")).isEmpty()


def test_near_duplicates_against_all_pairs(steps):
    given, made = steps["near_duplicates"]
    groups = brute([(r["doc_id"], r["text"]) for r in given.collect()])
    assert {r["doc_id"] for r in made.collect()} == {c for c, _ in groups.values()}


def test_decontamination_against_every_item(spark, steps):
    given, made = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    every = Matcher(tuple(items), 0.06)
    want = {r["doc_id"] for r in given.collect() if not every.matches(r["text"])}
    assert {r["doc_id"] for r in made.collect()} == want


def test_packing_places_every_token(steps):
    given, made = steps["packing"]
    rows = made.collect()
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    want = {r["doc_id"]: len(plain_ids(WORDS, r["text"])) + 1 for r in given.collect()}
    assert tokens == want
    assert check_placed(rows, 2048) <= -(-sum(want.values()) // 2048) * 1.1 + 1


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    want = steps["packing"][1].select(columns).collect()
    assert Counter(got.select(columns).collect()) == Counter(want)
    assert public_tokenizers.path("word_bpe_49k.json") == WORDS


#: Names that the operators use inside, as columns of the documents.
INNER = (
    "_k _key _doc _nos _lines _hashes _ends _chunks _removed _tkey _x _p _score _portion _len _n "
    "_slots _rest kept len row portion first slot uid k n_links hash"
).split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_extra_columns_with_inner_names(spark, steps, name):
    """The same result as without them, and the columns as they were."""
    given, made = steps[name]
    extra = given.select("*", *(F.concat(F.lit(c), "doc_id").alias(c) for c in INNER))
    got = dict(corpus_pipeline.STAGES)[name](spark, extra, SMALL)
    if name == "packing":
        columns = ["doc_id", "piece", "length", "ids_crc32"]
        assert Counter(got.select(columns).collect()) == Counter(made.select(columns).collect())
        return
    assert got.columns == extra.columns
    rows = got.collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INNER)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(
        (r["doc_id"], r["text"]) for r in made.collect()
    )

import random
import re
from collections import Counter, defaultdict

import pytest

from hearthflow.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "lang string, source string, text string, term string, n int, rank string, value int, no int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)


def brute(rows, least, ranks):
    found = [(a or "", b or "", WORD.findall((c or "").translate(UPPER))) for a, b, c in rows]
    docs, langs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in found:
        docs[lang].update(set(words))
        langs[lang].update(words)
        groups[lang, source].update(words)
    out = set()
    for lang, source in groups:
        kept = [t for t in docs[lang] if docs[lang][t] >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        p, q = shares(groups[lang, source]), shares(langs[lang])
        terms = [(p[t] - q[t], t) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                r = shares(groups[lang, other])
                pairs.append((sum(abs(p[t] - r[t]) for t in kept), other))
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, i, v, k + 1) for k, (v, i) in enumerate(items[:most])}
    return out


def made(seed, sources, many):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(60)]
    words += ["É", "İ", "Upper", "日本", "ß9z", "\U0001f600\U0001f600"]
    rows = [(None, None, None), ("", "", "wak wak"), ("xx", "only", "some words"), ("en", None, "")]
    for i in range(many):
        mine = rng.sample(words, 12) if i % 7 else words[:3]
        text = " ".join(rng.choices(mine, k=rng.randint(0, 30)))
        rows.append((rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}", text))
    return rows + rows[5:9]


@pytest.mark.parametrize("block,portion", [(64, 20_000), (3, 20), (1, 7)])
def test_against_brute_force(spark, monkeypatch, block, portion):
    rows = made(1, 9, 300)
    kept, groups = divergence.kept_terms(frame(spark, rows), 5)
    want = brute(rows, 5, 4)
    got = divergence.source_distances(kept, groups, block, portion).collect()
    assert {(r.lang, r.source, r.item, r.value, r.rank) for r in got} == {
        (a, b, i, v, k) for a, b, part, i, v, k in want if part == "pair"
    }
    got = divergence.leading_terms(kept, groups, 4).collect()
    assert {(r.lang, r.source, r.item, r.value, r.rank) for r in got} == {
        (a, b, i, v, k) for a, b, part, i, v, k in want if part == "term"
    }


def test_whole_query(spark):
    rows = made(2, 4, 200)
    got = divergence.audit(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute(rows, 30, 50) and len(got) == len(set(map(tuple, got)))


def test_ties_stop_at_the_last_rank(spark):
    rows = [("en", "a", " ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(8)))] * 3
    rows += [("en", "b", "taa other")] * 3
    got = divergence.audit(frame(spark, rows), least_docs=3).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 50)
    assert max(r["rank"] for r in got if r.part == "term") == 50


def test_no_rows_and_no_kept_terms(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    rows = [("en", "a", "x"), ("en", "b", "y")]
    got = {tuple(r) for r in divergence.audit(frame(spark, rows)).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_counts_do_not_depend_on_how_rows_are_held(spark, monkeypatch):
    rows = made(3, 5, 200)
    whole = divergence.term_counts(frame(spark, rows)).collect()
    apart = divergence.term_counts(frame(spark, rows).repartition(7)).collect()
    assert sorted(whole) == sorted(apart)

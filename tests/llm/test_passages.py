import random
import re

import pytest

from hearthflow.llm import passages

from .conftest import prose, words


def units(text):
    """(shingle set, start, end, first word, words) of the paragraphs with shingles."""
    out, at, word = [], 0, 0
    for part in re.split(r"[.!?\n]", text.lower()):
        w = re.findall(r"\w+", part)
        if len(w) >= 5:
            sets = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            out.append((sets, at, at + len(part), word, len(w)))
        at += len(part) + 1
        word += len(w)
    return out


def brute(rows, least=20):
    """(doc_id, start, length, words) of all runs, by comparing all paragraphs."""
    every = [(d, n, u) for d, t in rows for n, u in enumerate(units(t or ""))]
    parent = list(range(len(every)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, _, a) in enumerate(every):
        for j in range(i):
            b = every[j][2][0]
            if len(a[0] & b) >= 0.8 * len(a[0] | b) - 1e-9:
                parent[find(i)] = find(j)
    docs = {}
    for i, (d, _, _) in enumerate(every):
        docs.setdefault(find(i), set()).add(d)
    runs, last = [], None
    for i, (d, n, u) in enumerate(every):
        if len(docs[find(i)]) < 2:
            continue
        if last == (d, n - 1):
            runs[-1][2] = u[2]
            runs[-1][4] = u[3] + u[4]
        else:
            runs.append([d, u[1], u[2], u[3], u[3] + u[4]])
        last = (d, n)
    return sorted((d, a, b - a, e - w) for d, a, b, w, e in runs if e - w >= least)


@pytest.fixture(scope="module")
def planted():
    rng, rows = random.Random(8), []
    shared = [prose(70, 300 + i) for i in range(4)]
    for i in range(40):
        host = prose(rng.randint(30, 90), 700 + i).split(" ")
        if i % 2:
            host.insert(rng.randint(0, len(host)), shared[i % 4])
        rows.append((i, " ".join(host)))
    whole = prose(200, 55)
    rows += [(100, whole), (101, whole), (102, whole.replace("a", "b", 2))]
    return rows


def got(frame):
    return sorted(
        (r["doc_id"], r["start"], r["length"], r["words"])
        for r in passages.repeated_passages(frame).collect()
    )


def test_against_all_pairs(documents, planted):
    want = brute(planted)
    assert {d for d, *_ in want} >= {i for i in range(1, 40, 2)}
    assert not {d for d, *_ in want} & {i for i in range(0, 40, 2)}
    assert got(documents(planted)) == want


def test_a_join_instead_of_an_array_and_blocks_give_the_same(documents, planted, monkeypatch):
    monkeypatch.setattr(passages, "SENT", 3)
    monkeypatch.setattr(passages.blocked, "__defaults__", (2,))
    assert got(documents(planted)) == brute(planted)


def test_first_occurrence_is_kept_and_the_rest_removed(documents):
    text = prose(80, 5)
    rows = [(3, text), (1, "Host one. " + text), (2, None), (4, prose(60, 6))]
    frame = documents(rows)
    keep = {r["doc_id"]: r["keep"] for r in passages.repeated_passages(frame).collect()}
    assert keep == {1: True, 3: False}
    out = {r["doc_id"]: r["text"] for r in passages.without_repeats(frame).collect()}
    assert out[1] == rows[1][1] and out[2] is None and out[4] == rows[3][1]
    assert len(out[3]) < 30


def test_odd_rows(documents, odd_rows):
    found = {r["doc_id"] for r in passages.repeated_passages(documents(odd_rows)).collect()}
    assert found == {1, 2, 8}  # equal rows of 9 are one document
    assert passages.without_repeats(documents(odd_rows)).count() == len(odd_rows)


def test_no_documents(documents):
    assert passages.repeated_passages(documents([])).collect() == []


def test_bands_are_tuned():
    assert passages.bands(0.8, 0.99) == 3
    assert passages.bands(0.8, 0.99, rows=2) == 5


def test_a_common_sentence_does_not_take_the_rest_of_the_original_along(documents):
    common = "every page of this site ends with the same old notice"
    one, two = prose(40, 61), prose(40, 62)
    text = f"{one}\n{common}.\n{two}"
    rows = [(1, f"{prose(24, 63)}\n{common}.\n{prose(24, 64)}"), (2, text), (3, text)]
    frame = documents(rows)
    out = {r["doc_id"]: r["text"] for r in passages.without_repeats(frame).collect()}
    left = {u[0] for t in out.values() for u in units(t)}
    assert {u[0] for _, t in rows for u in units(t)} == left
    assert out[1] == rows[0][1] and one in out[2] and two in out[2] and common not in out[2]
    assert len(out[3]) < 20
    parts = sorted((r["doc_id"], r["start"], r["keep"]) for r in passages.repeated_passages(frame).collect())
    assert [(d, k) for d, _, k in parts] == [(2, True), (2, False), (2, True), (3, False)]


def test_a_letter_that_grows_in_lower_case_leaves_the_others_folded(documents):
    text = prose(80, 71)
    rows = [(1, text), (2, text.title()), (3, f"\u0130 {prose(31, 72)}.\n" + text.title())]
    found = passages.repeated_passages(documents(rows)).collect()
    assert sorted((r["doc_id"], r["words"], r["keep"]) for r in found) == [
        (1, 80, True), (2, 80, False), (3, 80, False),
    ]
    assert passages._folded("\u0130 \u0130A") == "\u0130 \u0130a"


def verse(n, seed):
    rng, w = random.Random(seed), iter(words(4 * n, seed))
    return [" ".join(next(w) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def test_a_passage_in_short_lines_is_found(documents):
    song = verse(40, 81)
    rows = [
        (1, prose(40, 82) + "\n" + "\n".join(song) + "\n" + prose(40, 83)),
        (2, prose(24, 84) + "\n\n" + "!\n\n".join(song) + ".\n" + prose(32, 85)),
        (3, "\n".join(verse(11, 86) + song + verse(9, 87))),
        (4, "\n".join(verse(60, 88))),
    ]
    frame = documents(rows)
    found = {r["doc_id"]: r for r in passages.repeated_passages(frame).collect()}
    n = sum(len(x.split()) for x in song)
    assert {i: r["keep"] for i, r in found.items()} == {1: True, 2: False, 3: False}
    assert found[1]["words"] == found[2]["words"] == n and found[3]["words"] > 0.7 * n
    out = {r["doc_id"]: r["text"] for r in passages.without_repeats(frame).collect()}
    assert out[1] == rows[0][1] and out[4] == rows[3][1]
    assert not any(x in out[2].split("\n") for x in song)
    assert all(x in out[3].split("\n") for x in verse(11, 86)[:-6] + verse(9, 87)[6:])


def test_every_word_of_short_lines_lies_in_one_paragraph():
    texts = ["\n".join(verse(50, 90 + i)) for i in range(20)] + ["a b c", "", None, "a b\n\nc d. e"]
    p = passages.paragraphs(texts)
    for i, text in enumerate(texts):
        mine = p["text"] == i
        n = len((text or "").replace(".", " ").split())
        assert p["words"][mine].sum() == (n if n >= 5 else 0)
        for at, long, many in zip(p["start"][mine], p["length"][mine], p["words"][mine]):
            assert many >= 5 and len(re.findall(r"\w+", text[at : at + long])) == many

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from hearthflow.llm import lines

from .conftest import prose


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return Counter(con.execute(lines.OP3_SQL).fetchall())


def by_spark(frame):
    out = lines.dedup_lines(frame)
    assert out.columns == [*frame.columns, "_removed"]
    return Counter((r["doc_id"], r["text"], r["_removed"]) for r in out.collect())


@pytest.fixture(scope="module")
def shared():
    """Documents that share blocks of lines at shifted places."""
    rng = random.Random(4)
    pool = ["\n".join(prose(9, 50 * b + i) for i in range(8)) for b in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(3, 30), 1000 + 10 * i + j) for j in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(pool))
        rows.append((i, "\n".join(parts)))
    return rows


def test_against_sql(documents, shared):
    want = by_sql(shared)
    assert by_spark(documents(shared)) == want
    assert sum(n for _, _, n in want) > 60


def test_a_shared_block_goes_wherever_it_stands(documents, shared):
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(shared)).collect()}
    seen = defaultdict(int)
    for text in out.values():
        for line in set(text.split("\n")):
            seen[line] += 1
    original = Counter(x for _, t in shared for x in set(t.split("\n")))
    hot = [x for x, n in original.items() if n > 5 and len(x) > 20]
    assert hot
    assert sum(seen[x] for x in hot) < 0.4 * sum(original[x] for x in hot)


def test_odd_rows(documents, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    unique = list({i: (i, t) for i, t in rows}.values())
    frame = documents(unique)
    assert by_spark(frame) == by_sql(unique)
    out = lines.dedup_lines(documents(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        if r["text"] is None:
            assert r["_removed"] == 0 and r["n_chars"] is None
        else:
            assert r["n_chars"] == len(r["text"])
    again = Counter((r["doc_id"], r["text"]) for r in out)
    assert again[(9, prose(80, 4))] == 2  # rows that agree in doc_id and text are one document


def test_removed_chunk_leaves_the_first_occurrence(documents):
    block = "\n".join(f"line {i} of the block" for i in range(12))
    out = {r["doc_id"]: r for r in lines.dedup_lines(documents([(5, block), (2, block)])).collect()}
    assert out[2]["text"] == block
    assert out[5]["_removed"] > 0 and len(out[5]["text"]) < len(block)


def test_no_documents(documents):
    assert lines.dedup_lines(documents([])).collect() == []


def test_only_spark_operations(documents, shared):
    plan = lines.dedup_lines(documents(shared))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_lines_that_are_chunks_of_their_own_go_with_a_copied_stretch(documents):
    """Inside a copy of many lines none may stay, whatever the cuts; before, those of one line did."""
    block = prose(40, 77).replace(". ", ".\n").split("\n")
    block = [f"{i} {line}" for i, line in enumerate(block * 20)][:80]
    rows = [(i, "\n".join([*prose(6, 500 + i).split(), *block, *prose(6, 600 + i).split()])) for i in range(3)]
    frame = documents(rows)
    sizes = [c["lines"] for r in lines.chunked(frame).collect() for c in r["_chunks"]]
    assert sizes.count(1) > 10
    out = {r["doc_id"]: r["text"].split("\n") for r in lines.dedup_lines(frame).collect()}
    assert out[0] == rows[0][1].split("\n")
    inside = block[10:-10]
    for i in (1, 2):
        assert not set(inside) & set(out[i])
        assert set(prose(6, 500 + i).split()[:5]) <= set(out[i])
    assert by_spark(frame) == by_sql(rows)


def test_a_line_repeated_alone_stays(documents):
    rows = [(i, "\n".join([*prose(8, 900 + 2 * i).split(), "All rights reserved", *prose(8, 901 + 2 * i).split()]))
            for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(rows)).collect()}
    assert sum("All rights reserved" in t for t in out.values()) == 20
    assert by_spark(documents(rows)) == by_sql(rows)

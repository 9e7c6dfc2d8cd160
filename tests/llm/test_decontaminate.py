from hypothesis import given, settings
from hypothesis import strategies as st

from hearthflow.llm import decontaminate as d

from .conftest import prose


def smallest_distance(pattern, text):
    """Sellers' table: edit distance to any stretch, and the first end."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    best = min(row)
    return best, row.index(best)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=14), st.text(alphabet="abc", max_size=30))
def test_myers_against_the_table(pattern, text):
    assert d.myers(d.masks(pattern), len(pattern), text) == smallest_distance(pattern, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=60), st.text(alphabet="ab", min_size=1, max_size=30))
def test_matches_are_all_within_budget(text, item):
    found = d.Matcher(((1, item),), 0.2).matches(text)
    distance, _ = smallest_distance(d.folded(item), d.folded(text))
    errors = d.budget(len(item), 0.2)
    assert bool(found) == bool(text and distance <= errors)
    if found:
        assert found[0][1] == distance
        stretch = d.folded(text)[found[0][2] : found[0][3]]
        assert smallest_distance(stretch, d.folded(item))[0] <= distance


def rows_of(spark, documents, rows, items, **how):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.leaks(documents(rows), table, **how)
    return {(r["doc_id"], r["item_id"], r["errors"]) for r in found.collect()}


def test_leaks_with_edits_and_odd_rows(spark, documents, odd_rows):
    item = prose(40, 77)[:200]
    edited = item[:30].upper() + "#" + item[31:90] + item[92:150].replace(" ", "\n") + "zz" + item[150:]
    rows = odd_rows + [(50, "aa " + item + " bb"), (51, prose(20, 5) + edited), (52, item[:100])]
    items = [(1, item), (2, None), (3, ""), (4, item)]
    want = {(50, 1, 0), (50, 4, 0), (51, 1, 5), (51, 4, 5)}
    assert rows_of(spark, documents, rows, items) == want


def test_blocks_of_items_give_the_same(spark, documents, odd_rows, monkeypatch):
    items = [(i, prose(30, 100 + i)) for i in range(8)]
    rows = odd_rows + [(100 + i, prose(5, i) + t + prose(9, i)) for i, t in items]
    one = rows_of(spark, documents, rows, items)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(d.item_blocks, "__defaults__", (100,))
    blocks = list(d.item_blocks(table))
    assert len(blocks) > 5 and sum(len(b) for b, _ in blocks) == 8
    assert [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True]
    assert rows_of(spark, documents, rows, items) == one == {(100 + i, i, 0) for i in range(8)}
    kept = d.without_leaks(documents(rows), table)
    assert kept.columns == documents([]).columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, documents(odd_rows).collect()))


def test_empty_tables(spark, documents, odd_rows):
    assert rows_of(spark, documents, [], [(1, "abc")]) == set()
    assert rows_of(spark, documents, odd_rows, []) == set()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.without_leaks(documents(odd_rows), none).count() == len(odd_rows)


def test_a_block_is_done_before_the_next_is_read(spark, documents, monkeypatch):
    """The driver may hold one block of items; before, all blocks were collected first."""
    items = [(i, prose(30, 100 + i)) for i in range(4)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(d.item_blocks, "__defaults__", (100,))
    steps, blocks, write = [], d.item_blocks, d.staged

    def read(*args):
        for block in blocks(*args):
            steps.append("read")
            yield block

    def written(*args):
        steps.append("write")
        return write(*args)

    monkeypatch.setattr(d, "item_blocks", read)
    monkeypatch.setattr(d, "staged", written)
    rows = [(i, prose(5, i) + t) for i, t in items] + [(9, "clean")]
    assert d.leaks(documents(rows), table).count() == 4
    assert steps == ["read", "write"] * (len(steps) // 2) and len(steps) > 4
    steps.clear()
    assert [r["doc_id"] for r in d.without_leaks(documents(rows), table).collect()] == [9]
    assert steps == [*["read", "write"] * (len(steps) // 2), "read"]

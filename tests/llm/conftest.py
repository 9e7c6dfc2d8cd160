from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "piece string, score string, key string, n string, label string"
)


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    """Sentences of about eight words, some of them ending a line."""
    rng, out = random.Random(seed), []
    for i, w in enumerate(words(n, seed)):
        end = (".\n" if rng.random() < 0.3 else ". ") if i % 8 == 7 else " "
        out.append(w + end)
    return "".join(out).strip()


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text) pairs, with columns that clash with inner names."""

    def build(rows):
        full = [(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = prose(120, 1)
    return [
        (1, base), (2, base), (3, None), (4, ""), (5, "   \n "), (6, "one"), (None, prose(60, 2)),
        (None, None), (7, prose(30_000, 3)), (8, base.replace("a", "b", 1)), (9, prose(80, 4)),
        (9, prose(80, 4)), (10, "x" * 50_000), (11, "日本語 テキスト é ß İ ́ ok"),
    ]

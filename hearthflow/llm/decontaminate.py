"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some stretch of it is within the item's error budget
(edit distance; a share of the item's length). An item is split into budget + 1 pieces: with at
most `budget` errors at least one piece is untouched, so it occurs exactly. All pieces go into one
Aho-Corasick automaton; every hit gives a window of the document, and Myers' bit-parallel
algorithm gives the exact smallest distance of the item to any stretch of the window. Nothing
that meets the definition is missed, and nothing else is reported.

Letters are compared in lower case and any white space counts as a blank; positions are those of
the original text. Items are few beside documents, but their size is not taken for granted: they
are worked through in blocks of a bounded number of characters, one pass over the documents each. The
driver holds one block at a time.

Null or empty documents match nothing; null or empty items match nothing. Repeated items and
repeated documents are reported each. Extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import map_batches, table

ERROR_SHARE = 0.06
BLOCK_CHARS = 16_000_000
_BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r\x85\xa0  "})


def folded(text: str) -> str:
    """Lower case with plain blanks, of the same length."""
    small = text.lower()
    if len(small) != len(text):
        small = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return small.translate(_BLANKS)


def budget(length: int, share: float = ERROR_SHARE) -> int:
    return int(length * share)


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """Begin and end of errors + 1 pieces of nearly equal length."""
    n = min(errors + 1, length)
    cuts = [length * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a stretch of the text that ends at `end` (the
    first such), as (distance, end). Anchored: to a stretch that begins where the text does."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & full
        pv = (mh << 1) & full | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: tuple, share: float):
        self.items = []
        places: dict[str, list] = {}
        for item_id, text in items:
            pattern = folded(text)
            errors = budget(len(pattern), share)
            number = len(self.items)
            self.items.append((item_id, pattern, errors, masks(pattern), masks(pattern[::-1])))
            for begin, end in pieces(len(pattern), errors):
                places.setdefault(pattern[begin:end], []).append((number, begin))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item, the stretches of the text in which a match with a hit piece must lie."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, at) in self.automaton.iter(text):
            for number, begin in at:
                _, pattern, errors, _, _ = self.items[number]
                lo = max(0, last + 1 - size - begin - errors)
                hi = min(len(text), last + 1 - size - begin + len(pattern) + errors)
                spans = out.setdefault(number, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        return out

    def matches(self, raw: str | None) -> list[tuple]:
        """(item_id, errors, start, end) of the best match of each item that matches."""
        if not raw or not self.items:
            return []
        text = folded(raw)
        out = []
        for number, spans in self.windows(text).items():
            item_id, pattern, errors, peq, reverse = self.items[number]
            best = None
            for lo, hi in spans:
                at = text.find(pattern, lo, hi)
                if at >= 0:
                    found = (0, at + len(pattern), at)
                else:
                    distance, end = myers(peq, len(pattern), text[lo:hi])
                    if distance > errors:
                        continue
                    back = text[lo : lo + end][::-1]
                    _, size = myers(reverse, len(pattern), back, anchored=True)
                    found = (distance, lo + end, lo + end - size)
                best = min(best or found, found)
            if best:
                out.append((item_id, best[0], best[2], best[1]))
        return out


@lru_cache(maxsize=2)
def matcher(items: tuple, share: float) -> Matcher:
    return Matcher(items, share)


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple, bool]]:
    """The items in blocks of about so many characters, each read when the one before is done with,
    and whether it is the last."""
    usable = items.select(F.col("item_id").cast("bigint"), "text").where("length(text) > 0")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        found = usable.where(part == b).collect()
        yield tuple(sorted((tuple(r) for r in found), key=str)), b == blocks - 1


def leaks(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, errors, start, length. The rows of
    a block of items are written before the next block is read."""

    def finder(block):
        def run(batches):
            found_in = matcher(block, share).matches
            for batch in batches:
                out = {"doc_id": [], "item_id": [], "errors": [], "start": [], "length": []}
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item_id, errors, start, end in found_in(text):
                        out["doc_id"].append(doc_id)
                        out["item_id"].append(item_id)
                        out["errors"].append(errors)
                        out["start"].append(start)
                        out["length"].append(end - start)
                yield out

        return run

    schema = "doc_id bigint, item_id bigint, errors int, start bigint, length bigint"
    source = docs.select(F.col("doc_id").cast("bigint"), "text")
    return reduce(
        DataFrame.unionByName,
        [
            staged(map_batches(source, finder(block), schema), "leaks")
            for block, _ in item_blocks(items)
        ],
    )


def without_leaks(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """The documents that hold no item, with all their columns; no shuffle. What the pass of a block
    of items leaves is written before the next block is read."""

    def clean(block):
        @F.pandas_udf("boolean")
        def check(texts: pd.Series) -> pd.Series:
            found_in = matcher(block, share).matches
            return pd.Series([not found_in(t) for t in texts], dtype=bool)

        return check

    for block, last in item_blocks(items):
        docs = docs.where(clean(block)("text"))
        docs = docs if last else staged(docs, "clean")
    return docs


def op9_pigeonhole_edit_matching(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Substring dedup: repeated passages by MinHash banding of paragraphs.

A paragraph ends at a sentence mark or a line break, so passages set into the middle of other
texts still fall into the same paragraphs. Neighbouring stretches of fewer than five words (verse,
lists, tables) are joined until they have five or more, up to one whose own words say so, so copies
between other short lines fall into step after a few lines. Only up to four words on their own
between longer paragraphs are not part of one. Paragraphs are sets of five-word shingles, across the
marks in them. Equal sets are one class. For unequal sets, bands of one MinHash each are tuned: as
many as find a pair at the threshold with probability RECALL or more (paragraphs of up to three
shingles can only be similar if equal, and need none). Paragraphs that share a band key with
another are joined on it, classes in one bucket are compared by exact Jaccard similarity, and
the components of what is similar are the clusters. A bucket with many classes is compared in
pairs of blocks.

Neighbouring paragraphs of a document that belong to clusters spread over two or more documents
form a run, over paragraphs too short to have shingles as well. In each cluster the first paragraph
(by doc_id, hash of the text, place) is the one to keep. Runs of at least LEAST_WORDS words are
returned, in parts where the paragraphs to keep and the others meet (the parts may be shorter), so
that what goes is never the first of its cluster.

The band keys that occur once are weeded out by a count that is summed up within each task first.
The repeated ones filter the paragraphs, as an array sent to the tasks if they are at most SENT
keys, else by a join; both give the same.

Null, empty and short texts have no paragraphs. Rows that agree in doc_id and text are one
document. Null doc_ids are kept. Extra columns play no part.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import map_batches, offsets, table
from .similar import (
    THRESHOLD,
    WIDTH,
    alike,
    blocked,
    components,
    edges_and_counts,
    pieces_of_work,
    salts,
    word_hashes,
)

RECALL = 0.99
LEAST_WORDS = 20
SENT = 4_000_000
#: Bytes of text that a task works on at once; a longer text is worked whole.
SLICE = 2_000_000
#: One in so many short stretches ends a paragraph of joined ones.
JOIN_DIVISOR = 2
_TOKEN = re.compile(r"\w+|[.!?\n]")
_MARK = re.compile(r"[.!?\n]")
_MARKS = np.array([xxhash.xxh3_64_intdigest(c) for c in ".!?\n"], dtype=np.uint64)
_END = np.uint64(xxhash.xxh3_64_intdigest("\n"))


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 1) -> int:
    """How many bands of so many rows find a pair at the threshold with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mixed(x: np.ndarray, salt) -> np.ndarray:
    out = (x ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(30))


def _folded(text: str) -> str:
    """Lower case of the same length: U+0130, whose lower case is longer, stays."""
    small = text.lower()
    if len(small) != len(text):
        small = text.replace("\u0130", "I").lower()
        small = "".join(c if c == "\u0130" else s for c, s in zip(text, small))
    return small


def _joined(n_words: np.ndarray, of_text: np.ndarray, unit: np.ndarray, words: np.ndarray):
    """For each unit the first one of its paragraph, and for that one the last."""
    first, last = np.arange(len(n_words)), np.arange(len(n_words))
    held = np.flatnonzero(n_words)  # empty units part nothing
    short = np.flatnonzero(n_words[held] < WIDTH)
    if not len(short):
        return first, last
    mine = held[short]
    many = n_words[mine]
    new = np.ones(len(mine), dtype=bool)
    new[1:] = (np.diff(short) > 1) | (np.diff(of_text[mine]) > 0)
    begins = np.flatnonzero(new)
    enough = np.add.reduceat(many, begins) >= WIDTH
    own = words[n_words[unit] < WIDTH]
    ends = np.add.reduceat(_mixed(own, np.uint64(9)), offsets(many)[:-1]) >> np.uint64(40)
    ends = (ends % np.uint64(JOIN_DIVISOR) == 0).tolist()
    sizes, places = many.tolist(), mine.tolist()
    for lo, hi in zip(begins[enough].tolist(), np.append(begins[1:], len(mine))[enough].tolist()):
        cuts, so_far = [lo], 0
        for i in range(lo, hi):
            so_far += sizes[i]
            if so_far >= WIDTH and ends[i]:
                cuts.append(i + 1)
                so_far = 0
        if so_far < WIDTH and len(cuts) > 1:
            cuts.pop()  # what is left over joins the paragraph before
        for a, b in zip(cuts, [*cuts[1:], hi]):
            first[places[a] : places[b - 1] + 1] = places[a]
            last[places[a]] = places[b - 1]
    return first, last


def paragraphs(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All paragraphs with shingles of some texts, in order: `text` (its number), `no` (among
    those of its text), `start` and `length` in characters, `word` and `words`, `size` of the set,
    and `begin` of its sorted distinct shingles in `shingles`."""
    hashed, chars, units = [], [], []
    for text in texts:
        small = _folded(text or "")
        hashed.append(word_hashes(_TOKEN.findall(small)))
        parts = _MARK.split(small)
        chars += [len(p) + 1 for p in parts]
        units.append(len(parts))
    tokens = np.concatenate([np.append(h, _END) for h in hashed]) if texts else np.zeros(0, "u8")
    mark = np.isin(tokens, _MARKS)
    unit = np.cumsum(mark)[~mark]  # marks so far: the number of the unit
    words = tokens[~mark]
    n_units = len(chars)
    of_text = np.repeat(np.arange(len(texts)), units)
    first_unit = offsets(units)[:-1]
    char_at = offsets(chars)[:-1]
    start = char_at - char_at[first_unit][of_text] if n_units else char_at
    n_words = np.bincount(unit, minlength=n_units)[:n_units]
    word_at = offsets(n_words)[:-1]
    word = word_at - word_at[first_unit][of_text] if n_units else word_at
    take = max(0, len(words) - WIDTH + 1)
    first_of, last_of = _joined(n_words, of_text, unit, words)
    unit = first_of[unit]
    n_words = np.bincount(unit, minlength=n_units)[:n_units]
    inside = unit[:take] == unit[WIDTH - 1 :][:take] if take else np.zeros(0, bool)
    runs = np.zeros(take, dtype=np.uint64)
    for i in range(WIDTH):
        runs = (runs ^ words[i : i + take]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    runs, owner = runs[inside], unit[:take][inside]
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    kept, begin, size = np.unique(owner, return_index=True, return_counts=True)
    text_of = of_text[kept] if len(kept) else kept
    rank = np.arange(len(kept))
    first = np.searchsorted(text_of, text_of, side="left") if len(kept) else rank
    end = char_at + np.asarray(chars, dtype=np.int64) - 1
    return {
        "text": text_of, "no": rank - first, "start": start[kept] if len(kept) else kept,
        "length": end[last_of[kept]] - char_at[kept] if len(kept) else kept,
        "word": word[kept] if len(kept) else kept, "words": n_words[kept] if len(kept) else kept,
        "size": size, "begin": begin, "shingles": runs,
    }


def _keys(p: dict[str, np.ndarray], chosen: np.ndarray):
    """(paragraph, band key) of all bands, and two hashes of each set."""
    if not len(p["begin"]):
        none = np.zeros(0, dtype=np.uint64)
        return none.astype(np.int64), none.view(np.int64), none.view(np.int64), none.view(np.int64)
    one = np.add.reduceat(_mixed(p["shingles"], np.uint64(1)), p["begin"])
    two = np.add.reduceat(_mixed(p["shingles"], np.uint64(2)), p["begin"])
    small = p["size"] <= 3
    every = np.arange(len(one))
    who, keys = [every[small]], [_mixed(one[small], np.uint64(3))]
    for i, salt in enumerate(chosen):
        least = np.minimum.reduceat(_mixed(p["shingles"], salt), p["begin"])
        who.append(every[~small])
        keys.append(_mixed(least[~small], np.uint64(i + 4)))
    return np.concatenate(who), np.concatenate(keys).view(np.int64), one.view(np.int64), two.view(np.int64)


def _sliced(batches, column: int):
    """The rows of batches in pieces of about SLICE bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(part)]):
            yield batch.slice(lo, hi - lo)


def _repeated_keys(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Band keys that occur more than once."""

    def run(batches):
        held, many = [], 0

        def summed():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return {"key": keys, "n": n}

        for batch in _sliced(batches, 0):
            _, keys, _, _ = _keys(paragraphs(batch.column(0).to_pylist()), chosen)
            held.append(keys)
            many += len(keys)
            if many > 4_000_000:
                yield summed()
                held, many = [], 0
        if held:
            yield summed()

    counts = map_batches(docs.select("text"), run, "key bigint, n bigint")
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


_PARAGRAPH = (
    "key bigint, doc_id bigint, tkey bigint, no int, start bigint, length bigint, "
    "word bigint, words bigint, size int, s1 bigint, s2 bigint"
)


def _candidates(docs: DataFrame, repeated: DataFrame, chosen: np.ndarray) -> DataFrame:
    few = repeated.count() <= SENT
    known = np.sort(repeated.toArrow()["key"].to_numpy()) if few else None

    def run(batches):
        for batch in _sliced(batches, 2):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            null = np.asarray(batch.column(0).is_null())
            tkeys = batch.column(1).to_numpy(zero_copy_only=False)
            p = paragraphs(batch.column(2).to_pylist())
            who, keys, one, two = _keys(p, chosen)
            if known is not None:
                at = np.searchsorted(known, keys)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == keys[hit]
                who, keys = who[hit], keys[hit]
            text = p["text"][who]
            doc = [None if null[t] else int(ids[t]) for t in text.tolist()]
            yield {
                "key": keys, "doc_id": doc, "tkey": tkeys[text], "no": p["no"][who],
                "start": p["start"][who], "length": p["length"][who], "word": p["word"][who],
                "words": p["words"][who], "size": p["size"][who], "s1": one[who], "s2": two[who],
            }

    source = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tkey"), "text")
    found = map_batches(source, run, _PARAGRAPH)
    return found if few else found.join(repeated, "key", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and the set of one paragraph of each wanted class (node, doc_id, tkey, no)."""

    def run(batches):
        for batch in _sliced(batches, 2):
            nodes, nos, texts = (c.to_pylist() for c in batch.columns)
            out = {"node": [], "shingles": []}
            p = paragraphs(texts)
            at = offsets(np.bincount(p["text"], minlength=len(texts)))
            for i, (mine, numbers) in enumerate(zip(nodes, nos)):
                for node, no in zip(mine, numbers):
                    q = at[i] + no
                    lo = p["begin"][q]
                    out["node"].append(node)
                    out["shingles"].append(p["shingles"][lo : lo + p["size"][q]].tobytes())
            yield out

    of_doc = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey")).agg(
        F.sort_array(F.collect_list(F.struct("node", "no"))).alias("_w")
    )
    of_doc = staged(of_doc, "wanted")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_k"))
    texts = keyed.join(
        of_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_tkey"))
    )
    found = map_batches(
        texts.select("_w.node", F.col("_w.no").cast("array<bigint>").alias("no"), "text"),
        run, "node bigint, shingles binary",
    )
    return found.dropDuplicates(["node"])


def _compare(threshold: float):
    def run(batches):
        out = {"a": [], "b": []}
        for (_, bi, bj), rows in pieces_of_work(batches, 3):
            left = [r for r in rows if r[0] == 0]
            right = left if bi == bj else [r for r in rows if r[0] == 1]
            if not left or not right:
                continue
            sets = [[np.frombuffer(r[2], dtype=np.uint64) for r in side] for side in (left, right)]
            hit = alike(*sets, threshold)
            ids = [[r[1] for r in side] for side in (left, right)]
            ones = [[1] * len(side) for side in (left, right)]
            for x, y in edges_and_counts(hit, *ids, *ones, bi == bj)[2]:
                out["a"].append(x)
                out["b"].append(y)
            if len(out["a"]) > 5000:
                yield out
                out = {"a": [], "b": []}
        yield out

    return run


def clusters(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Paragraphs of clusters that lie in two or more documents, with `cluster` and `keep`."""
    chosen = salts(bands(threshold, recall))
    repeated = staged(_repeated_keys(docs, chosen), "repeated-keys")
    found = staged(_candidates(docs, repeated, chosen), "candidates")
    classes = (
        found.groupBy("s1", "s2")
        .agg(F.min(F.struct("doc_id", "tkey", "no")).alias("one"))
        .select("s1", "s2", "one.*", F.monotonically_increasing_id().alias("node"))
    )
    classes = staged(classes, "classes")
    numbered = found.join(classes.select("s1", "s2", "node"), ["s1", "s2"])
    buckets = staged(
        numbered.where("size > 3").select("key", "node").distinct(), "buckets"
    )
    sizes = buckets.groupBy("key").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x")
    ).where("n > 1")
    sizes = sizes.groupBy("n", "x").agg(F.min("key").alias("key")).select("key", "n")
    members = staged(buckets.join(sizes, "key"), "members")
    wanted = classes.join(members.select("node").distinct(), "node").select(
        "node", "doc_id", "tkey", "no"
    )
    sets = staged(_sets(docs, wanted), "paragraph-sets")
    rows = (
        blocked(members.withColumn("spot", F.xxhash64("node")), ["key"])
        .join(sets, "node")
        .repartition("key", "bi", "bj")
        .sortWithinPartitions("key", "bi", "bj")
        .select("key", "bi", "bj", "side", "node", "shingles")
    )
    roots = components(map_batches(rows, _compare(threshold), "a bigint, b bigint"))
    named = classes.select("s1", "s2", "node").join(
        roots.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left"
    ).select("s1", "s2", F.coalesce("root", "node").alias("cluster"))
    places = (
        found.drop("key", "size").distinct().join(staged(named, "named"), ["s1", "s2"]).drop("s1", "s2")
    )
    places = staged(places, "places")
    who = F.xxhash64("doc_id", "tkey")
    spread_ = places.groupBy("cluster").agg(
        F.min(who).alias("lo"), F.max(who).alias("hi"),
        F.min(F.struct("doc_id", "tkey", "no")).alias("first"),
    ).where("lo <> hi")
    return places.join(spread_.drop("lo", "hi"), "cluster").withColumn(
        "keep", F.struct("doc_id", "tkey", "no").eqNullSafe(F.col("first"))
    ).drop("first")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, **tuning) -> DataFrame:
    """One row per part of a run whose paragraphs are all kept or all not: doc_id, tkey (hash of the
    text), start and length in characters, words, paragraphs, the clusters of its paragraphs, and
    keep. The least number of words is that of the whole run."""
    inside = Window.partitionBy("doc_id", "tkey").orderBy("no")
    alike_ = Window.partitionBy("doc_id", "tkey", "keep").orderBy("no")
    run = Window.partitionBy("doc_id", "tkey", "_gap")
    parts = (
        clusters(docs, **tuning)
        .withColumn("_gap", F.col("no") - F.row_number().over(inside))
        .withColumn("_part", F.col("no") - F.row_number().over(alike_))
        .withColumn("_run", F.max(F.col("word") + F.col("words")).over(run) - F.min("word").over(run))
        .where(F.col("_run") >= least_words)
        .groupBy("doc_id", "tkey", "_gap", "keep", "_part")
        .agg(
            F.min("start").alias("start"),
            (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"),
            (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("words"),
            F.count("*").alias("paragraphs"),
            F.sort_array(F.collect_set("cluster")).alias("clusters"),
        )
    )
    return parts.select(
        "doc_id", "tkey", "start", "length", "words", "paragraphs", "clusters", "keep"
    )


def without_repeats(docs: DataFrame, **tuning) -> DataFrame:
    """doc_id and text of all documents without the runs that are not kept."""
    gone = repeated_passages(docs, **tuning).where("not keep")
    spans = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey")).agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_spans")
    )
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_k"))
    joined = keyed.join(
        spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_tkey")), "left"
    )
    bounds = F.expr(
        "concat(array(struct(0L as a, coalesce(get(_spans, 0).start, cast(length(text) as bigint)) as b)), "
        "transform(coalesce(_spans, array()), (s, i) -> struct(s.start + s.length as a, "
        "coalesce(get(_spans, i + 1).start, cast(length(text) as bigint)) as b)))"
    )
    kept = joined.withColumn("_bounds", bounds).withColumn(
        "text",
        F.when(F.col("_spans").isNull(), F.col("text")).otherwise(
            F.expr(
                "array_join(transform(_bounds, x -> "
                "substr(text, cast(x.a + 1 as int), cast(x.b - x.a as int))), '')"
            )
        ),
    )
    return kept.select("doc_id", "text")


def op10_paragraph_banding(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "words", "paragraphs", "keep"
    )

"""Toxicity by class-conditional Kneser-Ney models of spelling and of words.

Both models exist once per class, toxic and ordinary, with absolute discounts, and both back off
to counts that the classes share, so that expressions that are rare in a class get the same
probability in both and speak for neither.

* Spelling: four-symbol grams over 32 folded symbols (letters, one each for blanks, digits and other
  signs, three for letters outside a-z). Each class interpolates its own four-gram counts with the
  continuation counts of the pooled grams, down to single symbols.
* Words: lower-case words, hashed into 2**WORD_BITS buckets. Each class interpolates its own counts
  with the pooled continuation counts, where a context is a document: in how many a word occurs.

All labelled training documents are counted, by Spark. What a document gets are the log-likelihood
ratios, toxic against ordinary: per symbol and per word of the whole text, those of its most toxic
passages, because a slur or two in a long text hardly move its mean, and the ratio of its plainly
toxic words, summed up, beside the number of its words, both on a logarithmic scale. A logistic curve over these, fitted on documents that
were not counted, turns them into a probability.

Of the rows with labels, remainder 0 of crc32(doc_id) modulo 5 is held out, remainder 4 fits the
curve (at most CALIBRATION_ROWS rows of it, those with the smallest hashes), the others are all
counted. The tables of ratios have a fixed number of entries whatever the size of the corpus, which
bounds what is collected and broadcast.

Null and empty texts have ratios 0 and get the score of the curve there. Null doc_ids are scored
and never learned from. A document with several labels is toxic if one says so; null labels are
left out. Repeated rows are scored each. If one class has no training rows, all ratios are 0.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, table
from .similar import word_hashes

SYMBOLS = 32
ORDER = 4
PASSAGE = 48
WORD_BITS = 21
WORD_PASSAGE = 12
#: Ratio of a word from which it is plainly toxic.
PLAIN = 2.5
CALIBRATION_ROWS = 50_000
FEATURES = ("mean", "passage", "word_mean", "word_passage", "plain", "long")
_LOOKUP = None
_WORD = re.compile(r"\w+")


def _lookup() -> np.ndarray:
    """Symbol of every UTF-16 unit."""
    global _LOOKUP
    if _LOOKUP is None:
        out = np.empty(1 << 16, dtype=np.uint8)
        for i in range(1 << 16):
            c = chr(i).lower()[0]
            if "a" <= c <= "z":
                out[i] = 1 + ord(c) - ord("a")
            elif c.isspace() or i < 32:
                out[i] = 0
            elif c.isdigit():
                out[i] = 27
            else:
                out[i] = 29 + ord(c) % 3 if c.isalpha() else 28
        _LOOKUP = out
    return _LOOKUP


def grams(text: str) -> np.ndarray:
    """The number of the gram that ends at each symbol; blanks stand before the text."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    symbols = np.concatenate([np.zeros(ORDER - 1, dtype=np.uint8), _lookup()[units]])
    out = symbols[: len(units)].astype(np.uint32)
    for i in range(1, ORDER):
        out *= np.uint32(SYMBOLS)
        out += symbols[i : i + len(units)]
    return out


def buckets(text: str) -> np.ndarray:
    """The bucket of each word."""
    mask = np.uint64((1 << WORD_BITS) - 1)
    return (word_hashes(_WORD.findall(text.lower())) & mask).astype(np.int64)


def counts(labelled: DataFrame) -> DataFrame:
    """kind (0: gram, 1: word), code, toxic and ordinary occurrences, and documents that hold it,
    of documents (text, toxic); summed up within each task first."""

    def run(batches):
        sizes = (SYMBOLS**ORDER, 1 << WORD_BITS)
        sums = [np.zeros((3, n), dtype=np.int32) for n in sizes]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for total, codes in zip(sums, (grams(text), buckets(text)) if text else ()):
                    found, n = np.unique(codes, return_counts=True)
                    total[1 - toxic, found] += n.astype(np.int32)
                    total[2, found] += 1
        for kind, total in enumerate(sums):
            found = np.flatnonzero(total[2])
            yield {
                "kind": np.full(len(found), kind), "code": found, "toxic": total[0, found],
                "ordinary": total[1, found], "held": total[2, found],
            }

    schema = "kind int, code bigint, toxic bigint, ordinary bigint, held bigint"
    parts = map_batches(labelled.select("text", "toxic"), run, schema)
    return parts.groupBy("kind", "code").agg(
        *[F.sum(c).alias(c) for c in ("toxic", "ordinary", "held")]
    )


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return once / (once + 2 * twice) if once and twice else 0.5


def _interpolated(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of the last symbol given those before it; `below` are those for a
    context shorter by its first symbol."""
    by_context = counts.reshape(-1, SYMBOLS).astype(np.float64)
    total = by_context.sum(axis=1, keepdims=True)
    discount = _discount(counts)
    kinds = np.count_nonzero(by_context, axis=1)[:, None]
    lower = np.broadcast_to(below.reshape(1, -1), (SYMBOLS, below.size)).reshape(-1, SYMBOLS)
    with np.errstate(invalid="ignore", divide="ignore"):
        seen = np.maximum(by_context - discount, 0) / total + discount * kinds / total * lower
    return np.where(total > 0, seen, lower)


def ratios(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(symbol | three before, toxic) - log P(the same, ordinary) of every gram."""
    pooled = toxic + ordinary
    kinds = pooled > 0
    levels = []  # continuation counts: kinds of symbols seen before a shorter gram
    for _ in range(ORDER - 1):
        kinds = kinds.reshape(SYMBOLS, -1)
        levels.append(kinds.sum(axis=0))
        kinds = levels[-1] > 0
    shared = np.full(1, 1.0 / SYMBOLS)
    for counts in reversed(levels):
        shared = _interpolated(counts, shared) if shared.size > 1 else _first(counts)
        shared = shared.reshape(-1)
    a, b = _interpolated(toxic, shared), _interpolated(ordinary, shared)
    return (np.log(a) - np.log(b)).reshape(-1).astype(np.float32)


def _first(counts: np.ndarray) -> np.ndarray:
    discount, total = _discount(counts), max(1, counts.sum())
    rest = discount * np.count_nonzero(counts) / total if counts.any() else 1.0
    return np.maximum(counts - discount, 0) / total + rest / SYMBOLS


def word_ratios(toxic: np.ndarray, ordinary: np.ndarray, held: np.ndarray) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of every bucket."""
    shared = _backed_off(held, np.full(len(held), 1.0 / len(held)))
    a, b = _backed_off(toxic, shared), _backed_off(ordinary, shared)
    return (np.log(a) - np.log(b)).astype(np.float32)


def _backed_off(counts_: np.ndarray, shared: np.ndarray) -> np.ndarray:
    discount, total = _discount(counts_), max(1, counts_.sum())
    rest = discount * np.count_nonzero(counts_) / total if counts_.any() else 1.0
    return np.maximum(counts_ - discount, 0) / total + rest * shared


def _of_passages(ratios_: np.ndarray, long: int) -> tuple[float, float]:
    """Mean, and the sum over the most toxic passage by its full length."""
    if not len(ratios_):
        return 0.0, 0.0
    sums = np.cumsum(ratios_, dtype=np.float64)
    best = sums[min(long, len(sums)) - 1]
    if len(sums) > long:
        best = max(best, np.max(sums[long:] - sums[:-long]))
    return sums[-1] / len(sums), best / long


def described(text: str | None, model: tuple[np.ndarray, np.ndarray]) -> tuple[float, ...]:
    """The FEATURES of a text."""
    if not text:
        return (0.0,) * len(FEATURES)
    words = model[1][buckets(text)]
    plain = np.log1p(float(words[words > PLAIN].sum()))
    return (
        *_of_passages(model[0][grams(text)], PASSAGE), *_of_passages(words, WORD_PASSAGE), plain,
        float(np.log1p(len(words))),
    )


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept last) of a slightly regularised logistic regression."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 20.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The tables of ratios and the weights of the curve."""
    usable = labels.where("toxic is not null and doc_id is not null")
    marks = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    counted = ~held_out() & (fold != 4)
    # labels grow with the corpus, so this join is never a broadcast
    known = (
        docs.select("doc_id", "text")
        .where(counted)
        .join(marks.where(counted).hint("merge"), "doc_id")
    )
    rows = counts(known).toArrow().to_pandas()
    sums = [np.zeros((3, n), dtype=np.int64) for n in (SYMBOLS**ORDER, 1 << WORD_BITS)]
    for kind, total in enumerate(sums):
        mine = rows[rows["kind"] == kind]
        total[:, mine["code"].to_numpy(dtype=int)] = mine[["toxic", "ordinary", "held"]].to_numpy().T
    curve = np.array([0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -2.0])
    if not sums[0][:2].any(axis=1).all():
        return tuple(np.zeros(t.shape[1], dtype=np.float32) for t in sums), curve
    model = ratios(*sums[0][:2]), word_ratios(*sums[1])
    # at most CALIBRATION_ROWS ids and labels
    chosen = marks.where(fold == 4).orderBy(F.xxhash64("doc_id")).limit(CALIBRATION_ROWS)
    sample = docs.select("doc_id", "text").where(fold == 4).join(F.broadcast(chosen), "doc_id")
    found = features(sample, model, "toxic").toArrow().to_pandas()
    if found["toxic"].nunique() == 2:
        curve = fit_curve(found[list(FEATURES)].to_numpy(), found["toxic"].to_numpy(dtype=float))
    return model, curve


def features(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], carried: str) -> DataFrame:
    """The features and one whole-number column carried along."""

    def run(batches):
        for batch in batches:
            found = [described(t, model) for t in batch.column(1).to_pylist()]
            columns = zip(*found) if found else [[]] * len(FEATURES)
            yield {carried: batch.column(0), **dict(zip(FEATURES, columns))}

    source = docs.select(F.col(carried).cast("bigint"), "text")
    schema = f"{carried} bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return map_batches(source, run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the features that the score is made of."""
    model, curve = fit(docs, labels)
    z = F.lit(float(curve[-1]))
    for name, weight in zip(FEATURES, curve):
        z = z + F.col(name) * float(weight)
    return features(docs, model, "doc_id").select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        (1 / (1 + F.exp(-z))).alias("score"),
        (z >= 0).cast("int").alias("predicted"),
        *FEATURES,
    )


def op4_kneser_ney_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Document quality by co-training of a text view and a metadata view.

Both views are additive classifiers over binned features: the log-odds of a bin, from smoothed
counts of good and bad documents, are added up, and the sum is calibrated into a probability by
an increasing step function. All counts are Spark aggregates over all rows; what comes to the
driver is one row per feature and bin.

* The text view describes the words and signs of the text.
* The metadata view describes the page: language, source, length, number and length of lines.

In every round each view gives its confident labels (calibrated probability at least CONFIDENT, or
at most 1 - CONFIDENT) to documents without a label, and the other view is counted anew with them.
True labels always stay. Calibration uses true labels only. The final score is the sum of the two
calibrated log-odds less that of the prior; the evidence of very short texts, of which most
features say little, is drawn towards the prior.

Null texts are described as empty. Null languages and sources are a bin of their own. Null labels
are left out; of several labels of a document the mean decides, a tie is good. Without any labels
every document scores 0.5 and is kept. Repeated rows are scored each. Extra columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import staged
from .common import put_back, set_aside, table

ROUNDS = 3
CONFIDENT = 0.97
SMOOTH = 1.0
TEXT = (
    "strange", "upper", "bars", "shouts", "digits", "ends", "distinct", "repeats", "word_length",
    "short_words", "entropy", "decorated",
)
META = ("length", "lines", "line_length", "same_lines")
NAMED = ("lang", "source")
BUCKETS = 64
SHARES = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98]
STEPS = 60
#: Characters at which the evidence of a text counts half.
SHORT = 40
_PLAIN_SIGNS = frozenset(b".,;:'\"!?-()| \n\t\r")


def describe(text: str | None) -> list[float]:
    """The text features, then the numeric metadata features."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = max(1, len(data))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    signs = sum(int(counts[i]) for i in range(33, 127) if not chr(i).isalnum())
    plain = sum(int(counts[i]) for i in _PLAIN_SIGNS if i > 32)
    words = text.split()
    many = max(1, len(words))
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    share = counts[counts > 0] / n
    lines = text.split("\n")
    upper = counts[65:91].sum() + sum(c.isupper() for c in set(text) if ord(c) > 127)
    return [
        (signs - plain) / n,
        upper / max(1, letters),
        counts[ord("|")] / many,
        counts[ord("!")] / many,
        counts[48:58].sum() / n,
        (counts[ord(".")] + counts[ord("?")]) / many,
        distinct / many ** 0.9,
        repeats / many,
        len(text) / many,
        sum(len(w) < 4 for w in words) / many,
        float(-(share * np.log2(share)).sum()),
        sum(not w[-1].isalpha() and w[-1] not in ".,;:" for w in words) / many,
        math.log1p(len(text)),
        math.log1p(len(lines)),
        math.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def described(texts: pd.Series) -> pd.Series:
    return pd.Series([describe(t) for t in texts])


@dataclass(frozen=True)
class View:
    """Log-odds of every feature's bins and the calibrated log-odds of their rounded sum."""

    odds: tuple[tuple[float, ...], ...]
    curve: tuple[float, ...] = ()

    def step(self, bins: list[str]) -> str:
        total = " + ".join(f"{_array(o)}[{b}]" for o, b in zip(self.odds, bins))
        at = f"cast(floor(({total}) * 2) as int) + {STEPS // 2}"
        return f"greatest(0, least({at}, {STEPS - 1}))"

    def logit(self, bins: list[str]) -> str:
        return f"{_array(self.curve)}[{self.step(bins)}]"


def _array(numbers) -> str:
    return "array(" + ",".join(f"{n!r}D" for n in numbers) + ")"


@dataclass(frozen=True)
class Model:
    cuts: tuple[tuple[float, ...], ...]
    text: View
    meta: View
    prior: float

    def score(self, described_: str, lang: str = "lang", source: str = "source") -> Column:
        """Probability that a document with these features is good."""
        text, meta = _bins(self.cuts, described_, lang, source)
        evidence = f"{self.text.logit(text)} + {self.meta.logit(meta)} - 2 * {self.prior!r}D"
        chars = f"(exp({described_}[{len(TEXT)}]) - 1)"
        z = f"{self.prior!r}D + ({evidence}) * {chars} / ({chars} + {SHORT})"
        return F.expr(f"1 / (1 + exp(-({z})))")


def _bins(cuts, described_: str, lang: str, source: str) -> tuple[list[str], list[str]]:
    """SQL of the bin of each feature, by view."""
    numeric = [
        "(0" + "".join(f" + int({described_}[{i}] > {cut!r}D)" for cut in cuts[i]) + ")"
        for i in range(len(TEXT) + len(META))
    ]
    named = [f"cast(pmod(xxhash64(coalesce({c}, '')), {BUCKETS}) as int)" for c in (lang, source)]
    return numeric[: len(TEXT)], numeric[len(TEXT) :] + named


def _counted(rows: DataFrame, bins: str, label: Column, sizes: list[int]) -> View:
    """A view from the counts of its bins among rows with that label."""
    counts = [np.full((2, n), SMOOTH) for n in sizes]
    seen = (
        rows.select(F.posexplode(bins).alias("feature", "bin"), label.alias("good"))
        .where("good is not null")
        .groupBy("feature", "bin", "good")
        .count()
    )
    for feature, bin_, good, n in seen.collect():
        counts[feature][good, bin_] += n
    odds = []
    for c in counts:
        share = c / c.sum(axis=1, keepdims=True)
        odds.append(tuple((np.log(share[1]) - np.log(share[0])).tolist()))
    return View(tuple(odds))


def _increasing(good: np.ndarray, bad: np.ndarray, prior: float) -> tuple[float, ...]:
    """Log-odds per step, pooled with their neighbours until they increase."""
    groups: list[list[float]] = []  # good, bad, steps
    rate = 1 / (1 + math.exp(-prior))
    for g, b in zip(good, bad):
        groups.append([float(g), float(b), 1])
        while len(groups) > 1 and _rate(groups[-2], rate) >= _rate(groups[-1], rate):
            last = groups.pop()
            groups[-1] = [x + y for x, y in zip(groups[-1], last)]
    out: list[float] = []
    for group in groups:
        p = _rate(group, rate)
        out += [math.log(p / (1 - p))] * int(group[2])
    return tuple(out)


def _rate(group, rate: float) -> float:
    g, b = group[0], group[1]
    return (g + rate) / (g + b + 1) if g + b else rate


def fit(
    docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, usable: Column | None = None
) -> Model | None:
    """Model from documents and labels (doc_id, quality); `usable` limits the labels used. None
    if there are no labels of one kind or the other."""
    marks = labels.where("quality is not null and doc_id is not null")
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy(F.col("doc_id").alias("_doc")).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("_good")
    )
    found = staged(
        docs.select("doc_id", described("text").alias("_x"), "lang", "source"), "described"
    )
    n = len(TEXT) + len(META)
    points = found.select(
        *[F.percentile_approx(F.element_at("_x", i + 1), SHARES, 2000).alias(str(i)) for i in range(n)]
    ).first()
    cuts = tuple(tuple(sorted(set(points[i] or ()))) for i in range(n))
    text, meta = _bins(cuts, "_x", "lang", "source")
    rows = staged(
        found.join(marks, found["doc_id"] == marks["_doc"], "left").select(
            F.expr(f"array({','.join(text)})").alias("_text"),
            F.expr(f"array({','.join(meta)})").alias("_meta"),
            "_good",
        ),
        "binned",
    )
    known = {r[0]: r[1] for r in rows.where("_good is not null").groupBy("_good").count().collect()}
    if len(known) < 2:
        return None
    prior = math.log(known[1] / known[0])
    sizes = [len(c) + 1 for c in cuts]
    sizes = {"_text": sizes[: len(TEXT)], "_meta": sizes[len(TEXT) :] + [BUCKETS] * len(NAMED)}
    columns = {v: [f"{v}[{i}]" for i in range(len(sizes[v]))] for v in sizes}

    def calibrated(views: dict[str, View]) -> dict[str, View]:
        steps = rows.where("_good is not null").select(
            "_good", *[F.expr(views[v].step(columns[v])).alias(v) for v in views]
        )
        counts = {v: np.zeros((2, STEPS)) for v in views}
        for good, a, b, many in steps.groupBy("_good", *views).count().collect():
            for v, at in zip(views, (a, b)):
                counts[v][good, at] += many
        return {
            v: View(views[v].odds, _increasing(counts[v][1], counts[v][0], prior)) for v in views
        }

    views = calibrated({v: _counted(rows, v, F.col("_good"), sizes[v]) for v in sizes})
    sure = math.log(CONFIDENT / (1 - CONFIDENT))
    for _ in range(rounds):
        other = {"_text": "_meta", "_meta": "_text"}
        new = {}
        for v in views:
            z = F.expr(views[other[v]].logit(columns[other[v]]))
            pseudo = F.when(z >= sure, 1).when(z <= -sure, 0)
            new[v] = _counted(rows, v, F.coalesce("_good", pseudo), sizes[v])
        views = calibrated(new)
    return Model(cuts, views["_text"], views["_meta"], prior)


_USED = ("text", "lang", "source")


def _judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, their other columns set aside, with `_p`, the probability of good."""
    inner = set_aside(docs, *_USED)
    if model is None:
        return inner.withColumn("_p", F.lit(0.5))
    return inner.withColumn("_x", described("text")).withColumn("_p", model.score("_x"))


def scored(docs: DataFrame, model: Model | None, score: str = "_score") -> DataFrame:
    """The documents with the score under that name, in one pass without a shuffle."""
    columns = [c for c in docs.columns if c != score]
    return put_back(_judged(docs, model), columns, _USED, F.col("_p").alias(score))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    good = _judged(docs, fit(docs, labels)).where("_p >= 0.5")
    return put_back(good, docs.columns, _USED)


def op8_co_training_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )

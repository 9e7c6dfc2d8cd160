"""Importance resampling towards a target distribution, on hashed word n-grams.

Texts are cut by Arrow kernels (ascii_lower, split_pattern_regex, list_flatten,
dictionary_encode). Dictionary indices shifted against each other give the n-grams; each distinct
one of a slice of texts is hashed once by CRC-32 and taken back to its places. A first pass over
the corpus and one over the target count the features of each bucket, summed within each task
before they are shuffled. The gains of the buckets, a list of `buckets` numbers whatever the size of
the corpus, go to the tasks of the second pass over the corpus, which takes each feature's gain and
sums by segments of documents. The draw takes the highest scores by their exact place among all,
see `positions`: ranges of scores are sorted apart, and no task sees them all.

Null and empty texts have no features and weight 0. Rows are kept one by one: rows with one doc_id
have one number drawn, and equal scores take places by doc_id, then by weight and number of
features. A null doc_id counts as '' in the number drawn, and as the smallest in ties. An
empty target or corpus counts as zero features. Extra columns play no part.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions
from ..session import staged
from .common import map_batches, table
from .terms import NO_LETTER_OR_DIGIT, sliced, words

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7


def _features(texts: pa.Array, longest: int, buckets: int):
    """(bucket of each feature by text, features per text, words per text)."""
    codes, distinct, at = words(texts, NO_LETTER_OR_DIGIT)
    codes = codes.astype(np.int64)
    spelled = [w.encode() for w in distinct.to_pylist()]
    tails = [b" " + w for w in spelled]
    sizes = np.diff(at)
    of_word = np.repeat(np.arange(len(sizes)), sizes)
    # `grams`: number, among the distinct runs of n words, of the run that begins at each word
    grams, sums = codes, np.array([zlib.crc32(w) for w in spelled], dtype=np.uint32)
    found, owners = [sums[grams] % buckets], [of_word]
    for n in range(2, longest + 1):
        shifted = codes[n - 1 :]
        inside = of_word[n - 1 :] == of_word[: len(shifted)]
        pairs = grams[: len(shifted)] * np.int64(max(1, len(spelled))) + shifted
        whole, numbers = np.unique(pairs[inside], return_inverse=True)
        heads, lasts = np.divmod(whole, max(1, len(spelled)))
        crc = zlib.crc32
        sums = np.array(
            [crc(tails[b], a) for a, b in zip(sums[heads].tolist(), lasts.tolist())], dtype=np.uint32
        )
        found.append(sums[numbers] % buckets)
        owners.append(of_word[: len(shifted)][inside])
        grams = np.zeros(len(shifted), dtype=np.int64)
        grams[inside] = numbers
    return np.concatenate(found), np.concatenate(owners), sizes


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """How many features of a column of texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in sliced(batches, 0):
            found, _, _ = _features(batch.column(0), longest, buckets)
            total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield {"bucket": some, "n": total[some]}

    counted = map_batches(texts, run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the counts of both."""
    sides = []
    for counts in (corpus, target):
        held = [0] * buckets
        for row in counts.collect():  # at most `buckets` rows
            held[row["bucket"]] = row["n"]
        sides.append(held)
    s_all, t_all = map(sum, sides)
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets))))
            for s, t in zip(*sides)
        ],
        dtype=np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, n_words and weight (floored mean gain) of every document."""
    buckets = len(gain)

    def run(batches):
        for batch in sliced(batches, 1):
            found, owners, sizes = _features(batch.column(1), longest, buckets)
            n = np.bincount(owners, minlength=len(sizes)).astype(np.int64)
            # sums stay whole numbers in doubles far below 2**53
            total = np.bincount(owners, weights=gain[found], minlength=len(sizes)).astype(np.int64)
            yield {
                "doc_id": batch.column(0), "n_features": n, "n_words": sizes,
                "weight": np.where(n > 0, total // np.maximum(n, 1), 0),
            }

    return map_batches(
        docs.select(F.col("doc_id").cast("bigint"), "text"), run,
        "doc_id bigint, n_features bigint, n_words bigint, weight bigint",
    )


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """A Gumbel draw in thousandths, fixed by the seed and the document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS,
) -> DataFrame:
    """Every document with its weight, its score, and its rank if it is drawn. `target` has a
    column of texts."""
    gain = gains(
        bucket_counts(docs.select("text"), longest, buckets),
        bucket_counts(target.select("text"), longest, buckets),
        buckets,
    )
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed=seed))
    scored = staged(scored, "scored")
    long_enough = F.col("n_words") >= least_words
    able = scored.where(long_enough)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranked = positions(able, order, "rank").withColumn(
        "rank", F.when(F.col("rank") <= drawn, F.col("rank"))
    )
    short = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_features(name: str, source: str, key: str) -> str:
    """`name` (key, f): the words and the pairs of neighbouring words of a table."""
    return f"""
{name}_words AS (
  SELECT {key} AS key, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM {source}),
{name} AS (
  SELECT key, unnest(w) AS f FROM {name}_words UNION ALL
  SELECT key, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM {name}_words)"""


OP11_SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
{_sql_features("corpus", "documents", "doc_id")},
{_sql_features("aim", "benchmark", "item_id")},
spelled AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM corpus UNION SELECT f FROM aim)),
bucketed AS (
  SELECT f, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2),
        lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket
  FROM spelled, crc_table),
s AS (SELECT bucket, count(*) AS n FROM corpus JOIN bucketed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN bucketed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(
      ((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM corpus) + {BUCKETS})::DOUBLE)
      / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + {BUCKETS})::DOUBLE)
    ))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN s USING (bucket)
  LEFT JOIN t USING (bucket)),
summed AS (
  SELECT key AS doc_id, count(*) AS n, sum(gain) AS total
  FROM corpus JOIN bucketed USING (f) JOIN gain USING (bucket) GROUP BY key),
weighed AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features,
    coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, len(w) >= {LEAST_WORDS} AS able,
    ('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents d JOIN corpus_words c ON c.key = d.doc_id LEFT JOIN summed USING (doc_id)),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM weighed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE able) // 100
    THEN place END AS rank
FROM ranked"""

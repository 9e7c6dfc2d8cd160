"""Where the sources of a language differ in their words, by ranking cells of counts.

Words of whole texts are cut by Arrow kernels and counted by (lang, source, term) within each task
before they are shuffled; a term is kept in a language with at least `least_docs` documents that
hold it. Shares are whole numbers of billionths, worked out exactly with decimals.

The words that a source uses more than its language does depend on two counts only, that of the
source and that of the language. So the terms of a source are grouped into cells of both counts, the
difference is worked out once per cell, cells with one difference are merged, and the merged ones
are ranked with the number of terms before each. Only cells that reach the ranks asked for are joined
back to their terms, which are put in UTF-8 order.

The difference of two sources is summed over terms in tasks that hold the counts of two blocks of
BLOCK sources for a share of the terms, and give one partial sum per pair; terms that neither
source holds add one product. So no row per pair and term is ever made, and a language that holds
most of the rows is spread by term.

Null text, lang and source are read as ''. A text without words gives its group no counts; a group
without kept terms keeps its pairs, with value 0 where the language keeps no term. Rows are counted
one by one, repeated ones included. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import map_batches, table
from .terms import NO_LETTER, sliced, words

LEAST_DOCS = 30
RANKS = 50
#: Sources that a task compares with as many others.
BLOCK = 64
#: Rows of counts that a task holds before it sums them up and sends them.
HELD = 400_000
#: Rows of counts for each share of a pair of blocks.
PORTION = 20_000
SCALE = 1_000_000_000
PRIOR = 5


def _read_as_empty(docs: DataFrame) -> DataFrame:
    return docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), of all terms."""

    def run(batches):
        held, many = [], 0

        def summed():
            rows = pa.concat_tables(held).group_by(["lang", "source", "term"])
            out = rows.aggregate([("n", "sum"), ("docs", "sum")])
            return pa.table(
                {
                    "lang": out["lang"], "source": out["source"], "term": out["term"],
                    "n": out["n_sum"], "docs": out["docs_sum"],
                }
            )

        def sent(rows):
            for part in rows.to_batches(max_chunksize=50_000):
                yield {name: part.column(name) for name in part.schema.names}

        for batch in sliced(batches, 2):
            codes, distinct, at = words(batch.column(2), NO_LETTER)
            if not len(codes):
                continue
            # groups of rows, and each word once per document
            names = pa.table({"lang": batch.column(0), "source": batch.column(1)})
            groups = names.group_by(["lang", "source"], use_threads=False).aggregate([])
            number = {k: i for i, k in enumerate(zip(*(groups[c].to_pylist() for c in ("lang", "source"))))}
            of_row = np.array(
                [number[k] for k in zip(*(names[c].to_pylist() for c in ("lang", "source")))], dtype=np.int64
            )
            many_words = np.int64(len(distinct))
            of_word = np.repeat(np.arange(len(of_row)), np.diff(at))
            per_doc, times = np.unique(of_word * many_words + codes, return_counts=True)
            rows, terms = np.divmod(per_doc, many_words)
            keys, where = np.unique(of_row[rows] * many_words + terms, return_inverse=True)
            group, term = np.divmod(keys, many_words)
            held.append(
                pa.table(
                    {
                        "lang": groups["lang"].combine_chunks().take(pa.array(group)),
                        "source": groups["source"].combine_chunks().take(pa.array(group)),
                        "term": distinct.take(pa.array(term)),
                        "n": np.bincount(where, weights=times).astype(np.int64),
                        "docs": np.bincount(where).astype(np.int64),
                    }
                )
            )
            many += len(keys)
            if many > HELD:
                held = [summed()]
                many = held[0].num_rows
                if many > HELD // 2:
                    yield from sent(held[0])
                    held, many = [], 0
        if held:
            yield from sent(summed())

    counted = map_batches(
        _read_as_empty(docs), run, "lang string, source string, term string, n bigint, docs bigint"
    )
    return counted.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + the whole billionths of (count + PRIOR) among (total + PRIOR * terms)."""

    def exact(x):
        return x.cast("decimal(19,0)")

    top, bottom = exact(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), exact(total + PRIOR * terms)
    return F.call_function("div", top, F.when(bottom > 0, bottom)) + 1


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Counts of the kept terms (lang, source, term, n, lang_n), and all groups (lang, source, no
    within the lang, total, terms, lang_total, rows of counts of the lang). Both are written out."""
    counts = staged(term_counts(docs), "term-counts")
    of_lang = (
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )
    kept = staged(counts.drop("docs").join(of_lang, ["lang", "term"]), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = (
        kept.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        .groupBy("lang")
        .agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"), F.sum("rows").alias("rows"))
    )
    none = {"total": 0, "terms": 0, "lang_total": 0, "rows": 0}
    groups = (
        _read_as_empty(docs).select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(none)
        .withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    )
    return kept, staged(groups, "groups")


def leading_terms(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """The terms that each source uses more than its language: item, value and rank."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("many"))
    valued = (
        cells.join(groups, ["lang", "source"])
        .withColumn(
            "value",
            share(F.col("n"), F.col("total"), F.col("terms"))
            - share(F.col("lang_n"), F.col("lang_total"), F.col("terms")),
        )
        .where("value > 0")
        .select("lang", "source", "n", "lang_n", "many", "value")
    )
    of_group = Window.partitionBy("lang", "source")
    # each merged cell holds a term at least, so no more than `ranks` of them matter
    merged = (
        valued.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
        .withColumn("place", F.row_number().over(of_group.orderBy(F.desc("value"))))
        .where(F.col("place") <= ranks)
        .withColumn("before", F.sum("many").over(of_group.orderBy(F.desc("value"))) - F.col("many"))
        .where(F.col("before") < ranks)
        .select("lang", "source", "value")
    )
    chosen = valued.join(merged, ["lang", "source", "value"]).drop("many")
    return (
        kept.join(chosen, ["lang", "source", "n", "lang_n"])
        .withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), F.asc("term"))))
        .where(F.col("rank") <= ranks)
        .select("lang", "source", F.col("term").alias("item"), "value", "rank")
    )


def _distances(block: int):
    """Partial sums of one share of the terms of a pair of blocks: for each pair of sources, the sum
    of differences of the terms that any source of either block holds, and their number. Rows
    without a term name the sources of both blocks, with their share of a term they do not hold."""

    def done(key, rows):
        lang, bi, bj, _ = key
        codes = {t: i for i, t in enumerate(dict.fromkeys(r[0] for r in rows if r[0] is not None))}
        low = {no: zero for term, no, _, zero in rows if term is None}
        column = {no: i for i, no in enumerate(sorted(low))}
        held = [r for r in rows if r[0] is not None]
        matrix = np.tile(np.array([low[no] for no in column], dtype=np.int64), (len(codes), 1))
        matrix[[codes[r[0]] for r in held], [column[r[1]] for r in held]] = [r[2] for r in held]
        out = {"lang": [], "a": [], "b": [], "part": [], "seen": []}
        right = [no for no in column if no // block == bj]
        theirs = matrix[:, [column[no] for no in right]]
        for a in (no for no in column if no // block == bi):
            sums = np.abs(theirs - matrix[:, [column[a]]]).sum(axis=0).tolist()
            for b, part in zip(right, sums):
                if a < b:
                    out["lang"].append(lang)
                    out["a"].append(a)
                    out["b"].append(b)
                    out["part"].append(part)
                    out["seen"].append(len(codes))
        return out

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != key:
                    if rows:
                        yield done(key, rows)
                    key, rows = row[:4], []
                rows.append(row[4:])
        if rows:
            yield done(key, rows)

    return run


def source_distances(
    kept: DataFrame, groups: DataFrame, block: int = BLOCK, portion: int = PORTION
) -> DataFrame:
    """For each source every other one of its language: item, value and rank."""
    # a pair of blocks holds about this many rows of its language, dealt into shares by term
    blocks = F.ceil((F.max("no").over(Window.partitionBy("lang")) + 1) / block)
    numbered = groups.withColumns(
        {"zero": share(F.lit(0), F.col("total"), F.col("terms")), "blocks": blocks}
    ).withColumn("shares", F.ceil(F.col("rows") * 2 / (F.col("blocks") * portion)))
    numbered = staged(numbered, "numbered")
    held = kept.join(numbered, ["lang", "source"]).select(
        "lang", "no", "zero", "blocks", "term",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        F.pmod(F.xxhash64("term"), F.col("shares")).cast("int").alias("salt"),
    )
    named = numbered.where("shares > 0").select(
        "lang", "no", "zero", "blocks", F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("bigint").alias("p"),
        F.explode(F.sequence(F.lit(0), (F.col("shares") - 1).cast("int"))).alias("salt"),
    )
    mine = F.floor(F.col("no") / block).cast("int")
    blocked = (
        held.unionByName(named)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .select(
            "lang", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
            "salt", "term", F.col("no").cast("bigint").alias("no"), "p", "zero",
        )
        .repartition("lang", "bi", "bj", "salt")
        .sortWithinPartitions("lang", "bi", "bj", "salt")
    )
    schema = "lang string, a bigint, b bigint, part bigint, seen bigint"
    sums = (
        map_batches(blocked, _distances(block), schema)
        .groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
        .withColumnsRenamed({"a": "lo", "b": "hi", "lang": "of"})
    )
    one = numbered.select(
        "lang", F.col("no").alias("a"), "source", F.col("zero").alias("zero_a"), "terms"
    )
    two = numbered.select(
        "lang", F.col("no").alias("b"), F.col("source").alias("item"), F.col("zero").alias("zero_b")
    )
    # one row per ordered pair of sources of a language: what is asked for
    pairs = one.join(two, "lang").where("a <> b")
    same = (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi"))
    summed = pairs.join(sums, (F.col("lang") == F.col("of")) & same, "left")
    unseen = F.col("terms") - F.coalesce("seen", F.lit(0))
    rest = F.when(unseen > 0, unseen * F.abs(F.col("zero_a") - F.col("zero_b"))).otherwise(0)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return summed.withColumn("value", F.coalesce("part", F.lit(0)) + rest).select(
        "lang", "source", "item", "value", F.row_number().over(order).alias("rank")
    )


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    kept, groups = kept_terms(docs, least_docs)
    parts = [
        found.withColumn("part", F.lit(part))
        for part, found in (
            ("pair", source_distances(kept, groups)),
            ("term", leading_terms(kept, groups, ranks)),
        )
    ]
    return parts[0].unionByName(parts[1]).select(
        "lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"),
        F.col("rank").cast("int").alias("rank"),
    )


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
found AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
terms AS (
  SELECT lang, term, count(*) AS c FROM found GROUP BY lang, term
  HAVING count(DISTINCT row) >= {LEAST_DOCS}),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM found JOIN terms USING (lang, term)
  GROUP BY lang, source, term),
langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN terms USING (lang) GROUP BY lang),
sources AS (
  SELECT lang, source, coalesce(sum(c), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source)
  GROUP BY lang, source),
shares AS (
  SELECT s.lang, s.source, t.term, coalesce(k.c, 0) AS c,
    (1 + ({SCALE}::HUGEINT * (coalesce(k.c, 0) + {PRIOR})) // (s.n + {PRIOR} * l.v))::BIGINT AS p,
    (1 + ({SCALE}::HUGEINT * (t.c + {PRIOR})) // (l.n + {PRIOR} * l.v))::BIGINT AS q
  FROM sources s JOIN langs l USING (lang) JOIN terms t USING (lang)
  LEFT JOIN counts k ON k.lang = s.lang AND k.source = s.source AND k.term = t.term),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {RANKS}"""

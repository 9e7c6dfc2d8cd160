"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of the last WINDOW lines decides where a chunk of lines ends, so
lines put in or taken out move the boundaries next to them and no others. What is compared are units
of several lines: each chunk of several lines, and, because a chunk may be one line, each two
neighbouring chunks of which one or both are one line. Of units that occur more than once anywhere,
all but the first occurrence (by doc_id, then by the hash of the text, then by place) go: a
chunk of several lines as such, a pair with its chunks of one line. So single lines inside a copied
stretch go with it, and a line that is repeated alone, between other neighbours, stays. Units are first
matched by a 64-bit hash; those of the repeated hashes are then compared byte by byte, by grouping
on the text itself.

Counts combine within each task before they are shuffled, so that a chunk that a third of all rows
share costs one row per task; joins on hot chunks carry no order and may be split by Spark. The
texts are shuffled twice, by document, at any size: lists of chunks grow with the corpus, so they
are never broadcast.

Null texts stay null, empty texts stay empty; a text whose chunks are all removed becomes empty.
Rows that agree in doc_id and text are one document: they are treated alike, and do not count
as repetitions of one another. Null doc_ids come first. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import put_back, set_aside, table

WINDOW = 2
DIVISOR = 3
#: Factor of the rolling hash.
FACTOR = 1_000_003


def chunked(docs: DataFrame) -> DataFrame:
    """The documents with `_key`, a hash of the text, and `_chunks`, an array of (no, lines, body).

    Explode `_chunks` with explode_outer: for explode, Spark infers a filter on the array and pushes
    it below the steps here, where it would work out all of them anew for each line."""
    hashed = docs.withColumns({"_key": F.xxhash64("text"), "_lines": F.split("text", "\n", -1)})
    hashed = hashed.withColumn(
        "_hashes",
        F.transform(
            "_lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("bigint")
        ),
    )
    rolled = " + ".join(
        f"coalesce(try_element_at(_hashes, nullif(greatest(i - {back}, 0), 0)), 0) * {FACTOR**back}"
        for back in range(WINDOW)
    )
    ends = hashed.withColumn(
        "_ends",
        F.expr(
            f"filter(sequence(1, size(_hashes)), i -> i = size(_hashes) or ({rolled}) % {DIVISOR} = 0)"
        ),
    )
    begin = "if(k = 0, 0, _ends[k - 1])"
    body = f"array_join(slice(_lines, {begin} + 1, e - {begin}), '\n')"
    chunks = f"transform(_ends, (e, k) -> struct(k as no, e - {begin} as lines, {body} as body))"
    return ends.withColumn("_chunks", F.expr(chunks)).drop("_lines", "_hashes", "_ends")


def _units(docs: DataFrame) -> DataFrame:
    """The documents with `_units`, an array of (unit, gone, body): a chunk of several lines is the unit
    2 * no, one with the next chunk 2 * no + 1; `gone` are the chunks that a repeated unit removes."""
    alone = F.expr(
        """transform(filter(_chunks, c -> c.lines > 1),
          c -> struct(c.no * 2 as unit, array(c.no) as gone, c.body as body))"""
    )
    single = "filter(array(c, n), x -> x.lines = 1)"
    pairs = F.expr(
        f"""filter(
          zip_with(_chunks, slice(_chunks, 2, greatest(size(_chunks) - 1, 0)), (c, n) -> struct(
            c.no * 2 + 1 as unit, transform({single}, x -> x.no) as gone,
            concat(c.body, '\n', n.body) as body)),
          u -> u.body is not null and size(u.gone) > 0)"""
    )
    return chunked(docs).withColumn("_units", F.concat(alone, pairs)).drop("_chunks")


def removals(docs: DataFrame) -> DataFrame:
    """_doc, _key, _nos: the numbers of the chunks to remove from each document."""
    key = F.col("doc_id").alias("_doc"), "_key"
    hashed = "transform(_units, u -> struct(u.unit as unit, xxhash64(u.body) as hash))"
    places = (
        _units(docs.select("doc_id", "text"))
        .select(*key, F.explode_outer(F.expr(hashed)).alias("_u"))
        .where("_u is not null")
        .select("_doc", "_key", "_u.*")
        .distinct()
    )
    repeated = places.groupBy("hash").count().where("count > 1").select("hash")
    wanted = (
        places.join(repeated, "hash", "left_semi")
        .groupBy("_doc", "_key")
        .agg(F.collect_set("unit").alias("_wanted"))
    )
    wanted = staged(wanted, "repeated-units")
    # the texts of those units only
    texts = docs.select("doc_id", "text").withColumn("_k", F.xxhash64("text"))
    texts = texts.join(
        wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key"))
    ).select("doc_id", "text", "_wanted")
    chosen = (
        _units(texts)
        .withColumn("_units", F.filter("_units", lambda u: F.array_contains("_wanted", u["unit"])))
        .select(*key, F.explode_outer("_units").alias("_u"))
        .where("_u is not null")
        .select("_doc", "_key", "_u.*", F.xxhash64("_u.body").alias("hash"))
    )
    chosen = staged(chosen.distinct(), "unit-texts")
    first = F.min(F.struct("_doc", "_key", "unit")).alias("first")
    groups = chosen.groupBy("hash", "body").agg(first, F.count("*").alias("n")).where("n > 1")
    again = chosen.join(groups, ["hash", "body"]).where(
        ~F.struct("_doc", "_key", "unit").eqNullSafe(F.col("first"))
    )
    return (
        again.select("_doc", "_key", F.explode("gone").alias("no"))
        .groupBy("_doc", "_key")
        .agg(F.collect_set("no").alias("_nos"))
    )


def dedup_lines(docs: DataFrame, removed: str | None = "_removed") -> DataFrame:
    """The documents with repeated chunks removed from `text`, `n_chars` (if there is one)
    brought up to date, and the number of chunks removed, under the given name (None: without)."""
    gone = staged(removals(docs), "removals")
    used = ("doc_id", "text")
    keyed = set_aside(docs, *used).withColumn("_k", F.xxhash64("text"))
    joined = keyed.join(
        gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key")), "left"
    ).drop("_doc", "_key", "_k")
    parts = chunked(joined)
    stay = F.filter("_chunks", lambda c: ~F.array_contains("_nos", c["no"]))
    text = F.when(F.col("_nos").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda c: c["body"]), "\n")
    )
    out = parts.withColumn("text", text)
    if "n_chars" in docs.columns:
        used += ("n_chars",)
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    number = [] if removed is None else [F.coalesce(F.size("_nos"), F.lit(0)).alias(removed)]
    return put_back(out, [c for c in docs.columns if c != removed], used, *number)


def op3_line_chunks(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.col("_removed").alias("chunks_removed")
    )


def line_sql(documents: str = "documents", window: int = WINDOW, divisor: int = DIVISOR) -> str:
    """Statements that give `cleaned` (doc_id, text, chunks_removed), for unique doc_ids."""
    rolled = " + ".join(
        f"coalesce(lag(h, {back}) OVER w, 0) * {FACTOR**back}" if back else "h"
        for back in range(window)
    )
    return f"""
lined AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM {documents} WHERE text IS NOT NULL)),
ended AS (
  SELECT *, CASE WHEN ({rolled}) % {divisor} = 0 THEN 1 ELSE 0 END AS ends
  FROM lined WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended),
chunks AS (
  SELECT doc_id, no, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, no),
beside AS (
  SELECT *, lead(lines) OVER w AS lines_after, lead(body) OVER w AS body_after
  FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
units AS (
  SELECT doc_id, no, lines > 1 AS first_goes, false AS second_goes, body FROM beside WHERE lines > 1
  UNION ALL
  SELECT doc_id, no, lines = 1, lines_after = 1, body || chr(10) || body_after FROM beside
  WHERE lines = 1 AND body_after IS NOT NULL OR lines_after = 1),
again AS (
  SELECT * FROM units
  QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, no) > 1),
marked AS (
  SELECT doc_id, no FROM again WHERE first_goes
  UNION SELECT doc_id, no + 1 FROM again WHERE second_goes),
judged AS (
  SELECT c.*, m.no IS NOT NULL AS gone
  FROM chunks c LEFT JOIN marked m ON c.doc_id IS NOT DISTINCT FROM m.doc_id AND c.no = m.no),
cleaned AS (
  SELECT d.doc_id,
    CASE WHEN d.text IS NOT NULL THEN
      coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') END AS text,
    (count(*) FILTER (WHERE gone))::INTEGER AS chunks_removed
  FROM {documents} d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id, d.text)"""


OP3_SQL = f"WITH {line_sql()} SELECT * FROM cleaned"

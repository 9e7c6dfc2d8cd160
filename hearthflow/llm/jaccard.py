"""Near-duplicate documents by a chosen-path similarity join on word shingles.

Documents are sets of five-word shingles (words in lower case, without punctuation; shorter texts
are one shingle), similar at a Jaccard similarity of 0.8 or more. Documents with equal sets are one
class from the start, so copies are never paired.

The join splits the classes recursively on sampled tokens of their sets. The token sampled at a step
is the one with the smallest hash under that step's salt, which two sets share with a probability
equal to their similarity. A bucket of at most BLOCK classes is compared by brute force, a larger
one is split again on a further token; one whose members are mostly alike, which splitting would
only tear, or which has been split DEPTH times, is compared in pairs of blocks instead, so nothing
is capped. A pair at the threshold survives d splits with probability 0.8**d; batches of runs with
new salts are repeated until the product of the misses over all runs, at the deepest split that
each run made, is below 1 - RECALL.

All runs go through Spark as rows of (class, bucket). Buckets with the same members as one of an
earlier run are compared once. In a bucket, a pair counts only if it met in no earlier run, which
the rows' own bucket keys tell; so links are counted once without a list of pairs, and each bucket
emits at most one row per member and a spanning forest of its links. Members that agree with no
other one of their bucket in so many of all sampled tokens as a pair at the threshold does with a
probability above 0.99999 are dropped first; similarity is exact, on the whole sets of the
others. Components of the links are the groups.

Documents without any word (null or empty texts too) are groups of their own without links. Rows
that repeat a document are copies. Null doc_ids are kept; a group without any doc_id has class_id
null. Extra columns play no part.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import map_batches, put_back, set_aside, table
from .similar import (
    BLOCK,
    THRESHOLD,
    WIDTH,
    alike,
    blocked,
    components,
    edges_and_counts,
    minhashes,
    pieces_of_work,
    salts,
    set_key,
    shingles,
    word_hashes,
)

RUNS = 8
DEPTH = 4
RECALL = 0.999
#: Share of pairs of a bucket that a split would keep together, from which it is not split.
DENSE = 0.5
_WORD = re.compile(r"\w+")


def shingle_set(text: str | None) -> np.ndarray:
    return shingles(word_hashes(_WORD.findall((text or "").lower())), WIDTH)


def _described(docs: DataFrame, batch_no: int) -> DataFrame:
    """doc_id, tkey (hash of the text), skey (hash of the set, null without words) and the sampled
    tokens of all steps."""
    chosen = salts(RUNS * DEPTH, seed=batch_no)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            yield {
                "doc_id": batch.column(0),
                "tkey": batch.column(1),
                "skey": [set_key(s) if len(s) else None for s in sets],
                "tokens": [
                    (minhashes(s, chosen) >> np.uint64(33)).astype(np.int32) if len(s) else None
                    for s in sets
                ],
            }

    return map_batches(
        docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tkey"), "text"),
        run,
        "doc_id bigint, tkey bigint, skey string, tokens array<int>",
    )


def _leaves(nodes: DataFrame, first_run: int) -> tuple[DataFrame, dict[int, int]]:
    """(uid, run, leaf, n) of the buckets of two or more to compare, and each run's depth."""
    of_run = F.transform(
        F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.slice("tokens", r * DEPTH + 1, DEPTH)
    )
    rows = nodes.select("uid", F.posexplode(of_run).alias("run", "tokens"))
    rows = rows.withColumn("run", F.col("run") + first_run)
    rows = rows.withColumn("path", F.xxhash64("run", F.col("tokens")[0]))
    sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(rows.join(sizes, "path"), "level")
    done = [rows.where(F.col("n") <= BLOCK).select("uid", "run", F.col("path").alias("leaf"), "n")]
    depth = {first_run + r: 1 for r in range(RUNS)}
    for level in range(1, DEPTH):
        big = rows.where(F.col("n") > BLOCK)
        if big.isEmpty():
            return _union(done), depth
        split = big.withColumn("child", F.xxhash64("path", F.col("tokens")[level]))
        sizes = split.groupBy("path", "child", "n").agg(F.count("*").alias("m"))
        kept = F.sum(F.col("m").cast("double") * F.col("m")) / F.first("n") / F.first("n")
        dense = sizes.groupBy("path").agg((kept >= DENSE).alias("dense"))
        sizes = sizes.join(dense, "path").drop("n")
        rows = staged(split.join(sizes, ["path", "child"]), "level")
        done.append(rows.where("dense").select("uid", "run", F.col("path").alias("leaf"), "n"))
        rows = rows.where(~F.col("dense") & (F.col("m") > 1)).select(
            "uid", "run", "tokens", F.col("child").alias("path"), F.col("m").alias("n")
        )
        for r in rows.select("run").distinct().collect():
            depth[r["run"]] = level + 1
        done.append(
            rows.where(F.col("n") <= BLOCK).select("uid", "run", F.col("path").alias("leaf"), "n")
        )
    done.append(rows.where(F.col("n") > BLOCK).select("uid", "run", F.col("path").alias("leaf"), "n"))
    return _union(done), depth


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sides(rows: list[tuple], same: bool) -> tuple[list, list]:
    """Rows (side, uid, ...) of the two sides of a piece of work, one per class."""
    left = list({r[1]: r for r in rows if r[0] == 0}.values())
    return left, left if same else list({r[1]: r for r in rows if r[0] == 1}.values())


def least_agreeing(threshold: float) -> int:
    """Sampled tokens in which a pair at the threshold agrees at least, but for one in 10**5."""
    n = RUNS * DEPTH
    return max(1, int(n * threshold - 5.5 * math.sqrt(n * threshold * (1 - threshold))))


def _promising(threshold: float):
    """(leaf, uid) of the members that agree with another one in enough sampled tokens; rows
    (side, uid, tokens)."""
    least = least_agreeing(threshold)

    def run(batches):
        out = {"leaf": [], "uid": []}
        for (leaf, bi, bj), rows in pieces_of_work(batches, 3):
            left, right = _sides(rows, bi == bj)
            if not left or not right:
                continue
            tokens = [np.array([r[2] for r in side]) for side in (left, right)]
            agreeing = np.zeros((len(left), len(right)), dtype=np.int16)
            for i in range(tokens[0].shape[1]):
                agreeing += tokens[0][:, i, None] == tokens[1][None, :, i]
            hit = agreeing >= least
            if bi == bj:
                np.fill_diagonal(hit, False)
            for side, chosen in ((left, hit.any(axis=1)), (right, hit.any(axis=0))):
                for i in np.flatnonzero(chosen).tolist():
                    out["leaf"].append(leaf)
                    out["uid"].append(side[i][1])
            if len(out["leaf"]) > 5000:
                yield out
                out = {"leaf": [], "uid": []}
        yield out

    return run


def _compare(threshold: float):
    """Links and a spanning forest of one piece of work; rows (side, uid, run, size, keys, set)."""

    def run(batches):
        out = {"a": [], "b": [], "links": []}
        for (_, bi, bj), rows in pieces_of_work(batches, 3):
            same = bi == bj
            left, right = _sides(rows, same)
            if not left or not right:
                continue
            sets = [[np.frombuffer(r[5], dtype=np.uint64) for r in side] for side in (left, right)]
            hit = alike(*sets, threshold)
            this = left[0][2]
            if this:
                keys = [np.array([r[4][:this] for r in side], dtype=np.int64) for side in (left, right)]
                for k in range(this):
                    a, b = keys[0][:, k], keys[1][:, k]
                    hit &= ~((a[:, None] == b[None, :]) & (a != 0)[:, None])
            ids = [[r[1] for r in side] for side in (left, right)]
            weights = [[r[3] for r in side] for side in (left, right)]
            links_l, links_r, forest = edges_and_counts(hit, *ids, *weights, same)
            for side, links in ((0, links_l), (1, links_r)):
                if links is not None:
                    for i in np.flatnonzero(links).tolist():
                        out["a"].append(ids[side][i])
                        out["b"].append(None)
                        out["links"].append(int(links[i]))
            for x, y in forest:
                out["a"].append(x)
                out["b"].append(y)
                out["links"].append(0)
            if len(out["a"]) > 5000:
                yield out
                out = {"a": [], "b": [], "links": []}
        yield out

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of the group), n_links
    (documents at least that similar), copy_of (the smallest doc_id with an equal set), tkey (hash
    of the text) and first (whether it is the one of its group that comes first by doc_id, nulls
    last, then tkey)."""
    described = _described(docs, 0).withColumn("uid", F.monotonically_increasing_id())
    described = staged(described, "sets")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey")
    classes = described.where("skey is not null").groupBy("skey").agg(
        F.min("uid").alias("uid"), F.count("*").alias("size"), F.min(order).alias("first_row")
    )
    classes = classes.withColumn("copy_of", F.col("first_row.doc_id"))
    classes = staged(classes, "classes")
    found, miss, batch_no, parts = classes.join(described, ["skey", "uid"]), 1.0, 0, []
    tokens = found.select("uid", "tokens")
    while True:
        leaves, depth = _leaves(found.select("uid", "tokens"), batch_no * RUNS)
        parts.append(leaves)
        for d in depth.values():
            miss *= 1 - threshold**d
        if miss <= 1 - recall:
            break
        batch_no += 1
        again = _described(docs, batch_no).select("skey", "tokens").dropDuplicates(["skey"])
        found = classes.join(again, "skey")
    runs = (batch_no + 1) * RUNS
    members = staged(_union(parts), "members")
    alike_ = members.groupBy("leaf").agg(
        F.min("run").alias("run"), F.min("n").alias("n"),
        F.expr("bit_xor(xxhash64(uid))").alias("y"),
    ).groupBy("n", "y").agg(F.min(F.struct("run", "leaf")).alias("kept"))
    kept = alike_.select(F.col("kept.leaf").alias("leaf"))
    at = F.map_from_entries(F.collect_list(F.struct("run", "leaf")))
    keys = members.groupBy("uid").agg(at.alias("at"))
    keys = keys.select(
        "uid", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at("at", r), F.lit(0).cast("bigint"))).alias("keys"),
    )
    dealt = blocked(members.join(kept, "leaf").withColumn("spot", F.xxhash64("uid")), ["leaf"])
    drawn = (
        dealt.join(tokens, "uid")
        .repartition("leaf", "bi", "bj")
        .sortWithinPartitions("leaf", "bi", "bj")
        .select("leaf", "bi", "bj", "side", "uid", "tokens")
    )
    promising = map_batches(drawn, _promising(threshold), "leaf bigint, uid bigint").distinct()
    dealt = dealt.join(staged(promising, "promising"), ["leaf", "uid"])
    work = F.collect_list(F.struct("leaf", "bi", "bj", "side", "run")).alias("work")
    people = staged(
        dealt.groupBy("uid").agg(work).join(classes.select("uid", "skey", "size"), "uid").join(keys, "uid"),
        "people",
    )
    rows = (
        _sets(docs, described, people)
        .select(F.explode("work").alias("w"), "uid", "size", "keys", "shingles")
        .select("w.leaf", "w.bi", "w.bj", "w.side", "uid", "w.run", "size", "keys", "shingles")
        .repartition("leaf", "bi", "bj")
        .sortWithinPartitions("leaf", "bi", "bj")
    )
    compared = staged(
        map_batches(rows, _compare(threshold), "a bigint, b bigint, links bigint"), "links"
    )
    links = compared.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    roots = components(compared.where("b is not null").select("a", "b"))
    grouped = classes.join(links, "uid", "left").join(
        roots, classes["uid"] == roots["node"], "left"
    ).withColumn("root", F.coalesce("root", "uid"))
    names = grouped.groupBy("root").agg(F.min("first_row").alias("first_of_all"))
    grouped = grouped.join(names, "root").select(
        "skey", "copy_of", "first_of_all",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    own = described.select("doc_id", "tkey", F.col("skey").alias("k"))
    alone = F.col("k").isNull()
    return own.join(grouped, F.col("k") == F.col("skey"), "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_of_all.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        "tkey",
        (alone | order.eqNullSafe(F.col("first_of_all"))).alias("first"),
    )


def _sets(docs: DataFrame, described: DataFrame, people: DataFrame) -> DataFrame:
    """The people with the whole set of each class; one whose row is repeated comes repeatedly."""
    own = described.select(
        "uid", F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey")
    )
    who = staged(people.drop("skey").join(own, "uid"), "who")

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_k"))
    texts = keyed.join(
        who, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_tkey"))
    )
    return texts.select("uid", "work", "size", "keys", whole("text").alias("shingles"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the first of it, with all its columns. Rows that agree
    in doc_id and text are one document, of which one row stays."""
    groups = near_duplicates(docs.select("doc_id", "text"))
    groups = staged(groups.select("doc_id", "tkey", "first"), "groups")
    stay = groups.where("first").select(
        F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey")
    )
    used = ("doc_id", "text")
    kept = set_aside(docs, *used).withColumn("_k", F.xxhash64("text")).join(
        stay, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_tkey")), "left_semi"
    )
    again = groups.where("first").groupBy("doc_id", "tkey").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return put_back(kept, docs.columns, used)


def op5_chosen_path_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def groups_sql(documents: str = "documents") -> str:
    """Common table expressions that end in `grouped` (doc_id, class_id, n_links)."""
    return f"""
worded AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {documents}),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) <= {WIDTH} THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + {WIDTH - 1}], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS i
        FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE k >= {THRESHOLD} * (p.n + q.n - k) - 1e-9),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM {documents}
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
grouped AS (
  SELECT d.doc_id, (SELECT min(b) FROM reached r WHERE r.a = d.doc_id) AS class_id,
    (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
  FROM {documents} d)"""


OP5_SQL = f"WITH RECURSIVE {groups_sql()} SELECT * FROM grouped"

"""WARC archives: written by Spark as plain files, read back in splits by boundary chains.

Writing. Every page becomes one WARC/1.1 record of an HTTP response. Of pages with equal payloads
the one with the largest page_id is a `response` record, the others are `revisit` records that
refer to it and carry its digest instead of the payload. The text writer puts the records into
files, with the blank lines that end a record as its line separator, so commits, retries and any
file system are Spark's.

Reading. A file is read in splits as the stretches between two occurrences of the magic, `WARC/1.`
So every candidate record is one row, and a payload that holds the magic yields false candidates.
A task works out for each candidate the offset of its successor from its header, and where the
chain from it leaves the task's split. Sums of the splits' lengths turn offsets within splits into
offsets within files. Pointer jumping by joins then follows the chain over the splits of a file
from its start, doubling the jump in each round; it handles one row per split and place where a
chain enters, never a record. What it reaches is the first record of each split, and a second pass
over the files walks from there, so that only records reachable from the start of the file come
out, whole, also those whose payload holds the magic or reaches over several splits.

Null payloads are empty. Pages with a null page_id count as smaller than any id; rows that share
the largest page_id and payload are all responses. Null urls are left out of the header, line
breaks in urls are escaped. An empty table gives an empty archive. Extra columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged, staging_path
from .common import map_batches, table

MAGIC = "WARC/1."
LEAST_BYTES = 0
#: The alphabet of base 32 and the digits that conv() gives for it (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def digest(payload) -> Column:
    """SHA-1 in base 32, upper case."""
    hexed = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    described = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload"))
    described = described.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": digest("payload")}
    )
    narrow = described.where(F.col("payload_bytes") >= least_bytes)
    top = narrow.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("pages")
    )
    # written out, so that its size is known when the join with the payloads is planned
    shared = staged(top.where("pages > 1").drop("pages"), "shared-payloads")
    joined = described.join(shared, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn(
        "refers_to",
        F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), None).otherwise(F.col("refers_to")),
    )


def _record_id(page_id, sha1) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), sha1, F.lit(">"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives of the pages (page_id, url, html) below `path`."""
    r = record_types(pages, least_bytes)
    again = F.col("refers_to").isNotNull()
    sha1 = F.col("payload_digest")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), sha1)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("WARC-Refers-To", F.when(again, _record_id(F.col("refers_to"), sha1))),
        line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"), http,
    )
    record = F.concat(head.cast("binary"), body).cast("string")
    r.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, block, raw) in file order within each split: what follows each magic, and the
    file's first stretch, which is empty in a sound file."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("raw"),
    )


def parse(raw: bytes) -> tuple[int, int] | None:
    """(bytes of the header, bytes of the content) of a candidate, counted after the magic."""
    if raw[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = raw.find(b"\r\n\r\n")
    found = _LENGTH.search(raw, 0, end + 2) if end >= 0 else None
    return (end + 4, int(found[1])) if found else None


def _successor(at: int, raw: bytes) -> int | None:
    """Offset behind a candidate that begins at `at`."""
    size = parse(raw)
    return None if size is None else at + len(MAGIC) + sum(size) + 4


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _chains(batches):
    """One row per split with its bytes, and one per candidate with the place behind the last
    record of its chain that begins in the split; offsets are counted from the split's first
    stretch. The first stretch of a file has no magic before it."""
    def done(key, end, links):
        exits: dict[int, int] = {}
        for at, to in reversed(links):
            exits[at] = exits.get(to, to) if to < end else to
        n = len(exits) + 1
        return {
            "file": [key[0]] * n, "block": [key[1]] * n, "at": [None, *exits],
            "exit": [end, *exits.values()],
        }

    key, at, links = None, 0, []
    for file, block, raw in _rows(batches):
        if (file, block) != key:
            if key is not None:
                yield done(key, at, links)
            key, at, links = (file, block), 0, []
            if block == 0:  # the stretch before the first magic
                at = len(raw)
                continue
        to = _successor(at, raw)
        if to is not None:
            links.append((at, to))
        at += len(MAGIC) + len(raw)
    if key is not None:
        yield done(key, at, links)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """file, block, begin (offset of its first stretch), entry (offset within the split of the
    first record that the chain from the file's start reaches in it; null if there is none)."""
    chains = staged(
        map_batches(_stretches(spark, path), _chains, "file string, block bigint, at bigint, exit bigint"),
        "chains",
    )
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = chains.where("at is null").select("file", "block", F.col("exit").alias("bytes"))
    blocks = blocks.withColumn("begin", F.sum("bytes").over(in_file) - F.col("bytes"))
    blocks = staged(blocks, "blocks")
    jumps = (
        chains.where("at is not null")
        .join(blocks, ["file", "block"])
        .select("file", "block", (F.col("begin") + F.col("at")).alias("at"), (F.col("begin") + F.col("exit")).alias("to"))
    )
    start = blocks.groupBy("file").agg(F.min("begin").alias("at"))
    wanted = jumps.select("file", F.col("to").alias("at")).distinct().unionByName(start.select("file", F.lit(0).cast("bigint").alias("at")))
    links = staged(jumps.join(wanted, ["file", "at"], "left_semi"), "links")
    reached = start.select("file", F.lit(0).cast("bigint").alias("at"))
    jump = links.select("file", "at", "to")
    seen = 0
    while True:
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = staged(reached.unionByName(further).distinct(), "reached")
        now = reached.count()
        if now == seen:
            break
        seen = now
        twice = jump.alias("a").join(
            jump.alias("b"), F.expr("a.file = b.file and a.to = b.at")
        )
        jump = staged(twice.select("a.file", "a.at", "b.to"), "jump")
    size = blocks.groupBy("file").agg(F.sum("bytes").alias("at"))
    broken = size.join(reached, ["file", "at"], "left_anti").first()
    if broken is not None:
        raise ValueError(f"the records of {broken['file']} do not follow one another to its end")
    first = (
        links.join(reached, ["file", "at"], "left_semi")
        .groupBy("file", "block")
        .agg(F.min("at").alias("first"))
    )
    later = in_file.rowsBetween(0, Window.unboundedFollowing)
    return staged(
        blocks.join(first, ["file", "block"], "left")
        .join(size.withColumnRenamed("at", "size"), "file")
        .select(
            "file", "block", "begin", (F.col("first") - F.col("begin")).alias("entry"),
            F.coalesce(F.first("first", ignorenulls=True).over(later), "size").alias("behind"),
        ),
        "entries",
    )


def _walk(batches):
    """Yields (file, offset, end of its record, bytes, whole): the records from each split's
    entry on, and before it the rest of the record that reaches into the split. A record that
    reaches out of its split is cut short."""
    key, magic = None, MAGIC.encode()
    at = begin = start = behind = 0
    entry, parts, started = None, [], False

    def piece():
        raw = b"".join(parts)
        return key[0], start, behind, raw, started and len(raw) == behind - start

    for file, block, raw, begin_, entry_, behind_ in _rows(batches):
        if (file, block) != key:
            if parts:
                yield piece()
            key, at, begin, entry = (file, block), 0, begin_, entry_
            start, behind, parts, started = begin, behind_, [], False
            if block == 0:
                at = len(raw)
                continue
        here = begin + at
        if entry is not None and at >= entry and here >= behind:
            if parts:
                yield piece()
            start, behind, parts, started = here, _successor(here, raw), [], True
        parts += [magic, raw]
        at += len(magic) + len(raw)
    if parts:
        yield piece()


def _fields(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the payload of a whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    content = rest[:-4]
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if fields.get("content-type", "").startswith("application/http"):
        content = content.partition(b"\r\n\r\n")[2]
    return fields, content


RECORD = (
    "file string, offset bigint, length bigint, record_type string, record_id string, "
    "refers_to_id string, target_uri string, date string, payload_digest string, payload binary"
)


def _parsed(pieces):
    out = []
    names = [f.split()[0] for f in RECORD.split(", ")]
    for file, start, behind, raw, whole in pieces:
        if not whole:
            continue
        fields, payload = _fields(raw)
        given = [fields.get(f) for f in (
            "warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date",
            "warc-payload-digest",
        )]
        out.append((file, start, behind - start, *given, payload))
        if len(out) >= 200:
            yield dict(zip(names, zip(*out)))
            out = []
    if out:
        yield dict(zip(names, zip(*out)))


def _cut_short(batches):
    for file, start, behind, raw, whole in _walk(batches):
        if not whole:
            yield {"file": [file], "at": [start], "behind": [behind], "raw": [raw]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below `path`. Raises ValueError if the records of a file do
    not lead from its start to its end."""
    found = entries(spark, path)
    numbered = _stretches(spark, path).withColumn("_n", F.monotonically_increasing_id())
    guided = (
        numbered.join(found, ["file", "block"])
        .sortWithinPartitions("file", "block", "_n")
        .select("file", "block", "raw", "begin", "entry", "behind")
    )
    whole = map_batches(guided, lambda batches: _parsed(_walk(batches)), RECORD)
    if found.where("entry is null or entry <> 0").isEmpty():
        return whole  # every record ends in its split
    pieces = map_batches(guided, _cut_short, "file string, at bigint, behind bigint, raw binary")
    in_order = F.sort_array(F.collect_list(F.struct("at", "raw")))
    hexed = F.concat_ws("", F.transform(in_order, lambda p: F.hex(p["raw"])))
    joined = pieces.groupBy("file", "behind").agg(
        F.min("at").alias("at"), F.unhex(hexed).alias("raw")
    )
    rest = map_batches(
        joined.select("file", "at", "behind", "raw"),
        lambda batches: _parsed((*row, True) for row in _rows(batches)),
        RECORD,
    )
    return whole.unionByName(rest)


def op1_warc_boundary_chains(spark, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    narrow = staged(
        read(spark, path).select(
            "record_id", "record_type", "refers_to_id",
            F.octet_length("payload").cast("bigint").alias("bytes"), digest("payload").alias("sha1"),
        ),
        "records",
    )
    full = narrow.where("record_type = 'response'").groupBy(F.col("record_id").alias("id"))
    full = full.agg(F.max("bytes").alias("payload_bytes"), F.max("sha1").alias("payload_digest"))

    def page(record_id):
        digits = F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*):", 1)
        return F.when(digits != "", digits.cast("bigint"))

    return (
        narrow.withColumn("id", F.coalesce("refers_to_id", "record_id"))
        .join(full, "id")
        .select(
            page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
            page("refers_to_id").alias("refers_to"),
        )
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h
  FROM pages),
d AS (
  SELECT page_id, payload_bytes, translate(concat(
      to_base(('0x' || h[1:10])::BIGINT, 32, 8), to_base(('0x' || h[11:20])::BIGINT, 32, 8),
      to_base(('0x' || h[21:30])::BIGINT, 32, 8), to_base(('0x' || h[31:40])::BIGINT, 32, 8)),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t"""

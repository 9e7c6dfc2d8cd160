import base64
import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from hearthflow.llm import warc
from hearthflow.session import staging_path

PAGES = "page_id bigint, url string, html string, record_type string, file string, n string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def forged(payload: str) -> str:
    """A payload that holds what looks like whole records."""
    inner = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"
    return payload + inner + "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" + inner + "WARC/1."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, f"http://a/{i}", "x" * rng.randint(0, 300) + str(i)) for i in range(60)]
    out += [(100 + i, "u", "same") for i in range(20)]
    out += [(200 + i, None, forged(f"<p>{i}</p>" * rng.randint(1, 40))) for i in range(20)]
    out += [(300, "a\r\nb", None), (301, "u", ""), (302, "u", "WARC/1.1\r\n\r\n"), (303, "u", "é日\n\r\n")]
    out += [(None, "u", "same"), (None, "u", "none has an id"), (304, "u", "twice"), (304, "u", "twice")]
    out += [(305, "u", forged("y" * 30_000))]
    return out


def expected(rows):
    out, top = Counter(), {}
    for i, _, html in rows:
        data = (html or "").encode()
        top[data] = max(top.get(data, -1), -1 if i is None else i)
    for i, _, html in rows:
        data = (html or "").encode()
        sha1 = base64.b32encode(hashlib.sha1(data).digest()).decode()
        best = None if top[data] == -1 else top[data]
        kind = "response" if i == best else "revisit"
        out[(i, len(data), sha1, kind, None if i == best else best)] += 1
    return out


@pytest.mark.parametrize("split", ["128m", "3000b", "700b"])
def test_round_trip_in_splits_of_any_size(spark, rows, split, monkeypatch, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        monkeypatch.setattr(warc, "table", lambda *_: pages(spark, rows).coalesce(3))
        got = Counter(tuple(r) for r in warc.op1_warc_boundary_chains(spark, "").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(rows)


def test_files_are_sound_records_and_payloads_come_back(spark, rows):
    path = staging_path(spark, "warc-test")
    warc.write(pages(spark, rows), path)
    found = 0
    for part in Path(path).glob("part-*"):
        data, at = part.read_bytes(), 0
        while at < len(data):
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            head, size = warc.parse(data[at + len(warc.MAGIC) :])
            at += len(warc.MAGIC) + head + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            found += 1
    assert found == len(rows)
    read = warc.read(spark, path).collect()
    kept = {bytes(r["payload"]) for r in read if r["record_type"] == "response"}
    assert kept == {(h or "").encode() for _, _, h in rows}
    assert {r["target_uri"] for r in read} >= {"a%0D%0Ab", None}


def test_no_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "table", lambda *_: pages(spark, []))
    assert warc.op1_warc_boundary_chains(spark, "").collect() == []


def test_a_broken_chain_is_an_error(spark, rows):
    path = staging_path(spark, "warc-broken")
    warc.write(pages(spark, rows[:5]).coalesce(1), path)
    part = next(Path(path).glob("part-*"))
    part.write_bytes(part.read_bytes()[:-50])
    Path(path, f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="do not follow"):
        warc.read(spark, path)

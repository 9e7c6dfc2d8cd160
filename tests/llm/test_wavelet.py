import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearthflow.llm import wavelet
from hearthflow.session import staging_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def shard_of(ids):
    return wavelet.Shard.build([1], [len(ids)], np.array(ids, dtype="<u4"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 7, 50256, 3_000_000_000]), max_size=1500))
def test_shard_answers_like_the_plain_list(ids):
    shard = wavelet.Shard.from_bytes(shard_of(ids).to_bytes())
    assert shard.tokens().tolist() == ids
    for i in range(0, len(ids), 97):
        assert shard.access(i) == ids[i]
    for token in {*ids, 5}:
        at = [i for i, t in enumerate(ids) if t == token]
        assert shard.count(token) == len(at)
        half = len(ids) // 2
        assert shard.count(token, half, len(ids)) == sum(i >= half for i in at)
        for k in range(0, len(at), 61):
            assert shard.select(token, k) == at[k]


def test_out_of_range_is_an_error():
    shard = shard_of([3, 3])
    for wrong in (lambda: shard.access(2), lambda: shard.select(3, 2), lambda: shard.select(9, 0)):
        with pytest.raises(IndexError):
            wrong()
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(b"x" * 64)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")


@pytest.mark.parametrize("shard_tokens", [1 << 21, 50])
def test_round_trip(spark, documents, odd_rows, shard_tokens):
    path = staging_path(spark, "wavelet-test")
    wavelet.write(documents(odd_rows), path, PATH, shard_tokens=shard_tokens)
    t = Tokenizer.from_file(PATH)
    want, start = [], 0
    for doc_id, text in sorted(odd_rows, key=order):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [
        (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"]))
        for r in wavelet.read(spark, path).orderBy("start").collect()
    ]
    assert got == want
    ends = wavelet.count(spark, path, 0).collect()
    assert sum(r["n"] for r in ends) == len(odd_rows)
    first = wavelet.locate(spark, path, 0, 0).collect()
    assert len(first) == len(ends)
    for r in first:
        there = wavelet.access(spark, path, r["place"]).where(f"part={r['part']} and seq={r['seq']}")
        assert there.first()["token"] == 0


def test_no_documents(spark, documents):
    path = staging_path(spark, "wavelet-none")
    wavelet.write(documents([]), path, PATH)
    assert wavelet.read(spark, path).collect() == []

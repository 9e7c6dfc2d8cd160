import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthflow.llm import packing
from hearthflow.llm.common import offsets
from hearthflow.llm.tokens import Encoder, stretch_starts, tokenizer_json

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = "  a  b\n\n c'S don't 's \t x\r\n y É'll ÉCOLE 12 345 .. -- İx ß 日本 語 <|endoftext|> \x0b é"


def plain_ids(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=[WORDS, BYTES])
def both(request):
    t = Tokenizer.from_file(request.param)
    t.encode_special_tokens = True
    return t, Encoder(tokenizer_json(request.param))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab eÉß'.,1 \n\t\rİ日́|#\x0b", max_size=60))
def test_encoder_gives_the_ids_of_whole_texts(both, text):
    whole, quick = both
    want = whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(quick.encode(text), dtype="<u4").tolist() == want


STRETCH = re.compile(
    r" ?\S*'\S*| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+"
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab eÉß×÷¿ɏ'.,1 \n\t\r|#", min_size=1, max_size=20), min_size=1))
def test_array_operations_cut_texts_like_the_rule(texts):
    cuts = [piece.encode() for text in texts for piece in STRETCH.findall(text)]
    data = [text.encode() for text in texts]
    begins = offsets([len(d) for d in data])[:-1]
    got = stretch_starts(np.frombuffer(b"".join(data), dtype=np.uint8), begins)
    assert got.tolist() == offsets([len(c) for c in cuts])[:-1].tolist()


def test_a_portion_becomes_strings_only_for_its_distinct_stretches(both, monkeypatch):
    whole, quick = both
    asked, values = [], quick.words.values
    monkeypatch.setattr(quick.words, "values", lambda keys, f: asked.append(keys) or values(keys, f))
    texts = ["ab cd  été " * 3000, None, "", "日本 ab", " cd", "ab'cd \n\n ab", TRICKY, "été\n"]
    for text, ids in zip(texts, quick.encode_all(texts), strict=True):
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
    assert len(asked) == 1 and len(asked[0]) < 20


def test_encoder_after_its_memory_is_cleared(both, monkeypatch):
    whole, quick = both
    monkeypatch.setattr("hearthflow.llm.tokens.KEPT", 3)
    for text in ("aa bb cc dd ee", "aa ff gg hh", TRICKY, "aa bb cc dd ee"):
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(quick.encode(text), dtype="<u4").tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_places_every_piece_once_and_within_capacity(lengths):
    counts = Counter(lengths)
    sequences = packing.plan(dict(counts), 40)
    used = Counter()
    for many, inside in sequences:
        assert many > 0 and sum(inside) <= 40
        for n in inside:
            used[n] += many
    assert used == counts


def best_by_search(lengths, capacity):
    """Fewest sequences, by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, rooms[:j] + (rooms[j] - lengths[i],) + rooms[j + 1 :])
        go(i + 1, rooms + (capacity - lengths[i],))

    go(0, ())
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_plan_is_best_or_one_off_on_small_instances(lengths):
    got = sum(many for many, _ in packing.plan(dict(Counter(lengths)), 12))
    assert got <= best_by_search(lengths, 12) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(8, 12), min_size=1, max_size=9))
def test_reduction_alone_is_best(lengths):
    """No two of these fit with a third, so dominance closes every sequence."""
    got = sum(many for many, _ in packing.plan(dict(Counter(lengths)), 20))
    assert got == best_by_search(lengths, 20)


def check_placed(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_pieces_and_places(documents, odd_rows):
    pieces = packing.token_pieces(documents(odd_rows), WORDS, capacity=64)
    placed = packing.pack(pieces, capacity=64).collect()
    texts = Counter((i, t) for i, t in odd_rows)
    want = Counter()
    for (i, t), n in texts.items():
        ids = plain_ids(WORDS, t or "") + [0]
        for p in range(0, len(ids), 64):
            part = np.array(ids[p : p + 64], dtype="<u4").tobytes()
            want[(i, p // 64, p, len(part) // 4, zlib.crc32(part))] += n
    got = Counter(
        (r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in placed
    )
    assert got == want
    many = check_placed(placed, 64)
    total = sum(r["length"] for r in placed)
    assert many <= -(-total // 64) * 1.05 + 1


def test_sequences_hold_the_ids_in_order(documents):
    pieces = packing.token_pieces(documents([(1, "a b c"), (2, "d e"), (3, "f")]), WORDS, 8)
    placed = packing.pack(pieces, capacity=8)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        at = 4 * r["offset"]
        assert rows[r["sequence_id"]][at : at + len(r["ids"])] == r["ids"]


def test_no_rows(documents):
    assert packing.pack(packing.token_pieces(documents([]), WORDS)).collect() == []


def test_one_length_held_by_all(spark):
    pieces = spark.range(5000).select("id", F.lit(7).alias("length"))
    assert check_placed(packing.pack(pieces, capacity=64).collect(), 64) == -(-5000 // 9)


def test_wrong_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.range(3).select(F.lit(99).alias("length")), capacity=64)


def test_names_of_inner_columns_and_the_same_places_again(spark):
    inner = ["kept", "len", "row", "portion", "before", "no", "n", "slots", "slot", "_n", "_len"]
    pieces = spark.range(300).select("id", (F.col("id") % 40 + 1).alias("length"))
    pieces = pieces.select("*", *(F.col("id").alias(c) for c in inner))
    placed = packing.pack(pieces, capacity=64)
    rows = placed.collect()
    assert placed.columns == [*pieces.columns, "sequence_id", "offset"]
    assert all(r[c] == r["id"] for r in rows for c in inner)
    check_placed(rows, 64)
    for other in ("3", "11"):  # dealt over other tasks
        spark.conf.set("spark.sql.shuffle.partitions", other)
        assert sorted(placed.collect()) == sorted(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")

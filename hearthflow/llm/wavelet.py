"""Token ids in wavelet-matrix shards: one compressed file format for access, count and lookup.

Documents are range-partitioned by doc_id, encoded, and cut into shards of whole documents. A
shard is one record of the file format: a header, the documents' ids and token counts, the
shard's token alphabet, and one bit-plane per bit of the place in that alphabet, each with a
rank directory (ones before every 512 bits). The matrix is the usual one: at every level the
tokens whose bit is 0 go stably before those whose bit is 1. So

* access reads one bit per plane, rank and count follow one token down the planes, and select
  climbs back up; none of them unpacks the shard,
* all tokens come back by undoing the planes from the last to the first.

Shards are written as records of Parquet files by Spark, so commits and retries are Spark's, and
any file system works. A shard's number is its partition's number and its place in it; where a
shard begins among all tokens is a running sum over one row per shard.

Null texts are empty texts (just the end id). Rows with a null doc_id come first. Rows with one
doc_id are ordered by text; equal rows are kept each. An empty table writes no shards.
"""

from __future__ import annotations

import struct

import numpy as np
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged, staging_path
from .common import map_batches, offsets, table
from .tokens import encoder, tokenizer_json

SHARD_TOKENS = 1 << 21
BLOCK = 512
MAGIC = b"HFWM1\0\0\0"


class Plane:
    """Bits with constant-time rank and a binary-searched select."""

    def __init__(self, packed: np.ndarray, n: int, directory: np.ndarray | None = None):
        self.packed, self.n = packed, n
        if directory is None:
            padded = np.zeros(-(-n // BLOCK) * (BLOCK // 8), dtype=np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
            directory = offsets(ones).astype("<u4")
        self.directory = directory
        self.zeros = n - int(directory[-1])

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        at = block * (BLOCK // 8)
        whole = int(np.bitwise_count(self.packed[at : i >> 3]).sum())
        part = int(self.packed[i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self.directory[block]) + whole + part.bit_count()

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th bit (from 0) of that value."""
        before = self.directory.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before[1:], k, side="right"))
        at = block * (BLOCK // 8)
        bits = np.unpackbits(self.packed[at : at + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)


class Shard:
    """A wavelet matrix over the tokens of some whole documents."""

    def __init__(self, doc_ids, lengths, alphabet, planes, n):
        self.doc_ids, self.lengths, self.alphabet = doc_ids, lengths, alphabet
        self.planes, self.n = planes, n

    @classmethod
    def build(cls, doc_ids: list, lengths: list[int], ids: np.ndarray) -> "Shard":
        if len(ids) and int(ids.max()) < 1 << 20:
            seen = np.zeros(int(ids.max()) + 1, dtype=bool)
            seen[ids] = True
            alphabet = np.flatnonzero(seen).astype("<u4")
            codes = (np.cumsum(seen) - 1).astype(np.uint32)[ids]
        else:
            alphabet, codes = np.unique(ids, return_inverse=True)
        level = codes.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes = []
        for shift in reversed(range(max(1, (len(alphabet) - 1).bit_length()))):
            bit = (level >> level.dtype.type(shift)).astype(np.uint8) & 1
            planes.append(Plane(np.packbits(bit), len(level)))
            one = bit.view(bool)
            level = np.concatenate([level[np.flatnonzero(~one)], level[np.flatnonzero(one)]])
        return cls(doc_ids, np.asarray(lengths, dtype="<i8"), alphabet, planes, len(ids))

    def to_bytes(self) -> bytes:
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        parts = [known.tobytes(), ids.tobytes(), self.lengths.astype("<i8").tobytes()]
        parts.append(self.alphabet.astype("<u4").tobytes())
        for plane in self.planes:
            parts += [plane.packed.tobytes(), plane.directory.astype("<u4").tobytes()]
        head = struct.pack("<8sQQII", MAGIC, self.n, len(ids), len(self.alphabet), len(self.planes))
        return head + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> "Shard":
        magic, n, docs, letters, levels = struct.unpack_from("<8sQQII", data)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        body = zstandard.ZstdDecompressor().decompress(data[struct.calcsize("<8sQQII") :])
        at = 0

        def next_array(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        known = next_array("u1", docs)
        doc_ids = [int(d) if k else None for d, k in zip(next_array("<i8", docs), known)]
        lengths, alphabet = next_array("<i8", docs), next_array("<u4", letters)
        planes = []
        for _ in range(levels):
            packed = next_array("u1", -(-n // 8))
            planes.append(Plane(packed, n, next_array("<u4", -(-n // BLOCK) + 1)))
        return cls(doc_ids, lengths, alphabet, planes, n)

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.rank(i)
            code = code << 1 | bit
            i = plane.zeros + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int, int]:
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0, -1
        for depth, plane in enumerate(self.planes):
            lo, hi = plane.rank(begin), plane.rank(end)
            if code >> (len(self.planes) - 1 - depth) & 1:
                begin, end = plane.zeros + lo, plane.zeros + hi
            else:
                begin, end = begin - lo, end - hi
        return begin, end, code

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in places begin to end (all, if not given)."""
        lo, hi, _ = self._range(token, begin, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a token."""
        lo, hi, code = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for depth, plane in reversed(list(enumerate(self.planes))):
            bit = code >> (len(self.planes) - 1 - depth) & 1
            i = plane.select(bit, i - plane.zeros if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        level = np.zeros(self.n, dtype=kind)
        for depth, plane in reversed(list(enumerate(self.planes))):
            one = plane.bits()
            above = np.empty_like(level)
            above[np.flatnonzero(~one)] = level[: plane.zeros]
            above[np.flatnonzero(one)] = level[plane.zeros :] | kind(1 << (len(self.planes) - 1 - depth))
            level = above
        return self.alphabet[level] if self.n else self.alphabet[:0]


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode all texts, each with the end id, and write shards in ascending doc_id order."""
    definition = tokenizer_json(tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()

    def build(batches):
        encode_all = encoder(definition).encode_all
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def shard():
            made = Shard.build(doc_ids, lengths, np.frombuffer(b"".join(ids), dtype="<u4"))
            return {
                "part": [part], "seq": [seq], "docs": [len(doc_ids)],
                "tokens": [made.n], "shard": [made.to_bytes()],
            }

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc_id, ids_of_text in zip(batch.column(0).to_pylist(), encode_all(texts)):
                data = ids_of_text + end
                doc_ids.append(doc_id)
                lengths.append(len(data) // 4)
                ids.append(data)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield shard()
                    seq += 1
                    doc_ids, lengths, ids, held = [], [], [], 0
        if doc_ids:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")
    schema = "part int, seq int, docs bigint, tokens bigint, shard binary"
    map_batches(ordered, build, schema).write.parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "part int, seq int, docs bigint, tokens bigint, shard binary"
    ).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: doc_id, start (tokens of all documents before it),
    n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def unpack(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shard = Shard.from_bytes(data)
                tokens, at = shard.tokens(), offsets(shard.lengths)
                for lo in range(0, len(shard.doc_ids), 2000):
                    hi = min(lo + 2000, len(shard.doc_ids))
                    n = hi - lo
                    yield {
                        "part": [part] * n, "seq": [seq] * n, "doc_id": shard.doc_ids[lo:hi],
                        "within": at[lo:hi], "n_tokens": shard.lengths[lo:hi],
                        "ids": [tokens[a:b].tobytes() for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])],
                    }

    shards = _shards(spark, path)
    in_order = Window.orderBy("part", "seq")  # one row per shard
    begins = shards.select(
        "part", "seq", (F.sum("tokens").over(in_order) - F.col("tokens")).alias("begin")
    )
    # written out, so that its size is known when the join is planned
    begins = staged(begins, "shard-begins")
    found = map_batches(
        shards.select("part", "seq", "shard"), unpack,
        "part int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids binary",
    )
    return found.join(begins, ["part", "seq"]).select(
        "doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids"
    )


def _ask(spark: SparkSession, path: str, answer, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = answer(Shard.from_bytes(data))
                n = len(next(iter(found.values()), []))
                yield {"part": [part] * n, "seq": [seq] * n, **found}

    chosen = _shards(spark, path).select("part", "seq", "shard")
    return map_batches(chosen, run, f"part int, seq int, {schema}")


def count(spark: SparkSession, path: str, token: int) -> DataFrame:
    """How often a token occurs in each shard."""
    return _ask(spark, path, lambda s: {"n": [s.count(token)]}, "n bigint")


def locate(spark: SparkSession, path: str, token: int, k: int) -> DataFrame:
    """Place within each shard of its k-th occurrence (from 0) of a token, if it has that many."""

    def answer(s):
        return {"place": [s.select(token, k)] if k < s.count(token) else []}

    return _ask(spark, path, answer, "place bigint")


def access(spark: SparkSession, path: str, place: int) -> DataFrame:
    """The token at a place of each shard that is long enough."""
    return _ask(
        spark, path, lambda s: {"token": [s.access(place)] if place < s.n else []}, "token bigint"
    )


def op7_wavelet_matrix(spark, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "wavelet")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )

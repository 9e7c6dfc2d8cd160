"""Best-fit packing of token pieces into sequences, after Martello-Toth reduction.

A piece is a document's tokens or, of longer documents, a cut of at most `capacity` tokens. Only
how many pieces there are of each length matters for a good packing, and lengths are whole
numbers up to `capacity`; so one grouped count (at most `capacity` rows, whatever the size of
the corpus) goes to the driver, which plans the sequences on those counts:

* Reduction. The longest open length is closed by the smallest set that provably dominates every
  other choice: alone if not even the shortest piece fits beside it, with a partner that fills
  the rest exactly, with the largest partner that fits if no two pieces fit together, or with
  two pieces that fill it when nothing better of at most three exists. Such sets are fixed for
  as many sequences as the counts allow, and the instance shrinks.
* Best fit of what remains, longest first, each piece into the fullest sequence that takes it.

The plan is a list of places per length; its rows are bounded by a function of `capacity` alone,
so it may be broadcast. Every piece is numbered among those of its length (numbered within
hashed portions whose counts are then added up, so that a length held by a third of all rows is
no single task) and takes the place with its number.

Null texts are empty texts and hold just the end id; a row is packed once for each time that it
occurs; null doc_ids are kept. Extra columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import map_batches, spread, table
from .tokens import encoder, tokenizer_json

CAPACITY = 2048
#: Fewest portions in which pieces are numbered, and pieces of a portion beyond that.
PORTIONS = 256
PORTION_ROWS = 1_000_000


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of every document's ids plus the end id; ids
    are little-endian unsigned 32-bit integers."""
    definition = tokenizer_json(tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches):
        encode_all = encoder(definition).encode_all
        for batch in batches:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            texts = batch.column(1).to_pylist()
            for doc_id, ids_of_text in zip(batch.column(0).to_pylist(), encode_all(texts)):
                ids = ids_of_text + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(n)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids"].append(part)
            yield out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Sequences as (how many, lengths in each); counts maps a length to its pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    fixed: list[tuple[int, tuple]] = []

    def take(lengths: tuple, most: int | None = None) -> None:
        need = Counter(lengths)
        times = min(left[n] // k for n, k in need.items())
        times = min(times, most) if most else times
        fixed.append((times, lengths))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                order.pop(bisect.bisect_left(order, n))

    def largest(limit: int, without: Counter) -> int | None:
        """Largest open length up to the limit of which a piece is left beside those named."""
        at = bisect.bisect_right(order, limit) - 1
        while at >= 0 and left[order[at]] <= without[order[at]]:
            at -= 1
        return order[at] if at >= 0 else None

    def fits(pieces: int, room: int, above: int = 0) -> bool:
        """Whether so many of the shortest open pieces longer than `above` fit beside top."""
        small: list[int] = []
        for n in order[bisect.bisect_right(order, above) :]:
            small += [n] * min(pieces - len(small), left[n] - (n == top))
            if len(small) == pieces:
                return sum(small) <= room
        return False

    open_ones: dict[int, int] = {}
    while order:
        top = order[-1]
        room = capacity - top
        partner = largest(room, Counter([top]))
        if partner is None:
            take((top,))
        elif partner == room or not fits(2, room):
            take((top, partner))
        else:
            pair = None if fits(3, room) else _exact_pair(order, left, top, room)
            if pair and pair[0] == partner and not fits(2, room, above=pair[1]):
                take((top, *pair))
            else:
                open_ones[top] = left.pop(top)
                order.pop()
    return fixed + _best_fit(open_ones, capacity)


def _exact_pair(order, left, top, room) -> tuple[int, int] | None:
    """Two open pieces that fill the room, the larger one as large as can be."""
    lo, hi = 0, bisect.bisect_right(order, room) - 1
    while 0 <= lo <= hi:
        a, b = order[hi], order[lo]
        if a + b > room:
            hi -= 1
        elif a + b < room:
            lo += 1
        elif all(left[n] >= k for n, k in Counter([top, a, b]).items()):
            return a, b
        else:
            hi -= 1
    return None


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Best fit, longest first, of what the reduction left open; sequences that the reduction
    fixed stay closed."""
    free: dict[int, list[list]] = {}  # room left -> [how many, lengths]
    rooms: list[int] = []

    def put(room: int, many: int, lengths: tuple) -> None:
        if room not in free:
            free[room] = []
            bisect.insort(rooms, room)
        free[room].append([many, lengths])

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                if todo >= each:
                    put(capacity - each * n, todo // each, (n,) * each)
                if todo % each:
                    put(capacity - todo % each * n, 1, (n,) * (todo % each))
                break
            room = rooms[at]
            group = free[room][-1]
            each = room // n
            sequences = min(group[0], max(1, todo // each))
            each = min(each, todo)
            group[0] -= sequences
            lengths = group[1] + (n,) * each
            if not group[0]:
                free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            put(room - each * n, sequences, lengths)
            todo -= sequences * each
    return [(many, lengths) for groups in free.values() for many, lengths in groups]


def places(sequences: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number, how many, first sequence, offset, step): the pieces of that
    length with numbers from `first` on go to one sequence after the other."""
    rows, first, sequence = [], Counter(), 0
    for many, lengths in sequences:
        at = 0
        for n in lengths:
            rows.append((n, first[n], many, sequence, at))
            first[n] += many
            at += n
        sequence += many
    return rows


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The pieces with `sequence_id` and `offset` (columns of these names are replaced). Pieces
    longer than the capacity or without a positive length are refused."""
    spark = pieces.sparkSession
    # a number of the row that is stored with it, so that a task that is run again orders alike;
    # the pieces' own columns are in a struct, beside which no name can clash
    kept = staged(
        pieces.select(
            F.struct(*pieces.columns).alias("kept"),
            F.col(length).alias("len"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "pieces",
    )
    counts = {r[0]: r[1] for r in kept.groupBy("len").count().limit(capacity + 2).collect()}
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    portions = max(PORTIONS, -(-sum(counts.values()) // PORTION_ROWS))
    kept = kept.withColumn("len", F.col("len").cast("bigint")).withColumn(
        "portion", spread("row", parts=portions)
    )
    rows = places(plan(counts, capacity))
    slots = spark.createDataFrame(
        rows or [(0, 0, 0, 0, 0)], "len bigint, first bigint, many bigint, seq bigint, off bigint"
    )
    of_length = Window.partitionBy("len").orderBy("portion")
    before = (
        kept.groupBy("len", "portion")
        .count()
        .select("len", "portion", (F.sum("count").over(of_length) - F.col("count")).alias("before"))
    )
    within = Window.partitionBy("len", "portion").orderBy("row")
    numbered = (
        kept.withColumn("no", F.row_number().over(within) - 1)
        .join(before, ["len", "portion"])
        .select("kept", "len", (F.col("no") + F.col("before")).alias("n"))
    )
    # places that take up the same length are consecutive, so the one for a number is the last
    # that begins at or before it, in one short sorted list per length
    lists = slots.groupBy("len").agg(
        F.sort_array(F.collect_list(F.struct("first", "many", "seq", "off"))).alias("slots")
    )
    found = F.expr("element_at(slots, cast(size(filter(slots, s -> s.first <= n)) as int))")
    return (
        numbered.join(F.broadcast(lists), "len")
        .withColumn("slot", found)
        .select(
            *(F.col("kept")[c].alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")),
            (F.col("slot.seq") + F.col("n") - F.col("slot.first")).alias("sequence_id"),
            F.col("slot.off").alias("offset"),
        )
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences (sequence_id, ids) of placed pieces that carry their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"])))
    return placed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    pieces = token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    narrow = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(narrow)

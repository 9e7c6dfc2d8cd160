"""Words of texts by Arrow kernels: runs of letters (and digits), A-Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import offsets

#: What stands between words, once A-Z are in lower case.
NO_LETTER = r"[\x00-\x60\x7B-\x7F]+"
NO_LETTER_OR_DIGIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that a task works on at once; a longer text is worked whole.
SLICE = 4_000_000


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about SLICE bytes of that column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(part)]):
            yield batch.slice(lo, hi - lo)


def words(texts: pa.Array, between: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, the distinct words by code, where each text's words begin and end)."""
    small = pc.ascii_lower(pc.fill_null(texts, ""))
    split = pc.split_pattern_regex(small, between)
    flat = pc.list_flatten(split)
    some = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = offsets(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    at = offsets(some)[at]  # texts may begin or end between words, which leaves empty pieces
    coded = pc.dictionary_encode(flat.filter(pa.array(some)))
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, at

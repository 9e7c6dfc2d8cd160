"""Token ids of whole texts, by the tokenizers library.

Both supported kinds of tokenizer never let a token reach across white space (the byte-level
one takes a single space into the word after it) nor from letters to other characters, so the
ids of a text are the ids of its stretches one after the other. Texts are worked in portions: the
bytes of a portion are cut by array operations, equal stretches are found by Arrow, and only the
distinct stretches become Python strings. Those that the worker does not know yet are encoded
once; the ids of all others are copied, which is several times faster than encoding whole texts.
Words of letters, which are one stretch in any text, go to the library's model at once (those
with other than ASCII letters only if the tokenizer has no normalizer); other stretches go through
its whole chain of steps, and stretches with an apostrophe are left whole. Texts with characters for which the splitting rules of the libraries might differ are
encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import offsets

#: Texts made of these characters only may be cut into stretches.
_PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])
_NOT_PLAIN = re.compile(
    r"[^\t\n\r -~\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u012f\u0131-\u024f]"
)
#: Kinds of bytes in such texts; of two-byte characters, the first byte tells it but for \u00d7 and \u00f7.
_SPACE, _LETTER, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = _LETTER
#: Stretches of a generation that a worker keeps; older ones go unless they are used again.
KEPT = 500_000
#: Characters of texts that are worked side by side; a longer text is a portion of its own.
PORTION = 1 << 22
#: How byte-level tokenizers write bytes: printable ones as that character, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_ENCODERS: dict[int, "Encoder"] = {}


def tokenizer_json(path: str) -> str:
    """The tokenizer file, read once by the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(definition: str) -> "Encoder":
    """The encoder of this worker process."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


class Kept:
    """Two generations of values: what is used again moves to the younger one."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def values(self, keys: list[str], learn: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The value of each key; `learn` gives those of keys that have none."""
        if len(self.now) > KEPT:
            self.now, self.older = {}, self.now
        now, older = self.now, self.older
        found = [*map(now.get, keys)]
        missing = [i for i, value in enumerate(found) if value is None]
        again = {k: older[k] for i in missing if (k := keys[i]) in older}
        now.update(again)
        now.update(learn([k for i in missing if (k := keys[i]) not in again]))
        for i in missing:
            found[i] = now[keys[i]]
        return found


class Encoder:
    """Ids of texts; `words` keeps those of stretches."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        steps = json.loads(definition)
        self.by_word = _drops_white_space(steps)
        self.by_byte = not self.by_word and steps.get("normalizer") is None
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab()
            self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            for token, number in vocabulary.items():
                self.edge[number] = token.endswith("</w>")
        self.words = Kept()

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        portion, held = [], 0
        for text in texts:
            portion.append(text)
            held += len(text or "")
            if held >= PORTION:
                yield from self._portion(portion)
                portion, held = [], 0
        yield from self._portion(portion)

    def _portion(self, texts: list[str | None]) -> Iterator[bytes]:
        plain = [_plain(text) if text else b"" for text in texts]
        found = self._by_stretches([data for data in plain if data])
        for text, data in zip(texts, plain):
            if data is None:
                yield self.whole(text)
            else:
                yield next(found) if data else b""

    def _by_stretches(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, none of them empty, from those of its stretches."""
        if not texts:
            return
        data, begins = b"".join(texts), offsets([len(text) for text in texts])
        starts = stretch_starts(np.frombuffer(data, dtype=np.uint8), begins[:-1])
        edges = pa.py_buffer(np.append(starts, len(data)))
        stretches = pa.Array.from_buffers(
            pa.large_string(), len(starts), [None, edges, pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = stretches.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.by_word:
            distinct = [w.strip() for w in distinct]
        known = self.words.values(distinct, self._learn)
        ids = np.frombuffer(b"".join(known), dtype="<u4")
        at = offsets([len(k) // 4 for k in known])
        codes = stretches.indices.to_numpy()
        many = np.diff(at)[codes]
        before = offsets(many)  # ids before each stretch
        found = ids[np.repeat(at[codes] - before[:-1], many) + np.arange(before[-1])]
        cuts = before[np.searchsorted(starts, begins)].tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            yield found[lo:hi].tobytes()

    def _of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, maybe after a space, by the model alone."""
        tokenize = self.tokenizer.model.tokenize
        ids, ends = array("I"), [0]
        for word in words:
            if self.by_word:
                word = word.lower()
            elif word.isascii():
                word = word.replace(" ", "\u0120")
            else:
                word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids.extend([token.id for token in tokenize(word)])
            ends.append(len(ids))
        data = np.array(ids, dtype="<u4").tobytes()
        return [data[4 * at : 4 * end] for at, end in zip(ends, ends[1:])]

    def _learn(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of new stretches: words by the model, those it does not get as they are side by
        side, the rest one by one."""
        letters, side_by_side, single = [], [], []
        for w in stretches:
            if not (w[1:] if w[:1] == " " else w).isalpha():
                single.append(w)
            elif self.by_byte or w.isascii():
                letters.append(w)
            else:
                (side_by_side if self.by_word else single).append(w)
        known = dict(zip(letters, self._of_letters(letters)))
        if side_by_side:
            ids = np.frombuffer(self.whole(" ".join(side_by_side)), dtype="<u4")
            cuts = [0, *(np.flatnonzero(self.edge[ids]) + 1).tolist()]  # after last tokens
            if len(cuts) != len(side_by_side) + 1:
                raise RuntimeError("the tokenizer cuts words in an unexpected way")
            for w, at, end in zip(side_by_side, cuts, cuts[1:]):
                known[w] = ids[at:end].tobytes()
        for w in single:
            known[w] = self.whole(w)
        return known


def stretch_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where stretches begin in the bytes of plain texts, none of them empty, that lie one after
    the other; begins: where the texts do.

    A stretch is a run of letters, of other characters or of white space. Of white space before
    one of the others, the last character is a stretch of its own, or goes to what follows if it
    is a space. What has an apostrophe is not cut between white space."""
    kind = _KIND[data]
    second = np.flatnonzero((data & 0xC0) == 0x80)
    if len(second):
        sign = (data[second - 1] == 0xC3) & ((data[second] == 0x97) | (data[second] == 0xB7))
        kind[second - 1] = kind[second] = np.where(sign, _OTHER, kind[second - 1])
    space = kind == _SPACE
    head, tail = ~space, ~space  # first and last bytes between white space
    head[1:] &= space[:-1]
    tail[:-1] &= space[1:]
    head[begins], tail[begins[1:] - 1] = ~space[begins], ~space[begins[1:] - 1]
    start = np.ones(len(data), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[begins] = True
    goes_on = head.copy()
    goes_on[begins] = False
    last = np.flatnonzero(goes_on) - 1  # white space before one of the others
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    starts = np.flatnonzero(start)
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        heads, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        kept = np.unique(np.searchsorted(heads, quotes, side="right") - 1)
        inside = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(inside, np.searchsorted(starts, heads[kept], side="right"), 1)
        np.add.at(inside, np.searchsorted(starts, ends[kept]), -1)
        starts = starts[np.cumsum(inside[:-1]) == 0]
    return starts


def _plain(text: str) -> bytes | None:
    """The bytes of a text that may be cut into stretches."""
    odd = (data := text.encode()).translate(None, _PLAIN_ASCII)
    return None if odd and _NOT_PLAIN.search(odd.decode()) else data


def _drops_white_space(definition: dict) -> bool:
    """Whether white space never becomes a token; else the byte-level rule must hold."""
    steps = definition["pre_tokenizer"]
    steps = steps.get("pretokenizers", [steps])
    if steps[0]["type"] == "Split" and steps[0].get("invert"):
        return True
    if steps[0]["type"] == "ByteLevel" and not steps[0].get("add_prefix_space"):
        return False
    raise ValueError("this kind of tokenizer is not supported")

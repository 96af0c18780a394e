"""Whole-text word and shingle arrays, computed with numpy over Arrow buffers.

A word is a run of ``[0-9a-z]`` (after lower-casing A-Z) or of non-ASCII characters;
in UTF-8 the latter are the bytes from 0x80, so the scan works on bytes.  Words are
told apart by 64-bit hashes (sums of a random number for each byte at each place in the
word), so a text gives the same hashes in every task.  Where whole texts must be told
apart, ``digests`` gives 128 bits of a cryptographic hash of their words instead.  Null
texts count as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is one block.
BLOCK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


#: The words of documents.text, in DuckDB's SQL.
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _MULT[0]
    h ^= h >> np.uint64(27)
    h *= _MULT[1]
    h ^= h >> np.uint64(31)
    return h


_PLACES = 32
_TERMS = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _MULT[5])


def _terms(low: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A random number for each byte and its place in its word: from a table, later places by mixing."""
    place = np.zeros(len(low), np.int32)
    place[start] = start
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(low), dtype=np.int32), place, out=place)
    out = _TERMS[np.minimum(place, _PLACES - 1) << 8 | low]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        out[far] = mix(mix(place[far].astype(np.uint64) * _MULT[6]) + low[far])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string or binary column, nulls as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def blocks(column: pa.Array, limit: int | None = None):
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows, about ``limit`` bytes each."""
    limit = limit or BLOCK_BYTES
    data, off = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a block: byte places, hashes, and the offsets of each text's words."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        low = _LOWER[data]
        is_word = _WORD[low]
        n = len(low)
        first, last = off[:-1], off[1:]
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        before[first[first < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        after[last[last > 0] - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_terms(low, self.start), out=run[1:])
        self.hash = mix(run[self.end] - run[self.start])
        self.off = np.searchsorted(self.start, off)
        self.low = low

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def digests(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, 2) int64: BLAKE2b of each text's words, one space apart; of its bytes where it has none."""
        is_word = _WORD[self.low]
        keep = is_word.copy()
        keep[1:] |= is_word[:-1]  # a word's bytes and the byte after it
        starts = off[:-1][off[:-1] < len(data)]
        keep[starts] = is_word[starts]
        at = np.concatenate([[0], np.cumsum(keep)])[off].tolist()
        flat = np.where(is_word, self.low, np.uint8(32))[keep].tobytes()
        out = []
        for i, n in enumerate(self.counts().tolist()):
            if n:
                out.append(hashlib.blake2b(flat[at[i] : at[i + 1]].rstrip(b" "), digest_size=16).digest())
            else:
                out.append(hashlib.blake2b(data[off[i] : off[i + 1]].tobytes(), digest_size=16, person=b"no words").digest())
        return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def shingles(words: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each text's offsets; a text of 1 to k - 1 words is one shingle."""
    n = np.diff(off)
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros_like(off)
    extra = np.where((n > 0) & (n < k), k - n, 0)
    if extra.any():
        wide = np.zeros(len(words) + int(extra.sum()), np.uint64)
        wide[np.arange(len(words)) + np.repeat(np.cumsum(extra) - extra, n)] = words
        words, n = wide, n + extra
        off = np.concatenate([[0], np.cumsum(n)])
    many = np.maximum(n - k + 1, 0)
    out_off = np.concatenate([[0], np.cumsum(many)])
    total = len(words) - k + 1
    if total <= 0:
        return np.zeros(0, np.uint64), out_off
    s = words[:total] * _MULT[2]
    for j in range(1, k):
        s += words[j : j + total] * _MULT[2 + j]
    keep = np.ones(total, bool)
    for j in range(k - 1):  # starts from which the text ends too soon
        at = off[1:][n > 0] - 1 - j
        keep[at[(at >= 0) & (at < total)]] = False
    return mix(s[keep]), out_off


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each text's slice of values; 0 for empty slices."""
    run = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return run[off[1:]] - run[off[:-1]]


class Lookup:
    """Place of each 64-bit key in an array of distinct keys, or -1: open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray, room: int = 0) -> None:
        self.keys = np.asarray(keys, np.uint64)
        bits = max(4, int(max(len(self.keys), room) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self._put(0)

    def add(self, keys: np.ndarray) -> None:
        """More keys, none of them there yet; room says for how many there is space in all."""
        n = len(self.keys)
        self.keys = np.concatenate([self.keys, np.asarray(keys, np.uint64)])
        self._put(n)

    def _put(self, n: int) -> None:
        left = np.arange(n, len(self.keys))
        place = self._place(self.keys[n:])
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            lost = self.slots[place] != left
            left, place = left[lost], (place[lost] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT[4]) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        keys = np.asarray(keys, np.uint64)
        place = self._place(keys)
        got = self.slots[place]
        open_ = np.flatnonzero(got >= 0)
        place, got = place[open_], got[open_]
        while len(open_):
            hit = self.keys[got] == keys[open_]
            out[open_[hit]] = got[hit]
            open_, place = open_[~hit], (place[~hit] + 1) & self.mask
            got = self.slots[place]
            going = got >= 0
            open_, place, got = open_[going], place[going], got[going]
        return out

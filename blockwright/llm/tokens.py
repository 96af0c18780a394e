"""Token ids and byte spans from public tokenizers. Their files are parameters; nothing is trained or copied here."""

from __future__ import annotations

import base64
import os
import unicodedata
import zlib
from functools import lru_cache

import numpy as np

from blockwright.llm import text as tx


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Characters for which normalising, lower-casing and splitting are a table here: printable ASCII, tab, line ends,
# Latin-1 from U+00A1 and Latin Extended-A, and general punctuation. All are stable under NFC one by one.
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSAFE = range(5)
_LIMIT = 0x2028
_KIND = np.full(_LIMIT + 1, _UNSAFE, np.uint8)
_LOWER = np.arange(_LIMIT + 1, dtype=np.uint32)
for _c in [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x149), *range(0x14A, 0x180), *range(0x2010, 0x2028)]:
    _name = unicodedata.category(chr(_c))
    _KIND[_c] = _SPACE if _c in (9, 10, 13, 32) else _LETTER if _name[0] == "L" else _NUMBER if _name[0] == "N" else _OTHER
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
    else:
        _KIND[_c] = _UNSAFE
_QUOTE, _PIPE, _LESS = 0x27, 0x7C, 0x3C

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, tx.BLOCK_BYTES + 1)
        full = [np.full(size, p, np.uint64) for p in (_P, _PINV)]
        for t in full:
            t[0] = 1
            np.cumprod(t, out=t)
        _tables[:] = full
    return _tables


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] of them) for each i."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class WordBpe:
    """Ids of whole texts by a word-level BPE tokenizer file, with a cache of the pieces it has seen.

    The file's tokenizer lower-cases, drops white space, and merges within pieces (letters, single numbers, other
    characters, English contractions).  Pieces are found with numpy and looked up by hash, and the characters of what
    is found are compared; only unseen pieces go to the tokenizer.  A text with a character outside the tables above,
    with ``<|``, or with a piece whose hash another piece has, goes to it whole.
    """

    ROOM = 1 << 20

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known = tx.Lookup(np.zeros(0, np.uint64), self.ROOM)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.char_start, self.char_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.uint16)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.known.keys) + len(hashes) > self.ROOM or len(self.flat) > 8 * self.ROOM or len(self.chars) > 16 * self.ROOM:
            self._clear()
        sizes, ids = [], []
        for lo in range(0, len(pieces), 4096):
            groups = [pieces[i : i + 128] for i in range(lo, min(lo + 4096, len(pieces)), 128)]
            for group, got in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                owner = np.array(got.word_ids, np.int64)
                if len(owner) and owner[-1] + 1 == len(group):
                    sizes.append(np.bincount(owner, minlength=len(group)))
                    ids.append(np.array(got.ids, np.uint32))
                else:
                    each = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in group]
                    sizes.append(np.array([len(e) for e in each]))
                    ids.append(np.array([i for e in each for i in e], np.uint32))
        size = np.concatenate(sizes)
        self.known.add(hashes)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *ids])
        size = np.array([len(p) for p in pieces], np.int64)
        self.char_start = np.concatenate([self.char_start, len(self.chars) + np.cumsum(size) - size])
        self.char_size = np.concatenate([self.char_size, size])
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)])

    def _others(self, place: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Pieces whose characters aren't those of the entry that their hash found."""
        size = ends - starts
        differ = self.char_size[place] != size
        if differ.any():
            size = np.where(differ, 0, size)
        own = low[_ranges(starts, size)] != self.chars[_ranges(self.char_start[place], size)]
        if own.any():
            differ[np.repeat(np.arange(len(size)), size)[own]] = True
        return np.flatnonzero(differ)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, offsets of each text's)."""
        n = len(off) - 1
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        char_off = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        if char_off[-1] != len(chars):  # invalid UTF-8: each text by the tokenizer
            return self._whole(data, off, range(n))
        at = np.minimum(chars, _LIMIT)
        kind, low = _KIND[at], _LOWER[at]
        bad = np.flatnonzero(kind == _UNSAFE)
        odd = np.flatnonzero((chars[:-1] == _LESS) & (chars[1:] == _PIPE))
        unsafe = np.zeros(n, bool)
        unsafe[np.searchsorted(char_off, np.concatenate([bad, odd]), "right") - 1] = True
        edge = np.ones(len(chars) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        edge[char_off] = True
        self._contractions(low, kind, edge, char_off)
        starts = np.flatnonzero(edge)
        ends = starts[1:]
        starts = starts[:-1]
        piece = kind[starts] != _SPACE
        starts, ends = starts[piece], ends[piece]
        power, inverse = _powers(len(chars) + 1)
        run = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(chars)], out=run[1:])
        hashes = tx.mix((run[ends] - run[starts]) * inverse[starts])
        piece_off = np.searchsorted(starts, char_off)
        if unsafe.any():
            keep = ~np.repeat(unsafe, np.diff(piece_off))
            starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
            piece_off = np.searchsorted(starts, char_off)
        place = self.known(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, first = np.unique(hashes[new], return_index=True)
            first = new[first]
            text = low.tobytes().decode("utf-32-le", "replace")
            room = len(self.known.keys)
            self._learn(hashes[first], [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            if len(self.known.keys) < room + len(first):  # the cache was cleared: this block's pieces are looked up anew
                return self.encode(data, off)
            place = self.known(hashes)
        clash = self._others(place, starts, ends, low)
        if len(clash):
            mixed = np.zeros(n, bool)
            mixed[np.searchsorted(piece_off, clash, "right") - 1] = True
            place = place[~np.repeat(mixed, np.diff(piece_off))]
            piece_off = np.concatenate([[0], np.cumsum(np.where(mixed, 0, np.diff(piece_off)))])
            unsafe |= mixed
        size = self.size[place]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(before[-1]) + np.repeat(self.start[place] - before[:-1], size)]
        id_off = before[piece_off]
        if not unsafe.any():
            return ids, id_off
        whole, whole_off = self._whole(data, off, np.flatnonzero(unsafe))
        parts, k = [], 0
        for i in range(n):
            if unsafe[i]:
                parts.append(whole[whole_off[k] : whole_off[k + 1]])
                k += 1
            else:
                parts.append(ids[id_off[i] : id_off[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _whole(self, data: np.ndarray, off: np.ndarray, which) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(self.tokenizer.encode(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for i in which]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, edge: np.ndarray, char_off: np.ndarray) -> None:
        """'s 't 're 've 'm 'll 'd at a lone quote are pieces of their own."""
        quote = np.flatnonzero((low == _QUOTE) & edge[:-1])
        quote = quote[quote + 1 < len(low)]
        quote = quote[(kind[quote + 1] == _LETTER) & ~np.isin(quote + 1, char_off)]
        for q in quote.tolist():
            one = chr(low[q + 1])
            two = one + chr(low[q + 2]) if q + 2 < len(low) and not edge[q + 2] else ""
            size = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if size:
                edge[q + 1] = False
                edge[q + 1 + size] = True


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class ByteBpe:
    """Ids and byte lengths of tokens by a byte-level BPE rank file; the tokens of a text are its bytes, cut up."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        return np.array(self.encoding.encode_ordinary(text), np.int64)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

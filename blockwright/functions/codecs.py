"""Entropy and general-purpose codecs, with decoding that never makes more than a bound."""

from __future__ import annotations

import heapq
import lzma
import zlib
from dataclasses import dataclass

import numpy as np
import zstandard

from blockwright.guards import FormatError, OutputLimitError, TruncatedError

# Ids in containers, and native levels of the portable levels 1 to 4.
BACKENDS = {"huffman": 0, "zlib": 1, "lzma": 2, "zstd": 3}
NAMES = {v: k for k, v in BACKENDS.items()}
PORTABLE = {"zstd": (3, 6, 19, 22), "zlib": (1, 6, 9, 9), "lzma": (0, 3, 9, 9)}
DEFAULT_LEVEL = {"zstd": 19, "lzma": 6, "zlib": 6, "huffman": 0}
TABLE_BYTES = 512
#: Codecs with models (see ``modelled.STORED``): backends of frames; containers have no ids for them.
FRAMES_ONLY = ("grammar", "order1_huffman", "range")
_LZMA_WINDOW = [1 << b for b in (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)]


def _modelled(backend: str) -> tuple:
    from blockwright.functions.modelled import STORED

    return STORED[backend]


def native_level(backend: str, level: int) -> int:
    """1 to 4 are portable levels; others are the codec's own, within its range."""
    if backend not in BACKENDS and backend not in FRAMES_ONLY:
        raise ValueError(f"backend {backend!r}; known: {', '.join((*BACKENDS, *FRAMES_ONLY))}")
    if backend in PORTABLE and 1 <= level <= 4:
        return PORTABLE[backend][level - 1]
    return max(0, min(9, level)) if backend in ("zlib", "lzma") else level


@dataclass(frozen=True)
class Codec:
    """One backend at one native level; extreme: lzma's slow mode; dictionary: for zstd."""

    backend: str = "zlib"
    level: int = 6
    extreme: bool = False
    dictionary: bytes = b""

    def __post_init__(self) -> None:
        native_level(self.backend, self.level)
        if self.dictionary and self.backend != "zstd":
            raise ValueError("only zstd takes a dictionary")

    def compress(self, data: bytes) -> bytes:
        if self.backend == "zlib":
            return zlib.compress(data, self.level)
        if self.backend == "lzma":
            # a window of the data's size finds all that the preset's larger one would, without its memory
            window = min(_LZMA_WINDOW[self.level], 1 << max(12, (len(data) - 1).bit_length() if data else 0))
            preset = self.level | (lzma.PRESET_EXTREME if self.extreme else 0)
            return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": window}])
        if self.backend == "zstd":
            given = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None
            return zstandard.ZstdCompressor(level=self.level, dict_data=given).compress(data)
        if self.backend in FRAMES_ONLY:
            return _modelled(self.backend)[0](data)
        return Huffman.of(data).encode(data)[0]

    def cost(self, payload: bytes, extra: bytes, version: int = 3) -> int:
        """Bytes by which candidates are compared; version 2 counts the fields of a Huffman block too."""
        fields = 1 + (6 if version == 2 and self.backend == "huffman" else 0)  # there: length of extra, padding, length of payload
        return len(payload) + fields + len(extra) + (TABLE_BYTES if self.backend == "huffman" else 0)


def inflate(backend: str, data: bytes, bound: int, dictionary: bytes = b"") -> bytes:
    """Decodes at most bound bytes; more is an error, found after bound + 1."""
    if backend == "zlib":
        d = zlib.decompressobj()
        try:
            out = d.decompress(data, bound + 1)
        except zlib.error as e:
            raise FormatError(f"zlib: {e}") from e
        ended = d.eof
    elif backend == "lzma":
        out, ended, rest = b"", False, data
        while rest and len(out) <= bound:
            d = lzma.LZMADecompressor()
            try:
                out += d.decompress(rest, bound + 1 - len(out))
            except lzma.LZMAError as e:
                if ended:  # what follows a whole member is no member
                    break
                raise FormatError(f"lzma: {e}") from e
            ended, rest = d.eof, d.unused_data if d.eof else b""
    elif backend == "zstd":
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        d = zstandard.ZstdDecompressor(dict_data=given).decompressobj()
        reader = zstandard.ZstdDecompressor(dict_data=given).stream_reader(data)
        try:
            out = reader.read(bound + 1)
            ended = len(out) > bound or (d.decompress(data) is not None and d.eof)
        except zstandard.ZstdError as e:
            raise FormatError(f"zstd: {e}") from e
    elif backend in FRAMES_ONLY:
        return _modelled(backend)[1](data, bound)
    else:
        raise FormatError(f"backend {backend!r}")
    if len(out) > bound:
        raise OutputLimitError(f"a payload inflates to over {bound} bytes")
    if not ended:
        raise TruncatedError(f"{backend}: the payload ends too soon")
    return out


class Huffman:
    """Order-0 codes. Merges take the two smallest weights, of equal ones the older; a lone symbol gets a sibling."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        used = np.flatnonzero(counts).tolist()
        heap = [(int(counts[s]), i, s) for i, s in enumerate(used)]
        if len(heap) == 1:
            heap.append((0, 1, (used[0] + 1) % 256))
        heapq.heapify(heap)
        made = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], made, (a[2], b[2])))
            made += 1
        self.tree = heap[0][2] if heap else None
        self.codes: dict[int, str] = {}
        todo = [(self.tree, "")] if heap else []
        while todo:
            node, code = todo.pop()
            if isinstance(node, tuple):
                todo += [(node[0], code + "0"), (node[1], code + "1")]
            else:
                self.codes[node] = code

    @classmethod
    def of(cls, data: bytes) -> Huffman:
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        top = int(counts.max()) if len(data) else 0
        return cls(-(-counts * 65535 // top) if top > 65535 else counts)

    def size(self, data_counts: np.ndarray) -> int:
        """Bytes of the codes and the table, without making them."""
        bits = sum(int(data_counts[s]) * len(c) for s, c in self.codes.items())
        return -(-bits // 8) + TABLE_BYTES

    def encode(self, data: bytes) -> tuple[bytes, int]:
        """(bytes, bits of padding)."""
        if not data:
            return b"", 0
        longest = max(map(len, self.codes.values()))
        bits = np.full((256, longest), 2, np.uint8)
        for s, c in self.codes.items():
            bits[s, : len(c)] = list(map(int, c))
        parts = []
        for at in range(0, len(data), 1 << 16):
            flat = bits[np.frombuffer(data[at : at + (1 << 16)], np.uint8)].ravel()
            parts.append(flat[flat < 2])
        flat = np.concatenate(parts)
        return np.packbits(flat).tobytes(), -len(flat) % 8

    def decode(self, data: bytes, n: int, padding: int = 0) -> bytes:
        """n symbols."""
        if not n:
            return b""
        if self.tree is None:
            raise FormatError("huffman: no symbols")
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        bits = bits[: len(bits) - padding]
        longest = max(map(len, self.codes.values()))
        if longest > 16:
            return self._walk(bits, n)
        # at each bit, the symbol whose code stands there and the bit after that code
        ahead = np.zeros(len(bits), np.int32)
        for j in range(longest):
            ahead <<= 1
            ahead[: max(0, len(bits) - j)] |= bits[j:]
        symbol, size = np.zeros(1 << longest, np.uint8), np.zeros(1 << longest, np.uint8)
        for s, code in self.codes.items():
            lo = int(code, 2) << longest - len(code)
            symbol[lo : lo + (1 << longest - len(code))] = s
            size[lo : lo + (1 << longest - len(code))] = len(code)
        found, step = symbol[ahead].tobytes(), (np.arange(len(bits)) + size[ahead]).tolist()
        out, at, end = bytearray(n), 0, len(bits)
        for i in range(n):
            if at >= end:
                raise TruncatedError("huffman: the payload ends too soon")
            out[i] = found[at]
            at = step[at]
        if at > end:
            raise TruncatedError("huffman: the payload ends too soon")
        return bytes(out)

    def _walk(self, bits: np.ndarray, n: int) -> bytes:
        """Bit by bit, for codes of more than 16 bits."""
        out, node, tree = bytearray(), self.tree, self.tree
        for bit in bits.tolist():
            node = node[bit]
            if not isinstance(node, tuple):
                out.append(node)
                if len(out) == n:
                    return bytes(out)
                node = tree
        raise TruncatedError("huffman: the payload ends too soon")

"""Reversible byte transforms as numpy kernels, in a registry that may be extended.

A transform turns bytes into (bytes, extra) and back; None says that it doesn't apply.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

from blockwright.guards import FormatError, TruncatedError

Encoded = tuple[bytes, bytes] | None
BWT_LIMIT = 1 << 18


def _u8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def _running(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint8)


def delta(data: bytes) -> bytes:
    x = _u8(data)
    return np.diff(x, prepend=np.zeros(1, np.uint8)).tobytes()


def undelta(data: bytes) -> bytes:
    return _running(_u8(data)).tobytes()


def xor_delta(data: bytes) -> bytes:
    x = _u8(data)
    return (x ^ np.concatenate([np.zeros(1, np.uint8), x[:-1]])[: len(x)]).tobytes()


def unxor_delta(data: bytes) -> bytes:
    return np.bitwise_xor.accumulate(_u8(data)).tobytes() if data else b""


def delta2(data: bytes) -> bytes:
    if len(data) < 2:
        return data
    d = _u8(delta(data))
    return np.concatenate([d[:1], d[1:2], np.diff(d[1:])]).tobytes()


def undelta2(data: bytes) -> bytes:
    if len(data) < 2:
        return data
    y = _u8(data)
    return _running(np.concatenate([y[:1], _running(y[1:])])).tobytes()


def order2(data: bytes) -> bytes:
    if len(data) < 2:
        return data
    x = _u8(data)
    return np.concatenate([x[:2], np.diff(x, 2)]).tobytes()


def unorder2(data: bytes) -> bytes:
    if len(data) < 2:
        return data
    y = _u8(data)
    steps = _running(np.concatenate([y[1:2] - y[:1], y[2:]]))
    return _running(np.concatenate([y[:1], steps])).tobytes()


_ZIGZAG = np.array([2 * d if d < 128 else 511 - 2 * d for d in range(256)], np.uint8)
_UNZIGZAG = np.argsort(_ZIGZAG).astype(np.uint8)


def _zigzag_from(data: bytes, at: int, table: np.ndarray) -> bytes:
    y = _u8(data).copy()
    y[at:] = table[y[at:]]
    return y.tobytes()


def delta_zigzag(data: bytes) -> bytes:
    return _zigzag_from(delta(data), 1, _ZIGZAG)


def undelta_zigzag(data: bytes) -> bytes:
    return undelta(_zigzag_from(data, 1, _UNZIGZAG))


def delta2_zigzag(data: bytes) -> bytes:
    return data if len(data) < 2 else _zigzag_from(delta2(data), 2, _ZIGZAG)


def undelta2_zigzag(data: bytes) -> bytes:
    return data if len(data) < 2 else undelta2(_zigzag_from(data, 2, _UNZIGZAG))


def shuffle(data: bytes, stride: int) -> bytes:
    if len(data) < 2 * stride:
        return data
    return b"".join(data[o::stride] for o in range(stride))


def unshuffle(data: bytes, stride: int) -> bytes:
    n = len(data)
    if n < 2 * stride:
        return data
    out, at = bytearray(n), 0
    for o in range(stride):
        size = -(-(n - o) // stride)
        out[o::stride] = data[at : at + size]
        at += size
    return bytes(out)


def _quads(data: bytes) -> bool:
    return len(data) >= 8 and len(data) % 4 == 0


def bit_transpose(data: bytes) -> bytes:
    """Its own inverse."""
    whole = len(data) // 8 * 8
    if not whole:
        return data
    bits = np.unpackbits(_u8(data[:whole]).reshape(-1, 8, 1), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").tobytes() + data[whole:]


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal bytes."""
    x = _u8(data)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return first, np.diff(np.append(first, len(x)))


def rle(data: bytes) -> bytes:
    first, size = runs(data)
    parts = -(-size // 65535)
    value = np.repeat(_u8(data)[first], parts)
    count = np.full(len(value), 65535)
    if len(count):
        last = np.cumsum(parts) - 1
        count[last] = size - (parts - 1) * 65535
    return np.column_stack([value, count >> 8, count & 255]).astype(np.uint8).tobytes()


def unrle(data: bytes) -> bytes:
    t = _u8(data[: len(data) // 3 * 3]).reshape(-1, 3)
    return np.repeat(t[:, 0], t[:, 1].astype(np.int64) << 8 | t[:, 2]).tobytes()


def zero_rle(data: bytes) -> bytes:
    """Runs of 4 to 259 zeros become four zeros and a count of the rest; longer ones several of these."""
    out, at = [], 0
    first, size = runs(data)
    zero = (_u8(data)[first] == 0) & (size >= 4) if len(first) else np.zeros(0, bool)
    for start, n in zip(first[zero].tolist(), size[zero].tolist(), strict=True):
        out.append(data[at:start])
        at = start + n
        while n >= 4:
            k = min(n, 259)
            out.append(b"\0\0\0\0" + bytes((k - 4,)))
            n -= k
        out.append(b"\0" * n)
    return b"".join([*out, data[at:]])


def unzero_rle(data: bytes) -> bytes:
    out, at = [], 0
    while (i := data.find(b"\0\0\0\0", at)) >= 0 and i + 4 < len(data):
        out += [data[at : i + 4], b"\0" * data[i + 4]]
        at = i + 5
    return b"".join([*out, data[at:]])


def mtf(data: bytes) -> bytes:
    """Only the first byte of each run moves anything; the others' places are 0."""
    if not data:
        return b""
    x = _u8(data)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    table, moved = bytearray(range(256)), bytearray(len(first))
    find, pop, insert = table.index, table.pop, table.insert
    for at, b in enumerate(x[first].tobytes()):
        i = find(b)
        if i:
            insert(0, pop(i))
            moved[at] = i
    out = np.zeros(len(x), np.uint8)
    out[first] = _u8(bytes(moved))
    return out.tobytes()


def unmtf(data: bytes) -> bytes:
    """A place of 0 repeats the byte before."""
    if not data:
        return b""
    x = _u8(data)
    moves = np.flatnonzero(x)
    moves = moves if len(moves) and moves[0] == 0 else np.append(0, moves)
    table, heads = bytearray(range(256)), bytearray(len(moves))
    pop, insert = table.pop, table.insert
    for at, i in enumerate(x[moves].tobytes()):
        if i:
            insert(0, pop(i))
        heads[at] = table[0]
    return np.repeat(_u8(bytes(heads)), np.diff(np.append(moves, len(x)))).tobytes()


def bwt(data: bytes) -> tuple[bytes, int] | None:
    """Last bytes of all rotations in order (equal ones by place), and the place of the text itself."""
    n = len(data)
    if n > BWT_LIMIT:
        return None
    if not n:
        return b"", 0
    x = _u8(data)
    place, k = np.arange(n), 7
    key = np.zeros(n, np.int64)  # the first seven bytes of each rotation
    for j in range(k):
        key = key << 8 | x[(place + j) % n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
    while k < n and rank[order[-1]] < n - 1:
        key = rank * (int(rank.max()) + 1) + rank[(place + k) % n]
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        rank, k = new, 2 * k
    return x[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def unbwt(last: bytes, primary: int) -> bytes:
    """Follows the places of rotations by doubling: the path of k steps gives that of 2 k."""
    n = len(last)
    if not n:
        return b""
    if not 0 <= primary < n:
        raise FormatError(f"primary index {primary} of {n}")
    x = _u8(last)
    step = np.argsort(x, kind="stable")
    path = step[[primary]]
    while len(path) < n:
        path = np.concatenate([path, step[path]])
        step = step[step]
    return x[path[:n]].tobytes()


def _primary(extra: bytes) -> int:
    if len(extra) == 2:
        return struct.unpack(">H", extra)[0]
    if len(extra) != 4:
        raise FormatError("the primary index takes 4 bytes")
    return struct.unpack(">I", extra)[0]


class Memo:
    """What several transforms of one block share."""

    def __init__(self, data: bytes) -> None:
        self.data, self._moved = data, None

    def moved(self) -> tuple[bytes, int] | None:
        """BWT, then MTF."""
        if self._moved is None:
            got = bwt(self.data)
            self._moved = ((mtf(got[0]), got[1]) if got else False,)
        return self._moved[0] or None


def _bwt_mtf(data: bytes, memo: Memo) -> Encoded:
    got = memo.moved()
    return (got[0], struct.pack(">I", got[1])) if got else None


def _bwt_mtf_rle(data: bytes, memo: Memo) -> Encoded:
    got = memo.moved()
    return (zero_rle(got[0]), struct.pack(">I", got[1])) if got else None


def _bwt_parts(data: bytes, memo: Memo) -> Encoded:
    if len(data) <= BWT_LIMIT:
        return _bwt_mtf(data, memo)
    parts = [data[i : i + BWT_LIMIT] for i in range(0, len(data), BWT_LIMIT)]
    if 8 + 4 * len(parts) > 255:
        return None  # the extra field couldn't be written
    made = [bwt(p) for p in parts]
    extra = struct.pack(f">II{len(parts)}I", BWT_LIMIT, len(parts), *(p for _, p in made))
    return b"".join(mtf(b) for b, _ in made), extra


def _unbwt_parts(data: bytes, extra: bytes) -> bytes:
    if len(extra) == 4:
        return unbwt(unmtf(data), _primary(extra))
    if len(extra) < 8:
        raise FormatError("sub-block table")
    size, count = struct.unpack_from(">II", extra)
    if count > 4096 or not 0 < size <= 1 << 24 or len(extra) != 8 + 4 * count:
        raise FormatError("sub-block table")
    out = []
    for k, primary in enumerate(struct.unpack_from(f">{count}I", extra, 8)):
        part = data[k * size : (k + 1) * size]
        out.append(part if primary == 0xFFFFFFFF else unbwt(unmtf(part), primary))
    return b"".join(out)


_TOKEN = re.compile(rb"\s+|\S+")


def record_columns(data: bytes) -> bytes:
    """Lines cut into words and white space; the k-th pieces of all lines stand together, with what is needed to undo it."""
    lines = [_TOKEN.findall(line) for line in data.split(b"\n")]
    wide = max(map(len, lines))
    columns = [b"\n".join(line[k] for line in lines if len(line) > k) for k in range(wide)]
    head = struct.pack(">II", len(lines), wide) + struct.pack(f">{len(lines)}I", *map(len, lines)) + struct.pack(f">{wide}I", *map(len, columns))
    return head + b"".join(columns)


def unrecord_columns(data: bytes) -> bytes:
    try:
        n, wide = struct.unpack_from(">II", data)
        counts = struct.unpack_from(f">{n}I", data, 8)
        sizes = struct.unpack_from(f">{wide}I", data, 8 + 4 * n)
    except struct.error as e:
        raise TruncatedError("record columns") from e
    at, columns = 8 + 4 * (n + wide), []
    for size in sizes:
        columns.append(iter(data[at : at + size].split(b"\n")))
        at += size
    try:
        return b"\n".join(b"".join(next(columns[k]) for k in range(c)) for c in counts)
    except (StopIteration, RuntimeError, IndexError) as e:
        raise FormatError("record columns") from e


def xor_previous(data: bytes, previous: bytes | None) -> bytes:
    """Its own inverse; the previous block is cycled."""
    if not previous or not data:
        return data
    x = _u8(data)
    return (x ^ np.resize(_u8(previous), len(x))).tobytes()


@dataclass(frozen=True)
class Transform:
    """encode: (bytes, Memo) -> (bytes, extra) or None; decode: (bytes, extra) -> bytes;
    expansion: most bytes it makes of one; rank: place in version 4's order, where ties keep the first."""

    tid: int
    name: str
    encode: Callable[[bytes, Memo], Encoded]
    decode: Callable[[bytes, bytes], bytes]
    expansion: int = 1
    rank: int = 1000
    searched: bool = True


REGISTRY: dict[int, Transform] = {}
# The order in which version 4 tries transforms.
PRIORITY = (0, 19, 5, 16, 1, 7, 12, 2, 3, 6, 8, 9, 10, 11, 13, 14, 15, 17)


def register_transform(tid: int, name: str, encode: Callable, decode: Callable, expansion: int = 1, searched: bool = True) -> Transform:
    """Adds a transform; ids and names are kept for good."""
    if tid in REGISTRY or not 0 <= tid <= 255 or any(t.name == name for t in REGISTRY.values()):
        raise ValueError(f"transform {tid} {name}: the id or name is taken or out of range")
    REGISTRY[tid] = Transform(tid, name, encode, decode, expansion, PRIORITY.index(tid) if tid in PRIORITY else 1000 + tid, searched)
    return REGISTRY[tid]


def _plain(tid: int, name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes], expansion: int = 1, extra: bytes = b"", searched: bool = True) -> None:
    register_transform(tid, name, lambda d, _: (encode(d), extra), lambda d, _: decode(d), expansion, searched)


_plain(0, "RAW", lambda d: d, lambda d: d)
_plain(1, "DELTA", delta, undelta)
_plain(2, "XOR_DELTA", xor_delta, unxor_delta)
_plain(3, "DELTA2", delta2, undelta2)
_plain(4, "MTF", mtf, unmtf)
register_transform(5, "BWT_MTF", _bwt_mtf, lambda d, e: unbwt(unmtf(d), _primary(e)))
for _tid, _k in ((6, 2), (7, 4), (8, 8)):
    _plain(_tid, f"SHUFFLE_{_k}", lambda d, k=_k: shuffle(d, k), lambda d, k=_k: unshuffle(d, k), extra=bytes((_k,)))
_plain(9, "DELTA_ZIGZAG", delta_zigzag, undelta_zigzag)
_plain(10, "DELTA2_ZIGZAG", delta2_zigzag, undelta2_zigzag)
_plain(11, "ORDER2", order2, unorder2)
register_transform(12, "BWT_MTF_RLE", _bwt_mtf_rle, lambda d, e: unbwt(unmtf(unzero_rle(d)), _primary(e)), expansion=2)
_plain(13, "FLOAT_SPLIT", lambda d: shuffle(d, 4) if _quads(d) else d, lambda d: unshuffle(d, 4) if _quads(d) else d, extra=b"\4")
_plain(14, "BIT_TRANSPOSE", bit_transpose, bit_transpose)
_plain(15, "SHUFFLE4_DELTA", lambda d: delta(shuffle(d, 4)), lambda d: unshuffle(undelta(d), 4), extra=b"\4")
register_transform(16, "BWT_SUBBLOCK", _bwt_parts, _unbwt_parts)
_plain(17, "DICT_RESERVED", lambda d: d, lambda d: d, searched=False)
_plain(18, "RECORD_COLUMNS", record_columns, unrecord_columns, expansion=9, searched=False)
_plain(19, "RLE", rle, unrle, expansion=3)
XOR_PREV, BIT_PLANE = 99, 100
_plain(BIT_PLANE, "BIT_PLANE", lambda d: shuffle(d, 4) if _quads(d) else d, lambda d: unshuffle(d, 4) if _quads(d) else d, searched=False)


def encode(tid: int, data: bytes, memo: Memo | None = None) -> Encoded:
    if tid not in REGISTRY:
        raise FormatError(f"transform {tid} is unknown")
    return REGISTRY[tid].encode(data, memo or Memo(data))


def decode(tid: int, data: bytes, extra: bytes) -> bytes:
    if tid not in REGISTRY:
        raise FormatError(f"transform {tid} is unknown")
    return REGISTRY[tid].decode(data, extra)


def listing() -> list[dict[str, Any]]:
    """The registry as rows."""
    rows = [dict(tid=t.tid, name=t.name, expansion=t.expansion, rank=t.rank, searched=t.searched) for t in REGISTRY.values()]
    return sorted([*rows, dict(tid=XOR_PREV, name="XOR_PREV", expansion=1, rank=1000 + XOR_PREV, searched=False)], key=lambda r: r["tid"])

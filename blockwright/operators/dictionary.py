"""Shared dictionaries for zstd: sampled, trained and kept only if they pay."""

from __future__ import annotations

import lzma
import struct

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.functions.codecs import Codec
from blockwright.guards import TruncatedError
from blockwright.operators.stats import chunk_bounds

SAMPLE_BYTES, PIECE, TARGET = 1_000_000, 8192, 65536


def sample(blocks: DataFrame, limit: int = SAMPLE_BYTES) -> list[bytes]:
    """Pieces of about ``limit`` bytes of blocks, chosen by a hash: the driver holds no more, whatever the table's size."""
    total = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    share = min(1.0, 2 * limit / total) if total else 0
    rows = blocks.filter(F.pmod(F.xxhash64("object_id", "block_no"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1)).select("data")
    out, size = [], 0
    for r in rows.toLocalIterator():
        data = bytes(r["data"])
        out += [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        size += len(data)
        if size >= limit:
            break
    return out


def ranked_grams(data: bytes, size: int, least: int = 3) -> list[bytes]:
    """n-grams (1 to 8 bytes) that come at least ``least`` times, the commonest first, of equal counts the earlier."""
    n = len(data) - size + 1
    if n < 1:
        return []
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(size):
        g = g << np.uint64(8) | x[j : j + n]
    _, first, times = np.unique(g, return_index=True, return_counts=True)
    first, times = first[times >= least], times[times >= least]
    return [data[i : i + size] for i in first[np.lexsort((first, -times))].tolist()]


def common_grams(data: bytes, size: int = 6, least: int = 3, limit: int = TARGET) -> bytes:
    """Frequent n-grams joined by zero bytes; empty if too little."""
    joined = b"\0".join(ranked_grams(data, size, least)[: limit // (size + 1)])
    return joined if len(joined) > 256 else b""


def train(pieces: list[bytes], size: int = TARGET) -> bytes:
    """A zstd dictionary of at most 64 KiB; n-grams where there is too little to train on; empty below 1024 bytes."""
    if sum(map(len, pieces)) < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return common_grams(b"".join(pieces))


def gate(pieces: list[bytes], dictionary: bytes, level: int, block_size: int = 65536) -> tuple[int, int, bool]:
    """(bytes without, bytes with and the dictionary's length field, whether it pays) on the first 64 KiB of the sample, which is all that this gate looks at."""
    head = b"".join(pieces)[: 1 << 16]
    parts = [head[i : i + block_size] for i in range(0, len(head), block_size)]
    without = sum(len(Codec("zstd", level).compress(p)) for p in parts)
    with_it = sum(len(Codec("zstd", level, dictionary=dictionary).compress(p)) for p in parts) + len(dictionary) + 4 if dictionary else without
    return without, with_it, with_it < without


# Dictionaries of one object: version 3 trains on its first bytes, version 4 gathers 8-grams of its chunks.

#: Most bytes of a version 4 dictionary that a container stores.
STORED = 32768


def shared(data: bytes) -> bytes:
    """Version 3: trained on the first million bytes; empty below 1024 bytes."""
    head = data[:SAMPLE_BYTES]
    return train([head[i : i + PIECE] for i in range(0, len(head), PIECE)])


def _packed(data: bytes, level: int, dictionary: bytes = b"") -> int:
    return len(Codec("zstd", level, dictionary=dictionary).compress(data))


def shared_pays(data: bytes, dictionary: bytes, level: int) -> bool:
    """Version 3's gate: over 64 KiB of data, whose first 64 KiB are smaller by more than the dictionary and its length field."""
    head = data[: 1 << 16]
    return bool(dictionary) and len(data) > 1 << 16 and _packed(head, level, dictionary) + len(dictionary) + 4 < _packed(head, level)


def gathered(data: bytes, limit: int = TARGET, sample_bytes: int = 1 << 20) -> bytes:
    """Version 4: the commonest 8-grams of the first 64 chunks of the object, or, from 8 MiB on, of three parts of it.

    Little data, or few 8-grams: the sample's beginning.  two-pass writers take a sample of up to 4 MiB.
    """
    if len(data) < 512:
        return b""
    half = 512 << 10
    raw = data if len(data) < 8 << 20 else data[:half] + data[len(data) // 2 :][:half] + data[-half:]
    bounds = chunk_bounds(raw, multiplier=31, most=256)[:64]
    sample = raw[: bounds[-1][1]][:sample_bytes]
    if len(sample) < 8192 and len(data) < 8 << 20:
        sample = data[:sample_bytes]
    if len(sample) < 8192:
        return sample[:limit]
    joined = b"".join(ranked_grams(sample, 8)[: -(-limit // 8)])
    return (joined if len(joined) >= 1024 else sample)[:limit]


def gathered_pays(data: bytes, dictionary: bytes, level: int) -> bool:
    """Version 4's gate: what the first 256 KiB gain, against the size of the dictionary as stored; where they are all, against all of it."""
    if len(dictionary) <= 512:
        return False
    head, kept = data[: 256 << 10], dictionary[:STORED]
    gain, price = _packed(head, level) - _packed(head, level, kept), len(lzma.compress(kept, preset=9))
    if len(data) <= 256 << 10:
        return gain > price
    return gain > 0.8 * price if len(data) <= 1 << 20 else gain > 0.3 * price or gain > 1024


def dictionary_for(data: bytes, version: int, level: int, force: bool = False, two_pass: bool = False) -> bytes:
    """The dictionary that a container of one object gets, or none where it doesn't pay. force: whether or not it pays."""
    if version >= 4:
        made = gathered(data, sample_bytes=(4 if two_pass else 1) << 20) if len(data) > 4096 or two_pass else b""
        return made[:STORED] if len(made) > 512 and (force or gathered_pays(data, made, level)) else b""
    made = shared(data)
    return made if made and (force or shared_pays(data, made, level)) else b""


def pack_chunks(chunks: list[bytes], limit: int = TARGET) -> bytes:
    """Chunks of at most 65535 bytes, each after its length (2 bytes, big-endian), as many of the first ones as fit the limit."""
    out = b""
    for c in chunks:
        if len(out) + 2 + len(c) > limit:
            break
        out += struct.pack(">H", len(c)) + c
    return out


def unpack_chunks(packed: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(packed):
        if at + 2 > len(packed) or at + 2 + (n := struct.unpack_from(">H", packed, at)[0]) > len(packed):
            raise TruncatedError("a chunk dictionary ends too soon")
        out.append(packed[at + 2 : at + 2 + n])
        at += 2 + n
    return out

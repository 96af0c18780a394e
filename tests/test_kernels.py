import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockwright.functions import codecs as c
from blockwright.functions import kernels as k
from blockwright.guards import FormatError, OutputLimitError, TruncatedError

# Inputs at the boundaries of the transforms' rules.
CASES = [b"", b"a", b"ab", b"aaaa", b"a" * 1000, b"\0" * 1000, b"\xff" * 1000, bytes(range(256)) * 4, b"hello world " * 1000, b"\0\0\0\0ab" * 100, b"\xff\xfe\xfd" * 500, b"\0\1" * 2000, b"ab" * 1500, b"abc" * 1000, b"banana" * 200]
CASES += [b"\0" * n for n in (3, 4, 5, 258, 259, 260, 263, 518)] + [b"a" * n for n in (65534, 65535, 65536, 70000)] + [b"x" + b"\0" * n + b"y" for n in (3, 4, 259, 262, 263)]
CASES += [bytes(range(256)) * 300 + b"q" * n for n in (0, 1, 3)]


@pytest.mark.parametrize("tid", sorted(k.REGISTRY))
def test_round_trips(tid):
    for data in CASES:
        got = k.encode(tid, data)
        assert k.decode(tid, *got) == data
        assert len(got[0]) <= len(data) * k.REGISTRY[tid].expansion + 64


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=300), st.lists(st.sampled_from(list(b"\0\0\0ab\n ")), max_size=400).map(bytes)))
def test_round_trips_of_any_bytes(data):
    for t in k.REGISTRY.values():
        assert t.decode(*t.encode(data, k.Memo(data))) == data


def slow(tid, x):
    """The rules, one byte at a time."""
    n, at = len(x), lambda i: x[i]
    d = [x[0] if i == 0 else (x[i] - x[i - 1]) % 256 for i in range(n)]
    zig = lambda v: 2 * v if v < 128 else 511 - 2 * v
    if tid == 1:
        return d
    if tid == 2:
        return [x[0] if i == 0 else x[i] ^ x[i - 1] for i in range(n)]
    if tid in (3, 10):
        y = [d[i] if i < 2 else (d[i] - d[i - 1]) % 256 for i in range(n)]
        return y if tid == 3 else [v if i < 2 else zig(v) for i, v in enumerate(y)]
    if tid == 9:
        return [v if i < 1 else zig(v) for i, v in enumerate(d)]
    if tid == 11:
        return [at(i) if i < 2 else (x[i] - 2 * x[i - 1] + x[i - 2]) % 256 for i in range(n)]
    if tid == 4:
        table, out = list(range(256)), []
        for b in x:
            i = table.index(b)
            out.append(i)
            table.insert(0, table.pop(i))
        return out
    if tid == 14:
        out = list(x)
        for g in range(n // 8):
            for j in range(8):
                out[8 * g + j] = sum((x[8 * g + i] >> j & 1) << i for i in range(8))
        return out


@pytest.mark.parametrize("tid", [1, 2, 3, 4, 9, 10, 11, 14])
def test_kernels_against_rules(tid):
    rng = random.Random(tid)
    for n in (2, 3, 8, 17, 100, 300):
        data = bytes(rng.choices(range(256), k=n))
        assert list(k.encode(tid, data)[0]) == slow(tid, data)


def test_bwt_against_sorted_rotations():
    rng = random.Random(5)
    for data in [b"banana", b"ab" * 20, b"aaaa", b"a"] + [bytes(rng.choices(b"abc", k=n)) for n in (5, 30, 200)]:
        order = sorted(range(len(data)), key=lambda i: (data[i:] + data[:i], i))
        assert k.bwt(data) == (bytes(data[i - 1] for i in order), order.index(0))


def test_golden_vectors():
    # Fixed values.
    assert k.delta(bytes((10, 11, 13))) == bytes((10, 1, 2))
    assert k.shuffle(b"abcd" * 4, 4) == b"aaaabbbbccccdddd"
    assert k.bwt(b"banana") == (b"nnbaaa", 3)
    assert len(k.rle(b"z" * 5_000_000)) == 231


def test_sub_blocks_and_limits():
    data = os.urandom(k.BWT_LIMIT + 5)
    assert k.encode(5, data) is None
    got = k.encode(16, data)
    assert len(got[1]) == 16 and k.decode(16, *got) == data
    with pytest.raises(FormatError):
        k.unbwt(b"abc", 3)
    with pytest.raises(FormatError):
        k.decode(16, b"abc", b"\0" * 12)
    with pytest.raises(FormatError):
        k.decode(77, b"", b"")


def test_registering_transforms():
    with pytest.raises(ValueError):
        k.register_transform(0, "NEW", None, None)
    k.register_transform(200, "FLIP", lambda d, _: (d[::-1], b""), lambda d, _: d[::-1], searched=False)
    try:
        assert k.decode(200, *k.encode(200, b"abc")) == b"abc"
    finally:
        del k.REGISTRY[200]


def test_xor_previous():
    assert k.xor_previous(k.xor_previous(b"abcdef", b"xyz"), b"xyz") == b"abcdef"
    assert k.xor_previous(b"abc", None) == b"abc"


@pytest.mark.parametrize("backend", ["zlib", "lzma", "zstd"])
def test_bounded_decoding(backend):
    payload = c.Codec(backend, 3).compress(b"a" * 100_000)
    assert c.inflate(backend, payload, 100_000) == b"a" * 100_000
    with pytest.raises(OutputLimitError):
        c.inflate(backend, payload, 99_999)
    with pytest.raises((TruncatedError, FormatError)):
        c.inflate(backend, payload[: len(payload) // 2], 100_000)
    with pytest.raises((FormatError, TruncatedError)):
        c.inflate(backend, b"nonsense" * 3, 100)


def test_lzma_members():
    two = c.Codec("lzma", 1).compress(b"one") + c.Codec("lzma", 1).compress(b"two") + b"junk"
    assert c.inflate("lzma", two, 100) == b"onetwo"


def test_huffman():
    for data in [b"", b"a", b"aaaa", b"abracadabra", os.urandom(1000), bytes(range(256)) * 20, b"\0" * 100_000 + bytes(range(256)) * 20]:
        h = c.Huffman.of(data)
        payload, padding = h.encode(data)
        assert h.decode(payload, len(data), padding) == data
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        assert h.size(counts) == len(payload) + c.TABLE_BYTES
        assert max(h.counts, default=0) <= 65535
        bits = np.unpackbits(np.frombuffer(payload, np.uint8))[: len(payload) * 8 - padding]
        assert not data or h._walk(bits, len(data)) == data
        for n in range(0, len(payload), max(1, len(payload) // 7)):
            with pytest.raises(TruncatedError):
                h.decode(payload[:n], len(data))
    with pytest.raises(TruncatedError):
        c.Huffman.of(b"abracadabra").decode(b"", 5)
    fib = [1, 1]
    while len(fib) < 22:
        fib.append(fib[-1] + fib[-2])
    data = b"".join(bytes((i,)) * n for i, n in enumerate(fib))
    h = c.Huffman.of(data)
    assert max(map(len, h.codes.values())) > 16 and h.decode(h.encode(data)[0], len(data), h.encode(data)[1]) == data


def test_levels():
    assert c.native_level("zstd", 3) == 19 and c.native_level("zlib", 50) == 9 and c.native_level("lzma", 2) == 3
    with pytest.raises(ValueError):
        c.native_level("brotli", 1)
    with pytest.raises(ValueError):
        c.Codec("lzma", dictionary=b"x")

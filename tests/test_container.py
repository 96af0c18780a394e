import io
import struct

import pytest

from blockwright import __main__ as cli
from blockwright import guards
from blockwright.functions import kernels
from blockwright.functions.codecs import Codec
from blockwright.sources import container as c

TEXT = b"the quick brown fox jumps over the lazy dog\n" * 300


@pytest.mark.parametrize("backend", ["zstd", "zlib", "lzma", "huffman"])
@pytest.mark.parametrize("version", [2, 3, 4])
def test_round_trip(backend, version):
    for data in (b"", b"a", TEXT, bytes(range(256)) * 50, struct.pack("<1000I", *range(1000))):
        for fast in (False, True):
            assert c.decompress(c.compress(data, 1, 4096, backend, fast, version)) == data


def test_deterministic():
    assert c.compress(TEXT) == c.compress(TEXT)


def test_truncation():
    whole = c.compress(TEXT, 1, 4096)
    for n in (7, 20, len(whole) - 1):
        with pytest.raises(guards.TruncatedError):
            c.decompress(whole[:n])


def damaged(at, value):
    whole = bytearray(c.compress(TEXT, 1, 65536, "zlib"))
    whole[at : at + len(value)] = value
    return bytes(whole)


def test_damage():
    for bad in (damaged(0, b"X"), damaged(4, b"\x09"), damaged(5, b"\x09"), damaged(18, b"\x63\x00\xff")):
        with pytest.raises(guards.BlockError):
            c.decompress(bad)
    with pytest.raises(guards.FormatError):
        c.decompress(c.compress(TEXT) + b"x")
    with pytest.raises(guards.OutputLimitError):
        c.decompress(c.compress(TEXT), len(TEXT) - 1)
    assert c.decompress(c.compress(TEXT), len(TEXT)) == TEXT


def framed(orig_len, payload, tid=0, extra=b""):
    return c.pack_header(c.Header(3, "zlib", 1, 65536)) + c.pack_frame(c.Frame(tid, extra, orig_len, payload), "zlib")


def test_bombs():
    bomb = Codec("zlib").compress(b"\0" * 10_000_000)
    with pytest.raises(guards.OutputLimitError):
        c.decompress(framed(100, bomb))
    with pytest.raises(guards.OutputLimitError):
        c.decompress(framed(100, bomb, 19))
    with pytest.raises(guards.FormatError):
        c.decompress(framed(2 << 30, bomb))
    with pytest.raises(guards.FormatError):
        c.decompress(framed(100, Codec("zlib").compress(b"a" * 95)))
    with pytest.raises(guards.FormatError):
        c.decompress(framed(3, Codec("zlib").compress(b"abc"), 5, struct.pack(">I", 9)))
    with pytest.raises(guards.FormatError):
        c.decompress(framed(3, Codec("zlib").compress(b"abc"), 99, b"WRONG"))


def test_block_limit_may_be_lifted(monkeypatch):
    monkeypatch.setenv("BLOCKWRIGHT_MAX_BLOCK", "10")
    with pytest.raises(guards.OutputLimitError):
        guards.check_declared(11)
    monkeypatch.setenv("BLOCKWRIGHT_MAX_BLOCK", "0")
    guards.check_declared(1 << 40)


def test_dictionary_field():
    head = c.MAGIC + struct.pack(">BBIII", 3, 3, 1, 65536, (1 << 20) + 1)
    with pytest.raises(guards.FormatError):
        c.decompress(head)


def test_writers_refuse():
    with pytest.raises(ValueError):
        c.compress(TEXT, version=2, block_size=70000)
    with pytest.raises(ValueError):
        c.pack_header(c.Header(3, "zstd", guards.MAX_BLOCKS + 1, 1))
    with pytest.raises(ValueError):
        c.compress(TEXT, backend="brotli")
    with pytest.raises(ValueError):
        c.pack_frame(c.Frame(0, b"x" * 256, 0, b""), "zlib")


@pytest.mark.parametrize("backend", ["zstd", "zlib", "lzma"])
def test_streams(backend):
    made, back = io.BytesIO(), io.BytesIO()
    assert c.compress_stream(io.BytesIO(TEXT), made, 1000, backend) == -(-len(TEXT) // 1000)
    assert c.decompress_stream(io.BytesIO(made.getvalue()), back) == len(TEXT) and back.getvalue() == TEXT
    with pytest.raises(guards.TruncatedError):
        c.decompress_stream(io.BytesIO(made.getvalue()[:-1]), io.BytesIO())
    with pytest.raises(guards.FormatError, match="streaming"):
        c.decompress(made.getvalue())
    with pytest.raises(ValueError):
        c.compress_stream(io.BytesIO(TEXT), io.BytesIO(), 1000, "huffman")


def test_command_line(tmp_path, capsys):
    a, b, d = tmp_path / "a", tmp_path / "b", tmp_path / "d"
    a.write_bytes(TEXT)
    assert cli.main(["compress", str(a), str(b), "--level", "3"]) == 0
    assert cli.main(["decompress", str(b), str(d)]) == 0 and d.read_bytes() == TEXT
    assert cli.main(["report", str(b)]) == 0 and "zstd" in capsys.readouterr().out
    b.write_bytes(b"no container")
    assert cli.main(["decompress", str(b), str(d)]) == 1


def test_doctor(capsys):
    assert cli.main(["doctor"]) == 0 and "transform 19 RLE\tok" in capsys.readouterr().out


def test_version_1():
    for data in (b"", b"a", TEXT, bytes(range(256)) * 50, struct.pack("<1000I", *range(1000))):
        for size in (None, 2000):
            made = c.compress(data, block_size=size, backend="huffman", version=1)
            assert c.decompress(made) == data and made[:5] == b"RISA\x01"
    used = [f.tid for _, f in c.frames(io.BytesIO(c.compress(bytes(range(250)) * 8 + TEXT, block_size=2000, backend="huffman", version=1)))]
    assert used[0] == 1 and 5 in used
    # A block of two symbols, by hand
    counts = [0] * 256
    counts[97], counts[98] = 2, 1
    whole = b"RISA\x01" + struct.pack(">I", 1) + struct.pack(">BBHBB256HI", 0, 0, 3, 0, 5, *counts, 1) + bytes([0b11000000])
    assert c.decompress(whole) == b"aab"
    for bad in (whole[:-1], whole + b"x", whole[:9] + b"\x04" + whole[10:], whole[:5] + b"\xff" * 4 + whole[9:]):
        with pytest.raises(guards.BlockError):
            c.decompress(bad)
    with pytest.raises(ValueError):
        c.compress(TEXT, version=1)


def test_presets_and_choices():
    made = c.compress_v2(TEXT)
    assert made[4] == 2 and c.decompress(made) == TEXT
    assert sum(c.choices(made).values()) == -(-len(TEXT) // 4096)
    assert c.choices(c.compress(b"\0" * 5000, 1, 1000, "zlib")).keys() <= {t.name for t in kernels.REGISTRY.values()}

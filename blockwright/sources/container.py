"""The byte container: one object's header and frames, big-endian, versions 1 to 4, and streams of frames."""

from __future__ import annotations

import io
import lzma
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from typing import BinaryIO

from blockwright import guards
from blockwright.functions import codecs, kernels
from blockwright.operators.blocks import BLOCK_SIZE, adaptive_bytes
from blockwright.operators.dictionary import SAMPLE_BYTES, dictionary_for, shared
from blockwright.operators.frames import decode_frame
from blockwright.operators.search import Search, best, xored

# Fixed values of the format.
MAGIC = b"RISA"
STREAMING = 0xFFFFFFFF
#: Version 1's ids of transforms, and those of today.
FIRST_IDS = {0: 0, 1: 1, 2: 2, 3: 5}
FIRST_BLOCK = 4096


@dataclass
class Header:
    version: int
    backend: str
    num_blocks: int
    block_size: int
    dictionary: bytes = b""
    #: Byte after the header.
    end: int = 0


@dataclass
class Frame:
    tid: int
    extra: bytes
    orig_len: int
    payload: bytes
    padding: int = 0
    counts: list[int] | None = None


def pack_header(h: Header) -> bytes:
    if h.backend not in codecs.BACKENDS:
        raise ValueError(f"containers have no id for backend {h.backend!r}")
    if h.num_blocks != STREAMING and h.num_blocks > guards.MAX_BLOCKS:
        raise ValueError(f"{h.num_blocks} blocks; at most {guards.MAX_BLOCKS} can be read back")
    if h.version == 1:
        return MAGIC + struct.pack(">BI", 1, h.num_blocks)
    out = MAGIC + struct.pack(">BBII", h.version, codecs.BACKENDS[h.backend], h.num_blocks, h.block_size)
    if h.version == 3:
        out += struct.pack(">I", len(h.dictionary)) + h.dictionary
    elif h.version == 4:
        kept = lzma.compress(h.dictionary) if h.dictionary else b""
        out += struct.pack(">II", len(kept), len(h.dictionary)) + kept
    return out


def pack_frame(f: Frame, backend: str, version: int = 3) -> bytes:
    if len(f.extra) > 255:
        raise ValueError("the extra field is over 255 bytes")
    if version < 3 and f.orig_len > 65535:
        raise ValueError(f"version {version} holds blocks of at most 65535 bytes")
    if version == 1:
        tid = {v: k for k, v in FIRST_IDS.items()}[f.tid]
        extra = f.extra[2:]  # a primary index in 2 bytes
        return struct.pack(">BBHBB256HI", tid, 0, f.orig_len, len(extra), f.padding, *f.counts, len(f.payload)) + extra + f.payload
    head = struct.pack(">BB", f.tid, len(f.extra)) + struct.pack(">H" if version == 2 else ">I", f.orig_len)
    if backend == "huffman":
        head += struct.pack(">B256H", f.padding, *f.counts)
    return head + struct.pack(">I", len(f.payload)) + f.extra + f.payload


class Reader:
    """Exact reads from a file; an end in the middle is an error."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            got = self.file.read(min(n - len(out), 1 << 24))
            if not got:
                raise guards.TruncatedError(f"{n} bytes are due; {len(out)} are left")
            out += got
        return out

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def header(self) -> Header:
        if self.take(4) != MAGIC:
            raise guards.FormatError("no container: the first four bytes aren't the mark")
        (version,) = self.unpack(">B")
        if version not in (1, 2, 3, 4):
            raise guards.FormatError(f"version {version} is unknown")
        backend, num, size = self.unpack(">BII") if version > 1 else (codecs.BACKENDS["huffman"], *self.unpack(">I"), FIRST_BLOCK)
        if backend not in codecs.NAMES:
            raise guards.FormatError(f"backend {backend} is unknown")
        if version == 1 and num == STREAMING:
            raise guards.FormatError("version 1 has no streams")
        if num != STREAMING and num > guards.MAX_BLOCKS:
            raise guards.FormatError(f"{num} blocks are declared; the limit is {guards.MAX_BLOCKS}")
        dictionary, read = b"", 14 if version > 1 else 9
        if version == 3:
            (n,) = self.unpack(">I")
            guards.check_dictionary(n)
            dictionary = self.take(n)
            read += 4 + n
        elif version == 4:
            kept, n = self.unpack(">II")
            guards.check_dictionary(kept, None)
            guards.check_dictionary(n, None)
            raw = self.take(kept)
            dictionary = codecs.inflate("lzma", raw, n) if kept else b""
            guards.check_dictionary(len(dictionary), n)
            read += 8 + kept
        return Header(version, codecs.NAMES[backend], num, size, dictionary, read)

    def frame(self, h: Header) -> Frame | None:
        """The next frame; None at a clean end."""
        first = self.file.read(1)
        if not first:
            return None
        tid = first[0]
        if h.version == 1:
            _, orig_len, n_extra, padding, *counts, n = self.unpack(">BHBB256HI")
            if tid not in FIRST_IDS:
                raise guards.FormatError(f"transform {tid} is unknown in version 1")
            extra = self.take(n_extra)
            return Frame(FIRST_IDS[tid], extra, orig_len, self.take(n), padding, counts)
        (n_extra,) = self.unpack(">B")
        (orig_len,) = self.unpack(">H" if h.version == 2 else ">I")
        guards.check_declared(orig_len)
        padding, counts = 0, None
        if h.backend == "huffman":
            padding, *counts = self.unpack(">B256H")
        (n,) = self.unpack(">I")
        if tid != kernels.XOR_PREV and tid not in kernels.REGISTRY:
            raise guards.FormatError(f"transform {tid} is unknown")
        extra = self.take(n_extra)
        return Frame(tid, extra, orig_len, self.take(n), padding, counts)


def decode_one(h: Header, f: Frame, previous: bytes | None = None) -> bytes:
    return decode_frame(h.backend, f.tid, f.extra, f.orig_len, f.payload, None, f.counts, f.padding, h.dictionary if h.backend == "zstd" else b"", previous)


def frame_of(data: bytes, search: Search, previous: bytes | None = None) -> Frame:
    """The cheapest frame of a block. previous: the block before, if this one may be xored with it."""
    got = best(data, search)
    if previous and (other := xored(data, previous, search)).cost < got.cost:
        got = other
    padding, counts = 0, None
    if search.codec.backend == "huffman":
        h = codecs.Huffman.of(got.transformed)
        padding, counts = h.encode(got.transformed)[1], [int(c) for c in h.counts]
        if len(got.transformed) != len(data):  # the container has no place for the transformed length
            search = Search(search.codec, (0,), search.version)
            return frame_of(data, search)
    return Frame(got.tid, got.extra, len(data), got.payload, padding, counts)


def pack(data: bytes, search: Search, block_size: int | None = None, version: int = 3, xor_previous: bool = False, max_block: bool = False) -> bytes:
    """A container of one object, by a search and with its codec's dictionary.

    block_size: by default 64 KiB (4 KiB in version 1), and by the object's length in version 4 (see ``adaptive_bytes``).
    """
    if block_size is None:
        block_size = adaptive_bytes(len(data), max_block=max_block) if version >= 4 else BLOCK_SIZE if version > 1 else FIRST_BLOCK
    if block_size < 1 or version < 3 and block_size > 65535:
        raise ValueError(f"block size {block_size}")
    if version == 1:
        if search.codec.backend != "huffman":
            raise ValueError("version 1 holds Huffman codes only")
        search = replace(search, tids=tuple(t for t in FIRST_IDS.values() if t != 5 or block_size <= 2048))
    if xor_previous and version < 4:
        raise ValueError("only version 4 holds blocks that refer to the one before")
    parts = [data[i : i + block_size] for i in range(0, len(data), block_size)] or [b""]
    out = [pack_header(Header(version, search.codec.backend, len(parts), block_size, search.codec.dictionary))]
    for i, part in enumerate(parts):
        out.append(pack_frame(frame_of(part, search, parts[i - 1] if xor_previous and i else None), search.codec.backend, version))
    return b"".join(out)


def compress(data: bytes, level: int = 3, block_size: int | None = None, backend: str = "zstd", fast: bool = False, version: int = 3, dictionary: bytes = b"", use_dict: bool = False, force_dict: bool = False, two_pass: bool = False, max_block: bool = False, xor_previous: bool = False) -> bytes:
    """A container of one object.

    Dictionaries are for zstd, in versions 3 and 4: one that is given; or, with use_dict, one made of the object if it
    pays; with force_dict whether or not it pays.  two_pass (version 4) makes it of more of the object.  max_block and
    xor_previous: see ``pack``.
    """
    native = codecs.native_level(backend, level)
    if (use_dict or force_dict) and not dictionary:
        if backend != "zstd" or version < 3:
            raise ValueError("dictionaries are for zstd in versions 3 and 4")
        dictionary = dictionary_for(data, version, native, force_dict, two_pass)
    codec = codecs.Codec(backend, native, extreme=version >= 4 and backend == "lzma" and native == 9, dictionary=dictionary)
    return pack(data, Search(codec, version=version, fast=fast), block_size, version, xor_previous, max_block)


#: Version 2's usual form: Huffman codes of small blocks.
compress_v2 = partial(compress, backend="huffman", block_size=4096, version=2)


def choices(packed: bytes) -> Counter[str]:
    """How often each transform was chosen in a container."""
    names = {t.tid: t.name for t in kernels.REGISTRY.values()} | {kernels.XOR_PREV: "XOR_PREV"}
    return Counter(names[f.tid] for _, f in frames(io.BytesIO(packed)))


def frames(file: BinaryIO, max_total: int | None = None) -> Iterator[tuple[Header, Frame]]:
    """Header and each frame of a container or stream; what follows the last block is an error."""
    r = Reader(file)
    h = r.header()
    total = n = 0
    while h.num_blocks == STREAMING or n < h.num_blocks:
        f = r.frame(h)
        if f is None:
            if h.num_blocks == STREAMING:
                return
            raise guards.TruncatedError(f"{h.num_blocks} blocks are declared; {n} are there")
        total, n = total + f.orig_len, n + 1
        guards.check_total(total, max_total)
        yield h, f
    if file.read(1):
        raise guards.FormatError("bytes follow the last block")


def blocks(file: BinaryIO, max_total: int | None = None) -> Iterator[bytes]:
    previous = None
    for h, f in frames(file, max_total):
        previous = decode_one(h, f, previous)
        yield previous


def decompress(data: bytes, max_output_size: int | None = None) -> bytes:
    """The object of a container of version 1 to 4. A stream's container is for ``blocks``."""
    if Reader(io.BytesIO(data)).header().num_blocks == STREAMING:
        raise guards.FormatError("this is a streaming container; read it as a stream")
    return b"".join(blocks(io.BytesIO(data), max_output_size))


def compress_stream(source: BinaryIO, sink: BinaryIO, block_size: int = BLOCK_SIZE, backend: str = "zstd", level: int | None = None, fast: bool = False, use_dict: bool = False) -> int:
    """Frames after a header without a block count; holds one block. Gives the number of blocks.

    use_dict (zstd): the first million bytes are held and a dictionary is trained on them; blocks are cut as without.
    """
    if backend == "huffman":
        raise ValueError("streams don't take huffman")
    if use_dict and backend != "zstd":
        raise ValueError("dictionaries are for zstd")
    ahead = b""
    while use_dict and len(ahead) < SAMPLE_BYTES and (got := source.read(SAMPLE_BYTES - len(ahead))):
        ahead += got
    codec = codecs.Codec(backend, codecs.DEFAULT_LEVEL[backend] if level is None else level, dictionary=shared(ahead) if use_dict else b"")
    sink.write(pack_header(Header(3, backend, STREAMING, block_size, codec.dictionary)))
    at = n = 0
    while True:
        data = ahead[at : at + block_size]
        at += len(data)
        while len(data) < block_size and (got := source.read(block_size - len(data))):
            data += got
        if not data:
            return n
        sink.write(pack_frame(frame_of(data, Search(codec, fast=fast)), backend))
        n += 1


def decompress_stream(source: BinaryIO, sink: BinaryIO, max_output_size: int | None = None) -> int:
    n = 0
    for data in blocks(source, max_output_size):
        sink.write(data)
        n += len(data)
    return n

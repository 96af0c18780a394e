"""The whole-buffer API, and the same for columns of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.functions.codecs import Codec, native_level
from blockwright.operators import dictionary as dictionaries
from blockwright.operators.blocks import BLOCK_SIZE, adaptive_size, reassemble, to_blocks
from blockwright.operators.frames import decode_frames
from blockwright.operators.search import Search, encode_blocks
from blockwright.operators.stats import objects_of
from blockwright.sources.arrow import BlockCodec, packed, unpacked
from blockwright.sources.container import choices, compress, compress_stream, compress_v2, decompress, decompress_stream

__all__ = ["BlockCodec", "choices", "compress", "compress_stream", "compress_v2", "decode", "decompress", "decompress_stream", "encode", "packed", "shared_dictionary", "unpacked"]


def encode(df: DataFrame, id_col: str, data_col: str, backend: str = "zstd", level: int = 3, block_size: int | None = None, fast: bool = False, version: int = 3, xor_previous: bool = False, dictionary: bytes = b"", max_block: bool = False) -> DataFrame:
    """Frames of a binary or string column. block_size: by default 64 KiB, in version 4 by each object's length."""
    search = Search(Codec(backend, native_level(backend, level), dictionary=dictionary), version=version, fast=fast)
    size = block_size or (adaptive_size(F.length("data"), max_block=max_block) if version >= 4 else BLOCK_SIZE)
    return encode_blocks(to_blocks(objects_of(df, id_col, data_col), size), search, xor_previous)


def decode(frames: DataFrame, backend: str = "zstd", max_total: int | None = None, dictionary: bytes = b"", linked: bool = True) -> DataFrame:
    """(object_id, data) of frames. linked: some may refer to the block before."""
    return reassemble(decode_frames(frames, backend, dictionary, max_total=max_total, linked=linked))


def shared_dictionary(df: DataFrame, id_col: str, data_col: str, level: int = 3, block_size: int = BLOCK_SIZE) -> bytes:
    """A zstd dictionary for all objects of a column, trained on a sample of about a million bytes; empty where it doesn't pay.

    It is priced on a quarter of the sample that it isn't trained on.  Blocks of the whole table share it, so its own
    size doesn't count against it.
    """
    pieces = dictionaries.sample(to_blocks(objects_of(df, id_col, data_col), min(block_size, dictionaries.PIECE)))
    made = dictionaries.train([p for i, p in enumerate(pieces) if i % 4])
    without, with_it, _ = dictionaries.gate(pieces[::4], made, native_level("zstd", level), block_size)
    return made if made and with_it - len(made) - 4 < without else b""

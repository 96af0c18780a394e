"""The whole-buffer API for Arrow buffers and for binary columns."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockwright.sources import container


class BlockCodec:
    """Of the shape of ``pyarrow.Codec``: buffers or bytes in, buffers (or bytes) out. Arrow takes no codecs written in Python."""

    name = "blockwright"

    def __init__(self, level: int = 3, block_size: int = 65536) -> None:
        self.compression_level, self.block_size = level, block_size

    @staticmethod
    def is_available() -> bool:
        return True

    def compress(self, buf, asbytes: bool = False) -> pa.Buffer | bytes:
        out = container.compress(bytes(memoryview(buf)), self.compression_level, self.block_size)
        return out if asbytes else pa.py_buffer(out)

    def decompress(self, buf, decompressed_size: int | None = None, asbytes: bool = False) -> pa.Buffer | bytes:
        """decompressed_size: an upper limit that the declared sizes are checked against."""
        out = container.decompress(bytes(memoryview(buf)), decompressed_size)
        return out if asbytes else pa.py_buffer(out)


def packed(data: Column, level: int = 3, block_size: int = 65536, backend: str = "zstd") -> Column:
    """Containers of a binary column's values; null stays null."""

    @F.pandas_udf("binary")
    def f(values: pd.Series) -> pd.Series:
        return values.map(lambda v: container.compress(bytes(v), level, block_size, backend), na_action="ignore")

    return f(data)


def unpacked(data: Column, max_output_size: int | None = None) -> Column:
    """The values that ``packed`` made; null stays null."""

    @F.pandas_udf("binary")
    def f(values: pd.Series) -> pd.Series:
        return values.map(lambda v: container.decompress(bytes(v), max_output_size), na_action="ignore")

    return f(data)

"""Structured Streaming: blocks of a stream to frames, micro-batch by micro-batch, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from blockwright.operators.blocks import to_blocks
from blockwright.operators.frames import decode_frames
from blockwright.operators.search import Search, encode_blocks


def write_stream(objects: DataFrame, path: str, checkpoint: str, search: Search = Search(), block_size: int = 65536, **trigger: object) -> StreamingQuery:
    """Frames of a stream of (object_id, data), appended to Parquet exactly once.

    Each row is an object, and its blocks are encoded on their own, so no state crosses micro-batches.
    """
    frames = encode_blocks(to_blocks(objects, block_size), search)
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def read_blocks(spark, path: str, search: Search = Search()) -> DataFrame:
    """Blocks of the frames that a stream has written."""
    return decode_frames(spark.read.parquet(path), search.codec.backend, search.codec.dictionary, linked=False)

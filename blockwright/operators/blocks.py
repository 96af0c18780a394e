"""Objects to blocks and back; tables' columns to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_SIZE = 65536


def to_blocks(objects: DataFrame, block_size: int | Column = BLOCK_SIZE, id_col: str = "object_id", data_col: str = "data") -> DataFrame:
    """(object_id, block_no, orig_len, data): consecutive slices, the last one shorter; an empty or null object is one empty block."""
    size = block_size if isinstance(block_size, Column) else F.lit(int(block_size))
    data = F.coalesce(F.col(data_col).cast("binary"), F.lit("").cast("binary"))
    last = F.greatest(F.ceil(F.length(data) / size).cast("int") - 1, F.lit(0))
    cut = objects.select(F.col(id_col).alias("object_id"), data.alias("whole"), size.cast("int").alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("block_no"))
    block = F.substring(F.col("whole"), F.col("block_no") * F.col("size") + 1, F.col("size"))
    return cut.select("object_id", "block_no", F.length(block).alias("orig_len"), block.alias("data"))


def adaptive_bytes(n: int, block_size: int = 1 << 20, max_block: bool = False) -> int:
    """``adaptive_size`` of one object of n bytes."""
    return max(n, 1) if n <= (15 << 20 if max_block else 4 << 20) else block_size


def adaptive_size(length: Column, block_size: int = 1 << 20, one_block_below: int = 4 << 20, max_block: bool = False) -> Column:
    """Block size by object length: small objects are one block; with max_block, those of up to 15 MiB."""
    limit = 15 << 20 if max_block else one_block_below
    return F.when(length <= limit, F.greatest(length, F.lit(1))).otherwise(F.lit(block_size))


def reassemble(blocks: DataFrame) -> DataFrame:
    """(object_id, data): the blocks of each object in order, joined; an object must fit a binary value (2 GiB)."""
    return blocks.groupBy("object_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY block_no)").alias("data"))


def pack_integers(value: Column, width: int) -> Column:
    """Little-endian bytes of a whole number, as hexadecimal."""
    planes = [F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(width)]
    return F.concat(*planes)


def pack_column(df: DataFrame, value: Column, order: list[str], group: Column, width: int) -> DataFrame:
    """(object_id, data): the values of each group, in order, as little-endian integers of ``width`` bytes."""
    rows = df.select(group.alias("object_id"), F.struct(*order, pack_integers(value, width).alias("hex")).alias("x"))
    return rows.groupBy("object_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["hex"]), "")).alias("data"))


def csv_objects(df: DataFrame, columns: list[str], order: list[str], group: Column) -> DataFrame:
    """(object_id, data): each group's rows as lines of comma-separated values, in order; nulls are empty, nothing is quoted."""
    line = F.concat(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit("\n"))
    rows = df.select(group.alias("object_id"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")).alias("x"))
    return rows.groupBy("object_id").agg(F.expr("listagg(x.line) WITHIN GROUP (ORDER BY x)").cast("binary").alias("data"))

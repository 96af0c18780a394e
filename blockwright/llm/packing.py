"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

A bin is filled greedily (each time the longest piece that fits); if it isn't full, its smallest
piece is replaced by two unpacked pieces that fit the gap so made more tightly.  What the method does
depends on lengths alone, and there are at most ``capacity`` different lengths.  So it runs on the
counts of lengths: a pattern is applied as often as the counts allow, which gives the bins that
piece-by-piece packing would.  Pieces then take their places by their rank among the pieces of their
length: ranks are counted in salted groups of bounded size, and no task sees more than one group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwright.llm import text as tx
from blockwright.llm import tokens as tk
from blockwright.llm.spark import dropped, per_block, stored, table

CAPACITY = 4096
END = 1
#: Pieces of one length whose ranks one group counts, about; more where there would be more than MOST_GROUPS of them.
GROUP, MOST_GROUPS = 1000, 20_000


@dataclass
class Patterns:
    """Bins of equal content, and for each length where its pieces go, by rank."""

    bins: list[tuple[int, list[tuple[int, int]]]]  # (times, [(length, pieces of it)])

    def places(self) -> tuple[np.ndarray, ...]:
        """Sorted (length << 40 | first rank), first sequence, pieces of the length in a bin, first offset."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for times, content in self.bins:
            offset = 0
            for length, n in content:
                rows.append((length << 40 | used.get(length, 0), sequence, n, offset))
                used[length] = used.get(length, 0) + times * n
                offset += length * n
            sequence += times
        rows.sort()
        return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack_counts(counts: np.ndarray, capacity: int, most: int | None = None) -> Patterns:
    """Best-two-fit over counts[length], lengths 1 to capacity. most: how often a pattern is applied at once, at most."""
    left = counts.astype(np.int64).copy()
    places = np.arange(capacity + 1)
    bins = []
    while left.any():
        need: dict[int, int] = {}
        free = capacity
        while free:
            fits = np.flatnonzero(left[: free + 1])
            length = next((int(x) for x in fits[::-1] if left[x] > need.get(int(x), 0)), 0)
            if not length:
                break
            n = int(min(left[length] - need.get(length, 0), free // length))
            need[length] = need.get(length, 0) + n
            free -= n * length
        greedy = dict(need)
        if free and need:
            smallest = min(need)
            rest = left.copy()
            for length, n in need.items():
                rest[length] -= n
            gap = free + smallest
            below = np.maximum.accumulate(np.where(rest > 0, places, 0))  # the longest unpacked length up to each
            first = np.flatnonzero(rest[:gap])
            if len(first):
                second = below[np.minimum(gap - first, first)]
                lone = (second == first) & (rest[first] < 2)
                second = np.where(lone, below[np.maximum(first - 1, 0)], second)
                total = np.where(second > 0, first + second, 0)
                k = len(total) - 1 - int(total[::-1].argmax())
                if total[k] > smallest:
                    need[smallest] -= 1
                    for x in (int(first[k]), int(second[k])):
                        need[x] = need.get(x, 0) + 1
        need = {k: v for k, v in need.items() if v}
        # as long as the counts give the same greedy filling and the same replacement
        times = min(int(left[k]) // v for part in (greedy, need) for k, v in part.items())
        times = min(times, most or times)
        for k, v in need.items():
            left[k] -= times * v
        bins.append((times, sorted(need.items(), reverse=True)))
    return Patterns(bins)


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    return [(s, min(capacity, len(ids) - s)) for s in range(0, len(ids), capacity)]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of each text's ids and the end id; a null text is empty: the end id alone."""

    def work(batch: pa.RecordBatch):
        bpe = tk.word_bpe(path)
        for lo, hi, data, off in tx.blocks(batch.column(1)):
            ids, id_off = bpe.encode(data, off)
            keys = batch.column(0)[lo:hi].cast(pa.int64()).to_pylist()
            rows = []
            for i, key in enumerate(keys):
                own = np.append(ids[id_off[i] : id_off[i + 1]], np.uint32(END))
                rows += [(key, k, s, n, tk.crc32_ids(own[s : s + n]), own[s : s + n].astype(np.int32) if with_ids else None) for k, (s, n) in enumerate(cut(own, capacity))]
            cols = list(zip(*rows, strict=True))
            out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(cols[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return per_block(df.select(id_col, text_col), work, PIECES + (", ids array<int>" if with_ids else ""))


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length, ...; lengths 1 to capacity; stored) with sequence_id and offset, stored; rows is dropped."""
    spark = rows.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(pack_counts(counts, capacity).places())
    size = max(GROUP, -(-int(counts.sum()) // MOST_GROUPS))
    groups = F.element_at(F.lit(np.maximum(-(-counts // size), 1)), F.col("length").cast("int") + 1) if counts.max() > size else F.lit(1)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), groups).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    ranked = salted.withColumn("k", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    wanted = rows.columns
    ranked = ranked.select(*wanted, "rank")
    at, by = wanted.index("length"), len(wanted)

    def work(batch: pa.RecordBatch):
        key, first, n, offset = shared.value
        length, rank = batch.column(at).to_numpy(), batch.column(by).to_numpy()
        k = np.searchsorted(key, length << 40 | rank, "right") - 1
        over = rank - (key[k] & ((1 << 40) - 1))
        out = [batch.column(i) for i in range(by)]
        yield pa.RecordBatch.from_arrays([*out, pa.array(first[k] + over // n[k]), pa.array(offset[k] + over % n[k] * length)], names=[*wanted, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = stored(per_block(ranked, work, schema + ", sequence_id bigint, offset bigint"))
    dropped(rows)
    return out


def pack(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Packs all rows; one row per piece.

    Null texts are empty, and an empty text is one piece of one id.  Rows with null or repeated ids are
    documents of their own.  An empty table gives no rows.  Other columns are not read.
    """
    return place(stored(pieces(df, path or tk.tokenizer_path("word_bpe_49k.json"), id_col, text_col, capacity)), capacity)


def sequences(df: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, at most ``capacity`` ids each."""
    placed = place(stored(pieces(df, path or tk.tokenizer_path("word_bpe_49k.json"), capacity=capacity, with_ids=True)), capacity)
    got = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return got.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

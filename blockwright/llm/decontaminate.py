"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item of n distinct shingles is in a document if that holds at least ``least`` of them, in any
places.  Items are partitioned by n; the items of a partition have MinHash sketches of one size: the
shingles of the smallest values under a hash weighted by rarity, so that those which many items share
are seldom among them.  A document that holds ceil(least n) of an item's n shingles lacks at most
n - ceil(least n), so it holds one of any n - ceil(least n) + 1 of them: a partition's sketches are
that long for its largest item.  A document that holds a shingle of an item's sketch is a candidate
for it, and candidates are verified by counting all of the item's distinct shingles in the whole
document.  So nothing is missed, however often an item repeats itself and wherever its shingles
stand.  (Estimates of containment from sketches of long documents would miss: short items are a tiny
part of them.)

The sketches and shingles of all items are built once, on the driver, in parts of bounded size that
are broadcast; tasks go over the documents once, whatever the number of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import text as tx
from blockwright.llm.spark import per_block, table

SHINGLE = 5
CONTAINMENT = 0.8
#: Most bytes of item texts in a part; a part's arrays take about five times as much.
ITEM_BYTES = 8 << 20
#: Bytes of parts that a worker holds; further ones are loaded anew for each batch.
_HELD = 256 << 20
#: Bytes of text that a part goes over at a time.
_GROUP = 8 << 20
#: Partitions for each doubling of the number of an item's shingles.
_STEPS = 4

#: Shingles of candidates that are counted at once.
_COUNTED = 1 << 20


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] of them) for each i."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Items of one shingle length, listed under the shingles of their sketches."""

    def __init__(self, k: int, keys: list, sets: list[np.ndarray], least: float) -> None:
        self.k, self.keys = k, keys
        self.size = np.array([len(x) for x in sets])
        self.need = np.maximum(1, np.ceil(least * self.size)).astype(np.int64)
        values, own, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.lookup, self.off, self.own = tx.Lookup(values), np.append(0, np.cumsum(self.size)), own.astype(np.int32)
        who = np.repeat(np.arange(len(sets)), self.size)
        # a shingle that m items have is drawn at the rate 1 / m^2
        drawn = -np.log1p(-(tx.mix(values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53) * many.astype(float) ** 2
        order = np.lexsort((own, drawn[own], who))
        listed = order[np.arange(len(who)) - self.off[who] < self.sketch_sizes()[who]]
        listed = listed[np.argsort(own[listed], kind="stable")]
        self.items, self.first = who[listed].astype(np.int32), np.searchsorted(own[listed], np.arange(len(values) + 1)).astype(np.int32)

    def sketch_sizes(self) -> np.ndarray:
        """For each item the length of its partition's sketches: what the partition's largest item needs."""
        part = np.floor(_STEPS * np.log2(self.size)).astype(np.int64)
        longest = np.zeros(part.max() + 1, np.int64)
        np.maximum.at(longest, part, self.size - self.need + 1)
        return longest[part]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.lookup.keys, self.lookup.slots, self.off, self.own, self.items, self.first, self.size, self.need))

    def found(self, s: np.ndarray, off: np.ndarray):
        """Documents, items and numbers of shingles in common, for the pairs that have as many as they need; in order."""
        got = self.lookup(s)
        at = np.flatnonzero(got >= 0)
        wide = len(self.lookup.keys)
        held = np.unique((np.searchsorted(off, at, "right") - 1) * wide + got[at])
        doc, place = np.divmod(held, wide)
        n = self.first[place + 1] - self.first[place]
        pairs = np.unique(np.repeat(doc, n) * len(self.keys) + self.items[_spread(self.first[place], n)])
        doc, item = np.divmod(pairs, len(self.keys))
        part = np.cumsum(self.size[item]) // _COUNTED
        common = np.zeros(len(pairs), np.int64)
        for rows in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(part)) + 1):
            n = self.size[item[rows]]
            want = np.repeat(doc[rows], n) * wide + self.own[_spread(self.off[item[rows]], n)]
            at = np.minimum(np.searchsorted(held, want), len(held) - 1)
            common[rows] = tx.sums(held[at] == want, np.append(0, np.cumsum(n)))
        ok = common >= self.need[item]
        return doc[ok], item[ok], common[ok]


def build(ids: list, texts: pa.Array, least: float) -> list[Index]:
    data, off = tx.buffers(texts)
    words = tx.Words(data[off[0] : off[-1]], off - off[0])
    n = words.counts()
    out = []
    for k in sorted({min(SHINGLE, int(x)) for x in n if x}):
        which = np.flatnonzero(n >= k if k == SHINGLE else n == k)
        s, s_off = tx.shingles(words.hash, words.off, k)
        sets = [np.unique(s[s_off[i] : s_off[i + 1]]) for i in which]
        out.append(Index(k, [ids[i] for i in which], sets, least))
    return out


class Items:
    """Broadcast indexes of all items, in parts."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, least: float) -> None:
        rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
        size = rows.agg(F.coalesce(F.sum(F.length(F.col("text").cast("binary"))), F.lit(0)).alias("n")).first()["n"]
        n = max(1, -(-size // ITEM_BYTES))
        self.parts = []
        for i in range(n):
            block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
            got = block.orderBy("item_id", "text").toArrow()
            texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
            self.parts.append(items.sparkSession.sparkContext.broadcast(build(got.column("item_id").to_pylist(), texts, least)))

    def hits(self, column: pa.Array):
        """(first row, last row + 1, [(document, item id, shingles in common, of the item)]) of blocks of a text column.

        With several parts, each goes over a group of blocks at a time.
        """
        group, size = [], 0
        for lo, hi, data, off in tx.blocks(column):
            group.append((lo, hi, tx.Words(data, off), {}, []))
            size += len(data)
            if len(self.parts) == 1 or size > _GROUP:
                yield from self._search(group)
                group, size = [], 0
        yield from self._search(group)

    def _search(self, group: list):
        room = _HELD
        for part in self.parts if group else []:
            indexes = part.value
            for _, _, words, made, rows in group:
                for index in indexes:
                    if index.k not in made:
                        made[index.k] = tx.shingles(words.hash, words.off, index.k)
                    rows += _matches(index, words, *made[index.k])
            room -= sum(x.nbytes() for x in indexes)
            if room < 0:
                vars(part).pop("_value", None)
        for lo, hi, _, _, rows in group:
            yield lo, hi, rows


def _matches(index: Index, words: tx.Words, s: np.ndarray, s_off: np.ndarray) -> list[tuple]:
    if not len(s):
        return []
    short = np.diff(words.off) < index.k  # a text of fewer words than the item has none of its shingles
    return [(doc, index.keys[item], common, int(index.size[item])) for doc, item, common in zip(*(x.tolist() for x in index.found(s, s_off)), strict=True) if not short[doc]]


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """One row for each document and item with at least ``least`` of the item's distinct shingles in the document.

    An item of 1 to 4 words is one shingle of its own length.  Items and documents that are null or without
    words match nothing.  Repeated rows of either side give repeated rows.  Empty tables give none.  Only the
    named columns are read.
    """
    shared = Items(items, item_id_col, item_text_col, least)
    names = ["doc_id", "item_id", "n_common", "n_item", "containment"]

    def work(batch: pa.RecordBatch):
        for lo, _, rows in shared.hits(batch.column(1)):
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + r[0] for r in rows])).cast(pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)), pa.array([r[2] / r[3] for r in rows], pa.float64())], names=names)

    return per_block(docs.select(id_col, text_col), work, "doc_id bigint, item_id bigint, n_common bigint, n_item bigint, containment double")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """The rows (all columns) of docs that contain no item; null texts and texts without words contain none."""
    at = docs.columns.index(text_col)
    shared = Items(items, "item_id", "text", least)

    def work(batch: pa.RecordBatch):
        for lo, hi, rows in shared.hits(batch.column(at)):
            keep = np.ones(hi - lo, bool)
            keep[[r[0] for r in rows]] = False
            yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return per_block(docs, work, docs.schema)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All pairs of shingles that are equal, counted.
ORACLE = f"""
WITH t AS (SELECT item_id, row_number() OVER () AS own, {tx.WORDS_SQL} AS k FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT own, item_id, size, k[at_word : at_word + size - 1] AS s FROM (SELECT own, item_id, k, least({SHINGLE}, len(k)) AS size, unnest(generate_series(1, len(k) - least({SHINGLE}, len(k)) + 1)) AS at_word FROM t WHERE len(k) > 0)),
n AS (SELECT own, item_id, size, count(DISTINCT s) AS n_item FROM i GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS row, {tx.WORDS_SQL} AS k FROM documents),
g AS (SELECT DISTINCT doc_id, row, size, k[at_word : at_word + size - 1] AS s FROM (SELECT doc_id, row, k, size, unnest(generate_series(1, len(k) - size + 1)) AS at_word FROM d, (SELECT DISTINCT size FROM n) WHERE len(k) >= size)),
c AS (SELECT doc_id, row, own, count(DISTINCT s) AS n_common FROM g JOIN (SELECT DISTINCT own, size, s FROM i) USING (size, s) GROUP BY ALL)
SELECT doc_id, item_id, n_common, n_item, n_common / n_item::DOUBLE AS containment FROM c JOIN n USING (own) WHERE n_common >= ceil({CONTAINMENT}::DOUBLE * n_item)
"""

"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Document frequencies of common shingles: a count sketch of all shingles leaves those that may be
   in at least SHARE of the documents, and these are counted exactly.  There are at most
   (mean distinct shingles of a document) / SHARE of them, so that table may be broadcast.
2. Texts with the same words are one node; the smallest id stands for it.
3. Each node's weights (1 + ln of occurrences, times IDF) give K consistent weighted samples; bands of R samples
   are bucket keys.  P(no common band) at similarity 0.8 is 0.00004.
4. In each bucket, the smallest node is compared with all others, and components of the links found are
   computed.  Where the others still are of several components, those outside the largest are compared
   with all of other components, in blocks of bounded size that give links between components, never
   pairs.  So every two nodes of a bucket are either compared or already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwright.llm import text as tx
from blockwright.llm.spark import dropped, per_block, stored, table

SHINGLE = 5
SIMILARITY = 0.8
#: Sums in another order must not decide on equality with the threshold.
TIE = 1e-9
BANDS, R = 14, 3
#: Shingles in a smaller share of the documents all get the largest IDF.
SHARE = 0.001
#: IDF goes from 1 (in all documents) to 1 + SLOPE: near copies of a text that a third of all rows
#: hold must stay similar although the shingles they share are common and those they don't are rare.
SLOPE = 0.25
#: Cells of the sketch at first, and at most, as powers of two; and cells that one task merges.
CELLS_LOG2, MOST_CELLS_LOG2 = 20, 26
RANGE = 4096
#: Followers of a representative that one task takes, about, and most representatives whose followers are dealt to several.
HOT, MOST_HOT = 2048, 10_000
#: Most ids of rows that go (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_ODD = tx.mix(np.arange(101, 101 + BANDS * R, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _gamma2(n: int = 1024) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution."""
    x = np.linspace(0, 30, 600_001)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


_GAMMA = _gamma2()
_LOG_GAMMA = np.log(_GAMMA) + np.float32(64)  # so that all sampled values are positive


#: Shingles are told apart by 44 bits; the rest of a 64-bit key is the place of their text in a block.
HASH_BITS = np.uint64(44)
_MASK = np.uint64((1 << 44) - 1)


def damped(count: np.ndarray) -> np.ndarray:
    """Term frequency of a shingle: 1 + ln(occurrences), so that a line that comes fifty times doesn't drown the rest."""
    return 1 + np.log(count)


class Bag:
    """Distinct shingles of each text of a block, sorted by hash, with their counts."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.words = tx.Words(data, off)
        s, s_off = tx.shingles(self.words.hash, self.words.off, SHINGLE)
        n = len(off) - 1
        keys = np.repeat(np.arange(n, dtype=np.uint64) << HASH_BITS, np.diff(s_off)) | (s >> np.uint64(20))
        keys.sort()
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.key = keys[at]
        self.hash, self.owner = self.key & _MASK, (self.key >> HASH_BITS).astype(np.int64)
        self.count = np.diff(np.append(at, len(keys)))
        self.off = np.searchsorted(self.owner, np.arange(n + 1))

    def similarities(self, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarities of pairs of texts; weight: IDF of each shingle of the bag."""
        size, total = np.diff(self.off), tx.sums(damped(self.count) * weight, self.off)
        i, j = np.where(size[i] < size[j], j, i), np.where(size[i] < size[j], i, j)
        n = size[j]
        before = np.cumsum(n) - n
        own = np.arange(int(n.sum())) - np.repeat(before, n) + np.repeat(self.off[j], n)
        want = np.repeat(i.astype(np.uint64) << HASH_BITS, n) | self.hash[own]
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        common = np.where(self.key[at] == want, damped(np.minimum(self.count[own], self.count[at])) * weight[own], 0.0)
        low = tx.sums(common, np.append(before, len(own)))
        union = total[i] + total[j] - low
        return np.where(union > 0, low / np.where(union > 0, union, 1), 1.0)

    def all_similar(self, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Whether each text of rows is similar enough to each of cols: products of incidence matrices, in slices of shingles.

        The k-th occurrence of a shingle is a column of its own, with what it adds to the damped count, so that
        products sum the smaller of two weights.
        """
        owner = np.repeat(self.owner, self.count)
        first = np.repeat(np.cumsum(self.count) - self.count, self.count)
        k = np.arange(len(owner)) - first
        feature = np.repeat(self.hash, self.count) << np.uint64(20) | np.minimum(k, (1 << 20) - 1).astype(np.uint64)
        value = np.repeat(weight, self.count) * np.where(k > 0, np.log((k + 1) / np.maximum(k, 1)), 1.0)
        total = np.bincount(owner, value, len(self.off) - 1)
        _, column, times = np.unique(feature, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, value = owner[shared], value[shared]
        _, column = np.unique(column[shared], return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, value, column = owner[order], value[order], column[order]
        low = np.zeros((len(rows), len(cols)))
        width = 512
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            m = np.zeros((len(self.off) - 1, width))
            m[owner[a:b], column[a:b] - lo] = 1
            scale = np.zeros(width)
            scale[column[a:b] - lo] = value[a:b]
            low += (m[rows] * scale) @ m[cols].T
        union = total[rows][:, None] + total[cols][None, :] - low
        return low >= (SIMILARITY - TIE) * union


class Idf:
    """IDF of shingles from the counts of the common ones."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int) -> None:
        self.lookup = tx.Lookup(keys)
        self.values = np.append(self.of(df, n_docs), self.of(np.ones(1), n_docs))

    @staticmethod
    def of(df: np.ndarray, n_docs: int) -> np.ndarray:
        share = np.clip(np.asarray(df, np.float64) / max(n_docs, 1), SHARE, 1)
        return (1 + SLOPE * np.log(share) / np.log(SHARE)).astype(np.float32)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return self.values[self.lookup(s)]


def samples(bag: Bag, weight: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The j-th consistent weighted sample of each text with shingles: (place in the bag, level)."""
    x = (((bag.hash << np.uint64(20)) * _ODD[j]) >> np.uint64(32)).astype(np.uint32)
    r = _GAMMA[x & np.uint32(1023)]
    beta = (x >> np.uint32(20)).astype(np.float32) * np.float32(1 / 4096)
    level = np.floor(weight / r + beta)
    value = _LOG_GAMMA[(x >> np.uint32(10)) & np.uint32(1023)] - r * (level - beta) - r
    key = value.view(np.uint32).astype(np.uint64) << np.uint64(32)
    key |= np.arange(len(key), dtype=np.uint64)
    starts = bag.off[:-1][np.diff(bag.off) > 0]
    return (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64), level


def band_keys(bag: Bag, idf: Idf) -> np.ndarray:
    """(texts, BANDS) bucket keys; rows of texts without shingles are 0."""
    out = np.zeros((len(bag.off) - 1, BANDS), np.uint64)
    full = np.diff(bag.off) > 0
    if not full.any():
        return out
    weight = np.log(damped(bag.count) * idf(bag.hash)).astype(np.float32)
    for b in range(BANDS):
        key = np.full(int(full.sum()), b + 1, np.uint64)
        for j in range(b * R, (b + 1) * R):
            at, level = samples(bag, weight, j)
            key = tx.mix(key + (bag.hash[at] ^ level[at].astype(np.int64).view(np.uint64)))
        out[full, b] = key
    return out


def _cells(docs: DataFrame, bits: int, least: int) -> tuple[np.ndarray, int]:
    """Which of 2^bits cells of a count sketch of all documents' distinct shingles hold at least ``least``, and how many there are in all.

    A task holds 2^bits counts, and merges those of RANGE cells.
    """
    cells, shift = 1 << bits, np.uint64(44 - bits)
    ranges = cells // RANGE

    def sketch(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, data, off in tx.blocks(batch.column(0)):
                total += np.bincount((Bag(data, off).hash >> shift).astype(np.int64), minlength=cells)
        rows = []
        for k in range(ranges):
            part = total[k * RANGE : (k + 1) * RANGE]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((k, at.astype(np.uint16).tobytes(), part[at].astype(np.uint32).tobytes()))
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 64], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "cell", "n"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cell, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(k, np.zeros(RANGE, np.int64))[np.frombuffer(cell, np.uint16)] += np.frombuffer(n, np.uint32)
        for k, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(total.sum())]), pa.array([(np.flatnonzero(total >= least) + k * RANGE).astype(np.int32)], pa.list_(pa.int32()))], names=["n", "cells"])

    parts = docs.select("text").mapInArrow(sketch, "part int, cell binary, n binary").repartition("part")
    got = parts.mapInArrow(merge, "n bigint, cells array<int>").toArrow()  # a row for each range; at most one in SHARE cells and texts is full
    may = np.zeros(cells, bool)
    for full in got.column("cells").to_pylist():
        may[full] = True
    return may, sum(got.column("n").to_pylist())


def _common(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least SHARE (and two) of the documents, with exact document frequencies."""
    least = max(2, int(np.ceil(SHARE * n_docs)))
    bits = CELLS_LOG2
    may, total = _cells(docs, bits, least)
    need = int(2 * total / least).bit_length()  # long texts: rare shingles together must not fill a cell
    if total and bits < need:
        bits = min(need, MOST_CELLS_LOG2)
        may, total = _cells(docs, bits, least)
    shift, texts = np.uint64(44 - bits), docs.select("text")
    shared = docs.sparkSession.sparkContext.broadcast(may)

    def count(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "df"])

        for batch in batches:
            for _, _, data, off in tx.blocks(batch.column(0)):
                s = Bag(data, off).hash
                held.append(s[shared.value[(s >> shift).astype(np.int64)]])
                size += len(held[-1])
                if size > 1 << 21:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    got = texts.mapInArrow(count, "key bigint, df bigint").groupBy("key").agg(F.sum("df").alias("df")).filter(F.col("df") >= least).toPandas()
    return got["key"].to_numpy(np.int64).view(np.uint64), got["df"].to_numpy(np.int64)


def _signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, the two halves of a digest of the text's words, band keys); texts without words are told apart by their bytes and have no band."""

    def work(batch: pa.RecordBatch):
        for lo, hi, data, off in tx.blocks(batch.column(1)):
            bag = Bag(data, off)
            bands = band_keys(bag, idf.value)
            n_words = bag.words.counts()
            same = bag.words.digests(data, off)
            kept = [row if n else [] for row, n in zip(bands.view(np.int64), n_words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(n_words, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "size", "bands"])

    return per_block(docs.select("doc_id", "text"), work, "doc_id bigint, h1 bigint, h2 bigint, size bigint, bands array<bigint>")


def _mixed(signed: DataFrame) -> DataFrame:
    """(doc_id, mixed): whether an id's rows have different words."""
    return signed.groupBy("doc_id").agg(((F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))).alias("mixed"))


#: Pairs that are verified at once, about; and texts, in bytes.
_PAIRS, _BYTES = 4096, 4 << 20


def _bag(texts: list[str]) -> Bag:
    data, off = tx.buffers(pa.array(texts, pa.large_string()))
    return Bag(data, off)


def _linked(pairs: DataFrame, texts: DataFrame, idf, most: int) -> DataFrame:
    """Those of at most ``most`` pairs (a, b) whose texts are similar enough. Pairs of an a with many b are dealt out by salts."""
    followers = pairs.groupBy("a").agg(F.count("*").alias("n"))
    least = max(HOT, -(-most // MOST_HOT))
    hot = F.broadcast(followers.filter(F.col("n") > least).select("a", F.ceil(F.col("n") / HOT).cast("int").alias("salts")))  # fewer than MOST_HOT rows
    salts = F.coalesce("salts", F.lit(1))
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int"))
    reps = pairs.select("a").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(hot, "a", "left")
    rows = rows.join(reps.select("a", "text_a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), ["a", "salt"])

    def work(batch: pa.RecordBatch):
        lo = 0
        sizes = np.diff(tx.buffers(batch.column(2))[1]) + np.diff(tx.buffers(batch.column(3))[1])
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + _PAIRS]), _BYTES, "right")))
            part = batch.slice(lo, hi - lo)
            lo = hi
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            place: dict[int, int] = {}
            held: list[str] = []
            for keys, column in ((a, part.column(2)), (b, part.column(3))):
                for i, key in enumerate(keys.tolist()):
                    if key not in place:
                        place[key] = len(held)
                        held.append(column[i].as_py())
            bag = _bag(held)
            got = bag.similarities(idf.value(bag.hash), np.array([place[x] for x in a.tolist()]), np.array([place[x] for x in b.tolist()]))
            keep = got >= SIMILARITY - TIE
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return per_block(rows.select("a", "b", "text_a", "text_b"), work, "a bigint, b bigint")


#: Documents and words of a block of a bucket; two blocks are compared in one step.
BLOCK_DOCS, BLOCK_WORDS = 2048, 1_500_000


def _rest(rest: DataFrame, comp: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links (a, b) between components, of the nodes that buckets (band, key, doc, size) hold.

    In a bucket with several components, nodes outside the largest are compared with all of other components.
    A bucket is cut into blocks by a hash of the node, and a step compares the outsiders of one block with all
    nodes of another; buckets of the same nodes are taken once.  A step gives at most one row for two components.
    """
    now = rest.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    sizes = now.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64("doc")).alias("who"))
    mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bit_xor("who").alias("who")).filter(F.col("kinds") > 1)
    once = mixed.groupBy("who", "n").agg(F.min(F.struct("band", "key", F.col("top.comp").alias("main"), F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_WORDS)).cast("int").alias("blocks"))).alias("x")).select("x.*")
    now = now.join(once, ["band", "key"]).withColumn("minor", F.col("comp") != F.col("main")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_any = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), (F.col("minor") & (k == F.col("own"))).alias("m"), F.lit(True).alias("n")))
    as_minor = F.transform(F.filter(every, lambda k: F.col("minor") & (k != F.col("own"))), lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(True).alias("m"), F.lit(False).alias("n")))
    steps = now.select("band", "key", "doc", "comp", F.inline(F.concat(as_any, as_minor)))
    rows = steps.join(texts.withColumnRenamed("doc_id", "doc"), "doc").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")

    def work(batches):
        held: list[tuple] = []  # (step, comp, m, n, text)
        size = 0

        def flush():
            bag = _bag([h[4] for h in held])
            weight = idf.value(bag.hash)
            comps = np.array([h[1] for h in held])
            m, n = np.array([h[2] for h in held]), np.array([h[3] for h in held])
            edges = np.flatnonzero([True, *(x[0] != y[0] for x, y in zip(held[1:], held, strict=False)), True])
            small_i, small_j, found = [], [], set()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                left, right = lo + np.flatnonzero(m[lo:hi]), lo + np.flatnonzero(n[lo:hi])
                if len(left) * len(right) <= 4096:
                    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                    ok = comps[i] != comps[j]
                    small_i.append(i[ok])
                    small_j.append(j[ok])
                    continue
                own = _bag([h[4] for h in held[lo:hi]])
                like = own.all_similar(idf.value(own.hash), left - lo, right - lo) & (comps[left][:, None] != comps[right][None, :])
                for x, row in zip(left, like, strict=True):
                    found |= {(int(comps[x]), int(c)) for c in np.unique(comps[right[row]])}
            if small_i:
                i, j = np.concatenate(small_i), np.concatenate(small_j)
                for lo in range(0, len(i), _PAIRS):
                    part = slice(lo, lo + _PAIRS)
                    ok = bag.similarities(weight, i[part], j[part]) >= SIMILARITY - TIE
                    found |= set(zip(comps[i[part][ok]].tolist(), comps[j[part][ok]].tolist(), strict=True))
            held.clear()
            pairs = sorted({(min(p), max(p)) for p in found})
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for band, key, i, j, comp_, m, n, text in zip(*(batch.column(k) for k in range(8)), strict=True):
                step = (band.as_py(), key.as_py(), i.as_py(), j.as_py())
                if held and step != held[-1][0] and (size > _BYTES // 4 or len(held) > 1024):
                    yield flush()
                    size = 0
                held.append((step, comp_.as_py(), m.as_py(), n.as_py(), text.as_py()))
                size += len(held[-1][4])
        if held:
            yield flush()

    return rows.select("band", "key", "i", "j", "comp", "m", "n", "text").mapInArrow(work, "a bigint, b bigint")


def _flat(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), a < b, are stars already: each b hangs on one a, which hangs on none."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("b").alias("doc"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("a").alias("doc"), F.lit(0).alias("below"), F.lit(1).alias("above")))))
    return ends.groupBy("doc").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter(F.col("below") + F.col("above") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp), stored: the smallest node of each node's component. edges: (a, b) with a < b; nodes without edges are left out.

    Rounds of large and small stars, until all components are stars; each ends in a stored table of at most as
    many rows as there were edges.
    """
    now = stored(edges.select("a", "b").distinct())
    while not _flat(now):
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()  # larger neighbours now hang on the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        new = stored(small.select(F.inline(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))))).filter(F.col("a") < F.col("b")).distinct())
        dropped(now)
        now = new
    out = stored(now.select(F.col("b").alias("doc"), F.col("a").alias("comp")).unionByName(now.select(F.col("a").alias("doc"), F.col("a").alias("comp")).distinct()))
    dropped(now)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): one row per row of df with a non-null id; class_id is the smallest id of its class.

    Two texts are linked if the weighted Jaccard similarity of their shingles is at least SIMILARITY; texts of
    the same words are linked; texts without words are linked if they are equal; a null text is linked to none.
    A class is a component of links.  Rows that share an id are one document if they have the same words; else
    nobody can tell which text an id means, and the id is a class of its own.  Other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull())
    spark = df.sparkSession
    full = docs.filter(F.col("text").isNotNull())
    n_docs = full.count()
    keys, counts = _common(full, n_docs)
    idf = spark.sparkContext.broadcast(Idf(keys, counts, n_docs))
    every = stored(_signatures(full, idf))
    mixed = stored(_mixed(every).filter("mixed").select("doc_id"))
    signed = every if mixed.isEmpty() else every.join(mixed, "doc_id", "left_anti")
    nodes = stored(signed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "size", "bands")).alias("x")).select("h1", "h2", F.col("x.doc_id").alias("doc"), F.col("x.size").alias("size"), F.col("x.bands").alias("bands")))
    rows = nodes.select("doc", "size", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).filter(F.col("rep") < F.col("last")).drop("last")
    members = stored(rows.join(shared, ["band", "key"]))
    texts = stored(full.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    others = members.filter(F.col("rep") != F.col("doc"))
    pairs = stored(others.select(F.col("rep").alias("a"), F.col("doc").alias("b")).distinct())
    links = stored(_linked(pairs, texts, idf, pairs.count()))
    comp = components(links)
    more = stored(_rest(others.select("band", "key", "doc", "size"), comp, texts, idf))
    if not more.isEmpty():
        tree = comp.filter(F.col("doc") != F.col("comp")).select(F.col("comp").alias("a"), F.col("doc").alias("b"))
        before, comp = comp, components(tree.unionByName(more))
        dropped(before)
    classes = nodes.select("h1", "h2", "doc").join(comp, "doc", "left").select("h1", "h2", F.coalesce("comp", "doc").alias("class_id"))
    lone = docs.filter(F.col("text").isNull()).select("doc_id").unionByName(every.join(mixed, "doc_id", "left_semi").select("doc_id")).select("doc_id", F.col("doc_id").alias("class_id"))
    out = stored(signed.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class_id").unionByName(lone))
    dropped(every, mixed, nodes, members, texts, pairs, links, comp, more)
    return out


def keep_one(df: DataFrame) -> DataFrame:
    """The rows (all columns) of df that stand for their class: the row of its smallest id; rows with a null id all stay.

    Of rows that share an id and their words, the one with the smallest hash of all columns (but maps) stays; of rows
    that share an id only, one of each text.
    """
    classes = near_duplicates(df)
    gone = classes.filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = df.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    again = classes.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if not again.isEmpty():
        rows = kept.join(again, "doc_id", "left_semi")  # of few ids: their words are compared again
        words = _signatures(rows, rows.sparkSession.sparkContext.broadcast(Idf(np.zeros(0, np.uint64), np.zeros(0), 1)))
        words = _mixed(words)
        free = [f"x{i}" for i in range(len(df.columns) + 2) if f"x{i}" not in {c.lower() for c in df.columns}][:2]
        plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
        rows = rows.join(words.select("doc_id", F.col("mixed").alias(free[0])), "doc_id", "left")
        place = F.row_number().over(W.partitionBy("doc_id", F.when(F.col(free[0]), F.col("text"))).orderBy(F.xxhash64(*plain)))
        once = rows.select("*", place.alias(free[1])).filter(F.col(free[1]) == 1).drop(*free)
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    return kept.select(*df.columns).unionByName(df.filter(F.col("doc_id").isNull()))


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of texts with a shingle in common, and what they reach, in DuckDB's SQL. It knows nothing of bands.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, {tx.WORDS_SQL} AS k FROM documents WHERE doc_id IS NOT NULL),
own AS (SELECT k, min(doc_id) AS node FROM w WHERE text IS NOT NULL AND len(k) > 0 GROUP BY k),
s AS (SELECT node, k[i : i + {SHINGLE - 1}] AS s, count(*) AS tf FROM (SELECT node, k, unnest(generate_series(1, greatest(len(k) - {SHINGLE - 1}, 1))) AS i FROM own) GROUP BY ALL),
many AS (SELECT node, count(*) AS n FROM w JOIN own USING (k) WHERE text IS NOT NULL GROUP BY node),
df AS (SELECT s, sum(n) / (SELECT count(*) FROM w WHERE text IS NOT NULL)::DOUBLE AS share FROM s JOIN many USING (node) GROUP BY s),
x AS (SELECT node, s, tf, (1 + {SLOPE} * ln(least(greatest(share, {SHARE}), 1)) / ln({SHARE}::DOUBLE))::FLOAT::DOUBLE AS idf FROM s JOIN df USING (s)),
total AS (SELECT node, sum((1 + ln(tf)) * idf) AS t FROM x GROUP BY node),
low AS (SELECT a.node AS a, b.node AS b, sum((1 + ln(least(a.tf, b.tf))) * a.idf) AS low FROM x a JOIN x b ON a.s = b.s AND a.node < b.node GROUP BY ALL),
e AS (SELECT a, b FROM low JOIN total p ON p.node = a JOIN total q ON q.node = b WHERE low >= ({SIMILARITY}::DOUBLE - {TIE}) * (p.t + q.t - low)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT node AS a, node AS b FROM own UNION SELECT r.a, y.b FROM r JOIN both_ways y ON y.a = r.b),
c AS (SELECT a AS node, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id FROM w JOIN own USING (k) JOIN c USING (node) WHERE text IS NOT NULL
UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY text) FROM w WHERE text IS NOT NULL AND len(k) = 0
UNION ALL SELECT doc_id, doc_id FROM w WHERE text IS NULL
"""

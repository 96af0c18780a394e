"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from whole texts with numpy.  Trees are grown breadth first on binned
statistics with the logistic loss, then flattened into arrays (feature, threshold, left
child, leaf value) that a batch of documents walks in a few vectorised steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import text as tx
from blockwright.llm.spark import bucket_of, per_block, table

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "newline": (10,), "wide": range(128, 256), "comma": b",", "stop": b".", "shout": b"!?", "pipe": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "quote": b"\"'()-:;"}
NAMES = ["log_bytes", "log_words", *_CLASSES, "word_bytes", "word_spread", "long_words", "distinct_words", "top_word", "repeated_lines", "line_words", "capital_starts", "symbol_words", "stop_lines", "order2"]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _i


def _distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each text's slice has, and how often its commonest comes."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(v)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[at], size)
    return np.bincount(o[at], minlength=n), top


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) of a block; an empty text's are all 0."""
    n, size = len(off) - 1, np.diff(off)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * (len(_CLASSES) + 1) + _CLASS_OF[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, :-1]
    share = counts / np.maximum(size, 1)[:, None]
    words = tx.Words(data, off)
    n_words = words.counts()
    some = np.maximum(n_words, 1)
    length = words.end - words.start
    mean = tx.sums(length, words.off) / some
    spread = np.sqrt(np.maximum(tx.sums(length * length, words.off) / some - mean * mean, 0))
    kinds, top = _distinct(words.hash, words.off)
    # lines: pieces between line ends, told apart by the sum of their words' hashes
    ends = np.flatnonzero(data == 10)
    edges = np.union1d(off, ends + 1)
    edges = edges[edges <= len(data)]
    words_before = np.searchsorted(words.start, edges)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash)])
    per_line = np.diff(words_before)
    digest = run[words_before[1:]] - run[words_before[:-1]]
    filled = per_line > 0
    line_owner = np.searchsorted(off, edges[:-1], "right") - 1
    line_off = np.searchsorted(line_owner[filled], np.arange(n + 1))
    n_lines = np.diff(line_off)
    line_kinds, _ = _distinct(digest[filled], line_off)
    last = data[np.maximum(words.end[np.maximum(words_before[1:][filled], 1) - 1], 0).clip(0, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    stops = tx.sums(np.isin(last, np.frombuffer(b".!?", np.uint8)).astype(np.int64), line_off)
    upper = (data[words.start] >= 65) & (data[words.start] <= 90) if len(words.start) else np.zeros(0, bool)
    after = data[words.end.clip(0, max(len(data) - 1, 0))] if len(words.end) else np.zeros(0, np.uint8)
    symbols = np.isin(after, np.frombuffer(b"!#$%&*|", np.uint8))
    two = tx.sums((length == 2).astype(np.int64), words.off) / some
    with_lines = np.maximum(n_lines, 1)
    return np.column_stack([np.log1p(size), np.log1p(n_words), share, mean, spread, tx.sums((length > 20).astype(np.int64), words.off) / some, kinds / some, top / some, 1 - line_kinds / with_lines * (n_lines > 0) - (n_lines == 0), n_words / with_lines, tx.sums(upper.astype(np.int64), words.off) / some, tx.sums(symbols.astype(np.int64), words.off) / some, stops / with_lines, two]).astype(np.float32)


@dataclass(frozen=True)
class Settings:
    """rows: most labelled rows to learn from (a sample by a hash of the id); bins: thresholds of a statistic;
    leaf: fewest rows in a leaf; the rest as usual."""

    rows: int = 30000
    trees: int = 120
    depth: int = 5
    bins: int = 64
    rate: float = 0.1
    leaf: int = 20
    shrink: float = 1.0


@dataclass
class Trees:
    """All trees, each in 2 ** (depth + 1) - 1 places of flat arrays; children of place i are 2 i + 1 and 2 i + 2."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, places) int16
    limit: np.ndarray  # (trees, places) float32: values over it go right
    value: np.ndarray  # (trees, places) float32, of the leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Boosted trees for labels 0 and 1. No rows: scores of 0.5; one kind of label: near that label."""
    s = settings
    p = (y.sum() + 1) / (len(y) + 2)
    places = 2 ** (s.depth + 1) - 1
    model = Trees(float(np.log(p / (1 - p))), s.depth, np.zeros((0, places), np.int16), np.zeros((0, places), np.float32), np.zeros((0, places), np.float32))
    if len(set(y.tolist())) < 2:
        return model
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1], method="lower")).astype(np.float32) for c in x.T]
    codes = np.column_stack([np.searchsorted(lim, c, "left") for lim, c in zip(limits, x.T, strict=True)])
    width, n_features = s.bins + 1, x.shape[1]
    raw = np.full(len(y), model.base)
    made = []
    for _ in range(s.trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        feature, limit, value = np.zeros(places, np.int16), np.full(places, np.inf, np.float32), np.zeros(places, np.float32)
        at = np.zeros(len(y), np.int64)
        for d in range(s.depth):
            lo, n = 2**d - 1, 2**d
            node = at - lo
            g, h, c = (np.zeros((n_features, n, width)) for _ in range(3))
            for f in range(n_features):
                key = node * width + codes[:, f]
                g[f] = np.bincount(key, grad, n * width).reshape(n, width)
                h[f] = np.bincount(key, hess, n * width).reshape(n, width)
                c[f] = np.bincount(key, minlength=n * width).reshape(n, width)
            gl, hl, cl = (np.cumsum(v, axis=2)[:, :, :-1] for v in (g, h, c))
            gt, ht, ct = (v.sum(axis=2)[:, :, None] for v in (g, h, c))
            gain = gl**2 / (hl + s.shrink) + (gt - gl) ** 2 / (ht - hl + s.shrink) - gt**2 / (ht + s.shrink)
            gain[(cl < s.leaf) | (ct - cl < s.leaf)] = -1
            for f, lim in enumerate(limits):
                gain[f, :, len(lim) :] = -1
            flat = gain.transpose(1, 0, 2).reshape(n, -1)
            best = flat.argmax(axis=1)
            for k in range(n):
                if flat[k, best[k]] > 1e-9:
                    f, b = divmod(int(best[k]), width - 1)
                    feature[lo + k], limit[lo + k] = f, limits[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf_g, leaf_h = np.bincount(at, grad, places), np.bincount(at, hess, places)
        value[:] = -s.rate * leaf_g / (leaf_h + s.shrink)
        raw += value[at]
        made.append((feature, limit, value))
    return Trees(model.base, s.depth, *(np.array(v) for v in zip(*made, strict=True)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Trees:
    """Learns labels.quality (0 or 1; other values and nulls are left out) of labels joined to docs by doc_id.

    At most about settings.rows labelled rows are used, by a hash of the id; the ids (8 bytes
    each) are what is broadcast and their statistics are what comes to the driver, so both are bounded.
    """
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = marked.count()
    if total > settings.rows:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(settings.rows / total * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    def work(batch: pa.RecordBatch):
        for lo, hi, data, off in tx.blocks(batch.column(1)):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), batch.column(2)[lo:hi].cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    got = per_block(rows.select("doc_id", "text", "quality"), work, "doc_id bigint, quality int, x array<float>").toPandas()
    got = got.sort_values("doc_id", kind="stable")  # the order of rows must not tell on the sums
    x = np.array(got["x"].tolist(), np.float32).reshape(-1, len(NAMES))
    return fit(x, got["quality"].to_numpy(np.float64), settings)


def score_block(trees: Trees, column: pa.Array):
    for lo, hi, data, off in tx.blocks(column):
        yield lo, hi, trees.score(statistics(data, off))


def _shared(spark, t: Trees):
    return spark.sparkContext.broadcast((t.base, t.depth, t.feature, t.limit, t.value))


def score(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row; null texts count as empty. Only these two columns are read."""
    shared = _shared(df.sparkSession, trees)

    def work(batch: pa.RecordBatch):
        trees = Trees(*shared.value)
        for lo, hi, got in score_block(trees, batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), pa.array(got)], names=["doc_id", "score"])

    return per_block(df.select(id_col, text_col), work, "doc_id bigint, score double")


#: Score from which a document counts as good.
GOOD = 0.7
HELD_OUT = (4, 2)


def keep_good(df: DataFrame, trees: Trees, text_col: str = "text", least: float = GOOD) -> DataFrame:
    """The rows (all columns) whose text scores at least ``least``."""
    shared, at = _shared(df.sparkSession, trees), df.columns.index(text_col)

    def work(batch: pa.RecordBatch):
        trees = Trees(*shared.value)
        for lo, hi, got in score_block(trees, batch.column(at)):
            yield batch.slice(lo, hi - lo).filter(pa.array(got >= least))

    return per_block(df, work, df.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = train(docs, labels.filter(bucket_of(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]))
    held = bucket_of(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    return score(docs, trees).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))

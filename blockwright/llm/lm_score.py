"""Cross-entropy difference of matched target and background bigram models.

Tokens are ids of a public tokenizer, so both models share its vocabulary.  Both are of the form

    p(w | v) = L c(v, w) / c(v) + (1 - L) p(w),   p(w) = (c(w) + 1) / (T + V)

(of a context without counts p(w) alone) over all bigrams of the background.  The models grow with
the corpus, so they are never broadcast nor brought to the driver; only counts of single words are,
which the vocabulary bounds.

1. ``encode`` writes documents as blocks of about BLOCK_TOKENS tokens; each text is tokenized once.
2. ``counts`` merges bigram counts in hashed ranges of keys, as packed arrays; there are PARTS of
   them, and twice as many for each doubling of the blocks above 16 PARTS, up to MOST_PARTS: a
   vocabulary of 50,000 has at most 2.5 billion bigrams, so a range has at most 610,000.
3. ``score`` sends each block's distinct bigrams to their ranges, which stream past the range's
   counts; the differences found go back to the block.  Ranges are dealt out to several tasks each
   when there are many blocks.

The background holds the scored documents themselves, so differences are in-sample: a document that
comes twice is told from one that comes once only by its own counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import text as tx
from blockwright.llm import tokens as tk
from blockwright.llm.spark import dropped, stored, table

WEIGHT = 0.7
#: Fewest and most ranges of bigrams.
PARTS, MOST_PARTS = 256, 4096
BLOCK_TOKENS = 1 << 20
#: Blocks whose requests one task of a range answers.
BLOCKS_A_TASK = 4096
#: Most ids of target documents (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Blocks that a task of the last step holds one after the other, about.
_FINISHED = 16
_FLUSH = 1 << 21
_BLOCK = "block bigint, ids array<bigint>, target array<boolean>, lengths array<bigint>, tokens binary"


def parts_for(blocks: int) -> int:
    """Ranges for so many blocks: a power of two."""
    return min(MOST_PARTS, max(PARTS, 1 << (blocks // 16).bit_length()))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (tx.mix(keys.astype(np.uint64)) >> np.uint64(65 - parts.bit_length())).astype(np.int64)


def encode(rows: DataFrame, path: str) -> DataFrame:
    """Blocks of (doc_id, text, target) rows, written: ids, targets, lengths and the tokens of all texts, end to end."""

    def work(batches):
        bpe, at = tk.byte_bpe(path), TaskContext.get().partitionId() << 32
        kind = np.uint16 if bpe.size <= 1 << 16 else np.uint32
        ids, targets, parts, n = [], [], [], 0

        def block():
            cols = [[at], [ids], [targets], [[len(p) for p in parts]], [np.concatenate(parts).tobytes()]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["block", "ids", "target", "lengths", "tokens"])

        for batch in batches:
            for doc_id, text, target in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                targets.append(bool(target))
                parts.append(bpe.ids(text.as_py() or "").astype(kind))
                n += len(parts[-1])
                if n >= BLOCK_TOKENS or len(ids) >= BLOCK_TOKENS:
                    yield block()
                    at += 1
                    ids, targets, parts, n = [], [], [], 0
        if ids:
            yield block()

    return stored(rows.select("doc_id", "text", "target").mapInArrow(work, _BLOCK))


def _keys(tokens: bytes, lengths: np.ndarray, size: int) -> np.ndarray:
    """Bigrams of a block's texts as v * size + w; the first of a text has the id after the vocabulary's as v."""
    ids = np.frombuffer(tokens, np.uint16 if size <= 1 << 16 else np.uint32).astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = size
    return before * (size + 1) + ids


def _dealt(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """df by the columns, in n partitions if the session's number is too small for that."""
    few = n <= 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*columns) if few else df.repartition(n, *columns)


def _split(keys: np.ndarray, parts: int):
    """(part, places of its keys), in order of parts, for those that have any."""
    part = _part(keys, parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        yield p, order[edges[p] : edges[p + 1]]


def counts(blocks: DataFrame, size: int, parts: int = PARTS) -> DataFrame:
    """(part, keys, background, target): merged bigram counts, keys ascending, arrays of int64 as bytes."""
    names = ["part", "keys", "background", "target"]

    def count(batches):
        held: list[np.ndarray] = []
        n = 0

        def flush():
            both = np.concatenate(held)
            held.clear()
            both.sort()
            pairs = both >> 1
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            keys = pairs[first]
            background = np.diff(np.append(first, len(pairs))).astype(np.uint32)
            target = np.add.reduceat(both & 1, first).astype(np.uint32)
            rows = [(p, keys[own].tobytes(), background[own].tobytes(), target[own].tobytes()) for p, own in _split(keys, parts)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column(1)[i].as_py(), np.int64)
                keys = _keys(batch.column(2)[i].as_py(), lengths, size)
                held.append(keys << 1 | np.repeat(np.array(batch.column(0)[i].as_py(), np.int64), lengths))
                n += len(keys)
                if n >= _FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def merge(batches):
        held: dict[int, list] = {}

        def joined(given: list) -> list:
            keys = np.concatenate([p[0] for p in given])
            keys, at = np.unique(keys, return_inverse=True)
            sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
            for i in (0, 1):
                np.add.at(sums[i], at, np.concatenate([p[i + 1] for p in given]).astype(np.int64))
            return [(keys, *sums)]

        for batch in batches:
            for p, k, b, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = held.setdefault(p, [])
                own.append((np.frombuffer(k, np.int64), np.frombuffer(b, np.uint32), np.frombuffer(t, np.uint32)))
                if len(own) > 16:
                    held[p] = joined(own)
        for p, own in held.items():
            (keys, b, t), = joined(own)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, b, t))], names=names)

    schema = "part int, keys binary, background binary, target binary"
    return _dealt(blocks.select("target", "lengths", "tokens").mapInArrow(count, schema), parts, "part").mapInArrow(merge, schema)


def _single(merged: DataFrame, size: int) -> np.ndarray:
    """(2, 2, size + 1): counts of words and of contexts; background and target."""
    names = [f"x{i}" for i in range(4)]

    def work(batches):
        total = np.zeros((2, 2, size + 1), np.int64)
        for batch in batches:
            for k, *both in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                v, w = np.divmod(np.frombuffer(k, np.int64), size + 1)
                for i, n in enumerate(np.frombuffer(x, np.int64) for x in both):
                    np.add.at(total[0, i], w, n)
                    np.add.at(total[1, i], v, n)
        used = np.flatnonzero(total.any(axis=(0, 1)))
        flat = total.reshape(4, -1)[:, used]
        yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, flat)], names=["word", *names])

    rows = merged.mapInArrow(work, ", ".join(f"{n} bigint" for n in ["word", *names]))
    got = rows.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most a row for each word of the vocabulary
    total = np.zeros((4, size + 1), np.int64)
    total[:, got["word"].to_numpy(np.int64)] = got[names].to_numpy(np.int64).T
    return total.reshape(2, 2, -1)


@dataclass
class Models:
    """The vocabulary's size, counts of single words (see ``_single``), and the table of bigram counts in its ranges."""

    size: int
    single: np.ndarray
    merged: DataFrame
    parts: int = PARTS

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """log2 of the backing-off weight of each context and of each word's share; rows: background, target."""
        words, contexts = self.single
        bow = np.where(contexts > 0, np.log2(1 - WEIGHT), 0.0)
        return bow, np.log2((words + 1) / (words.sum(axis=1, keepdims=True) + self.size + 1))


def train_blocks(blocks: DataFrame, path: str) -> Models:
    size, parts = tk.byte_bpe(path).size, parts_for(blocks.count())
    merged = stored(counts(blocks, size, parts))
    return Models(size, _single(merged, size), merged, parts)


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    ids = target_ids.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().withColumn("target", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def train(docs: DataFrame, target_ids: DataFrame, path: str) -> Models:
    """docs: (doc_id, text); target_ids: doc_id of the target documents. The background is all documents.

    Null and empty texts count nothing; null and repeated ids of the target mark nothing more.  Without any target
    document its model has the shares (0 + 1) / (0 + V) of words alone.  The caller may drop ``merged`` when done.
    """
    blocks = encode(_marked(docs, target_ids), path)
    model = train_blocks(blocks, path)
    dropped(blocks)
    return model


def score_blocks(blocks: DataFrame, model: Models) -> DataFrame:
    """(doc_id, n_tokens, loss_difference) of ``encode``'s blocks, written; see ``score``."""
    size, contexts, parts = model.size, model.single[1], model.parts
    bow, share = model.logs()
    shared = blocks.sparkSession.sparkContext.broadcast((contexts, bow, share))
    n = blocks.count()
    salts = max(1, -(-n // BLOCKS_A_TASK))

    def ask(batches):
        for batch in batches:
            for block, lengths, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = np.unique(_keys(tokens, np.array(lengths, np.int64), size))
                rows = [(block, p, keys[own].tobytes()) for p, own in _split(keys, parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "keys"])

    def answer(batches):
        """Rows of (part, salt): first the range's counts, then each block's keys."""
        contexts, bow, share = shared.value
        of, known, found = None, np.zeros(0, np.int64), np.zeros(0, np.float32)
        for batch in batches:
            out = []
            for part, salt, block, keys, b, t in zip(*(batch.column(i) for i in range(6)), strict=True):
                part, salt, block, keys = part.as_py(), salt.as_py(), block.as_py(), np.frombuffer(keys.as_py(), np.int64)
                if block < 0:
                    counted = np.stack([np.frombuffer(x.as_py(), np.int64) for x in (b, t)])
                    of, known = (part, salt), keys
                    v, w = np.divmod(known, size + 1)
                    logs = [np.log2(WEIGHT * counted[i] / np.maximum(contexts[i, v], 1) + np.exp2(bow[i, v] + share[i, w])) for i in (0, 1)]
                    found = np.append(logs[0] - logs[1], np.nan).astype(np.float32)
                elif of != (part, salt) or not len(known):
                    out.append((block, part, np.full(len(keys), np.nan, np.float32).tobytes()))
                else:
                    at = np.searchsorted(known, keys)
                    hit = known[np.minimum(at, len(known) - 1)] == keys
                    out.append((block, part, found[np.where(hit, at, -1)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "found"])

    def finish(batches):
        """Rows of a block: first what its ranges answered, in order, then the block."""
        _, bow, share = shared.value
        a, b = bow[0] - bow[1], share[0] - share[1]
        answers = []
        for batch in batches:
            for _, _, found, ids, lengths, tokens in zip(*(batch.column(i) for i in range(6)), strict=True):
                if found.is_valid:
                    answers.append(np.frombuffer(found.as_py(), np.float32))
                    continue
                lengths = np.array(lengths.as_py(), np.int64)
                keys, at = np.unique(_keys(tokens.as_py(), lengths, size), return_inverse=True)
                v, w = np.divmod(keys, size + 1)
                per_key = a[v] + b[w]
                for (_, own), values in zip(_split(keys, parts), answers, strict=True):
                    per_key[own] = np.where(np.isnan(values), per_key[own], values)
                answers = []
                mean = np.full(len(lengths), np.nan)
                some = lengths > 0
                if some.any():
                    mean[some] = np.add.reduceat(per_key[at], (np.cumsum(lengths) - lengths)[some]) / lengths[some]
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(lengths), pa.array(mean, mask=~some)], names=["doc_id", "n_tokens", "loss_difference"])

    none = F.lit(None)
    asked = blocks.select("block", "lengths", "tokens").mapInArrow(ask, "block bigint, part int, keys binary")
    asked = asked.select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "keys", none.cast("binary").alias("background"), none.cast("binary").alias("target"))
    known = model.merged.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("bigint").alias("block"), "keys", "background", "target")
    answers = _dealt(asked.unionByName(known), parts * salts, "part", "salt").sortWithinPartitions("part", "salt", "block").mapInArrow(answer, "block bigint, part int, found binary")
    answers = answers.select("block", "part", "found", none.cast("array<bigint>").alias("ids"), none.cast("array<bigint>").alias("lengths"), none.cast("binary").alias("tokens"))
    whole = blocks.select("block", F.lit(parts).alias("part"), none.cast("binary").alias("found"), "ids", "lengths", "tokens")
    both = _dealt(answers.unionByName(whole), -(-n // _FINISHED), "block").sortWithinPartitions("block", "part")
    out = stored(both.mapInArrow(finish, "doc_id bigint, n_tokens bigint, loss_difference double"))
    shared.destroy()
    return out


def score(df: DataFrame, model: Models, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, loss_difference): bits a token that the target model loses over the background model.

    Lower is more like the target.  Texts without tokens (null, empty): 0 tokens and a null difference.  Bigrams
    that the background lacks are scored by the share of their second word.  Rows that share an id are documents of
    their own.  Other columns are not read.
    """
    blocks = encode(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("target")), path)
    out = score_blocks(blocks, model)
    dropped(blocks)
    return out


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    path = tk.tokenizer_path("byte_bpe_50k.tiktoken")
    good = table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    blocks = encode(_marked(table(spark, sf_dir, "documents"), good), path)
    model = train_blocks(blocks, path)
    out = score_blocks(blocks, model)
    dropped(blocks, model.merged)
    return out

"""Language ID by prediction by partial matching: exact code lengths under frozen byte context trees.

Training counts, per language, each byte after each of its contexts of 0 to 3 bytes.  All
languages share one tree of contexts (children by the next older byte); a context is in it if
it was seen often enough in some language: a little text gives its contexts by fewer sights
than much.  Every language of the training rows is learned; more than GROUP of them make
several trees, whose tables are dense in their languages only.  A language's code length of a byte after a
context it has seen is -log2(c / (n + q)) for a byte seen c times there among n, with q kinds;
else the escape -log2(q / (n + q)) and the code length after the context without its oldest
byte; after no context at all, 8 bits.  (Escape method C, without exclusions.)  The tables are
frozen, so a text's code length is a sum of table entries, and a document's language is the
one with the shortest code.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import text as tx
from blockwright.llm.spark import bucket_of, dropped, per_block, stored, table

ORDER = 3
#: Bytes of a training text that are counted at once.
_PIECE = 1 << 20
#: Languages that share a tree.
GROUP = 4
#: Bytes of tables that a worker holds; those of further groups are unpacked anew for each batch.
_HELD = 256 << 20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass(frozen=True)
class Settings:
    """docs: most training documents of a language (a sample by a hash of the id), counted whole;
    least: times that a context must be seen in a language with at least least * bytes of training text;
    with less text it is once for each ``bytes``, but twice at least."""

    docs: int = 3000
    least: int = 20
    bytes: int = 50_000


@dataclass
class Model:
    languages: list[str]
    child: np.ndarray  # (contexts, 256): context with one older byte, or -1
    cost: np.ndarray  # (contexts, columns, languages): bits
    column: np.ndarray  # of each byte; bytes that were never seen share one
    #: Bits a byte that each language's own training bytes took: what is usual.
    usual: np.ndarray

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text in each language, (texts, languages)."""
        n, langs = len(data), len(self.languages)
        out = np.zeros((len(off) - 1, langs))
        for lo in range(0, len(off) - 1):
            if off[lo + 1] - off[lo] > (1 << 22):  # a very long text goes in pieces
                return np.vstack([self._whole(data[off[i] : off[i + 1]]) for i in range(len(off) - 1)])
        if n:
            bits = self._bits(data, self.contexts(data, off))
            out[:] = tx.sums(bits, off)
        return out

    def _whole(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for lo in range(0, len(data), 1 << 20):
            at = max(0, lo - ORDER)
            part = data[at : lo + (1 << 20)]
            node = self.contexts(part, np.array([0, len(part)]))
            total += self._bits(part, node)[lo - at :].sum(axis=0, dtype=np.float64)
        return total

    def contexts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The longest context of the tree before each byte, within its text."""
        n = len(data)
        node = np.zeros(n, np.int32)
        starts = off[:-1][np.diff(off) > 0]
        going = np.ones(n, bool)
        for d in range(1, ORDER + 1):
            at = starts[starts + d - 1 < n] + d - 1
            going[at] = False  # no byte of this text is so much older
            at = np.flatnonzero(going[d:]) + d
            to = self.child[node[at], data[at - d]]
            node[at[to >= 0]] = to[to >= 0]
            going[at[to < 0]] = False
        return node

    def packed(self, first: list[int], parent: np.ndarray, seen: np.ndarray, escape: np.ndarray) -> tuple:
        """The tables without what follows from them: children by parents, and costs of bytes that no language has seen in a context."""
        context, column = np.nonzero(seen)
        older = np.zeros(len(parent), np.uint8)
        above, byte = np.nonzero(self.child >= 0)
        older[self.child[above, byte]] = byte
        return self.languages, self.column, self.usual, first, parent.astype(np.int32), older, escape, context.astype(np.int32), column.astype(np.uint8), self.cost[context, column]

    @classmethod
    def unpacked(cls, languages, column, usual, first, parent, older, escape, context, col, rows) -> Model:
        made, wide = len(parent), int(column.max()) + 1
        child = np.full((made, 256), -1, np.int32)
        child[parent[1:], older[1:]] = np.arange(1, made)
        cost = np.empty((made, wide, len(languages)), np.float32)
        edges = np.searchsorted(context, [*first, made])
        for d, lo in enumerate(first):
            hi = first[d + 1] if d + 1 < len(first) else made
            cost[lo:hi] = escape[lo:hi, None] + (cost[parent[lo:hi]] if d else np.float32(8))
            own = slice(edges[d], edges[d + 1])
            cost[context[own], col[own]] = rows[own]
        return cls(languages, child, cost, column, usual)

    def _bits(self, data: np.ndarray, node: np.ndarray) -> np.ndarray:
        flat = self.cost.reshape(-1, len(self.languages))
        return flat[node.astype(np.int64) * self.cost.shape[1] + self.column[data]]


@dataclass
class Models:
    """Broadcast models of all languages, by groups, in the order of their names."""

    languages: list[str]
    usual: np.ndarray
    parts: list  # broadcasts of Model.packed

    def blocks(self, column: pa.Array):
        """(first row, last row + 1, bytes, offsets, bits of each text in each language) of blocks of a text column."""
        found = [(*block, []) for block in tx.blocks(column)]
        room = _HELD
        for part in self.parts:
            model = vars(part).get("_unpacked") or Model.unpacked(*part.value)
            for _, _, data, off, bits in found:
                bits.append(model.code_lengths(data, off))
            room -= model.child.nbytes + model.cost.nbytes
            if room >= 0:
                part._unpacked = model
            else:
                vars(part).pop("_value", None)
        for lo, hi, data, off, bits in found:
            yield lo, hi, data, off, np.hstack([np.zeros((hi - lo, 0)), *bits])

    def predict(self, bits: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Language, its posterior share under equal priors, and bits a byte over what is usual for it."""
        size = np.maximum(np.diff(off), 1)
        if not self.languages:
            return ["und"] * len(size), np.zeros(len(size)), np.zeros(len(size))
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        share = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
        excess = least / size - self.usual[best]
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, share, 0.0), np.where(letters, excess, 0.0)


def has_letter(column: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: an ASCII one by a table, else a character of a Unicode category L."""
    found = tx.sums(_ASCII_LETTER[data].astype(np.int64), off) > 0
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(unicodedata.category(c)[0] == "L" for c in column[int(i)].as_py() or "")
    return found


def _ngrams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte with its (up to) three older bytes: bits 40.. hold how many there are, then the older bytes, then the byte."""
    n = len(data)
    keys = data.astype(np.uint64)
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    known = np.minimum(place, ORDER)
    for d in range(1, ORDER + 1):
        keys[d:] |= np.where(known[d:] >= d, data[:-d].astype(np.uint64) << np.uint64(8 * d), np.uint64(0)) if n > d else np.uint64(0)
    return keys | known.astype(np.uint64) << np.uint64(40)


def count(training: DataFrame, lang_col: str, text_col: str, settings: Settings) -> DataFrame:
    """(lang, key, n): times of each byte with its context in a language's training documents."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, _, data, off in tx.blocks(batch.column(1)):
                for i in range(len(off) - 1):
                    for a in range(off[i], off[i + 1], _PIECE):
                        older = min(ORDER, a - off[i])
                        part = data[a - older : min(off[i + 1], a + _PIECE)]
                        held.setdefault(langs[lo + i], []).append(_ngrams(part, np.array([0, len(part)]))[older:])
                        size += len(part)
                        if size > 1 << 22:
                            yield from flush()
                            size = 0
        yield from flush()

    return training.select(lang_col, text_col).mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def build(languages: list[str], which: np.ndarray, keys: np.ndarray, n: np.ndarray, settings: Settings) -> tuple:
    """The frozen tables, packed, from counts: which language, key and times, one row each."""
    keys, langs = keys.astype(np.uint64), len(languages)
    often = np.clip(np.bincount(which, n, langs) // settings.bytes, 2, max(2, settings.least))
    known, byte = (keys >> np.uint64(40)).astype(int), (keys & np.uint64(255)).astype(int)
    seen = np.bincount(byte, minlength=256) > 0
    column = np.where(seen, np.cumsum(seen) - 1, seen.sum())
    byte, wide = column[byte], int(seen.sum()) + 1
    child = [np.full((1, 256), -1, np.int32)]
    tables = []  # per depth: (contexts of this depth, columns, languages) counts
    node = np.zeros(len(keys), np.int64)  # of each counted key, at this depth; -1: not in the tree
    made = 1
    first = [0]
    for d in range(ORDER + 1):
        if d:
            older = ((keys >> np.uint64(8 * d)) & np.uint64(255)).astype(int)
            ok = (node >= 0) & (known >= d)
            pair = np.where(ok, node * 256 + older, -1)
            seen, place = np.unique(pair, return_inverse=True)
            per = np.zeros((len(seen), langs), np.int64)
            np.add.at(per, (place, which), n)
            keep = (seen >= 0) & (per >= often).any(axis=1)
            number = np.where(keep, made + np.cumsum(keep) - 1, -1)
            flat = np.concatenate(child)
            flat[seen[keep] // 256, seen[keep] % 256] = number[keep]
            child = [flat, np.full((int(keep.sum()), 256), -1, np.int32)]
            node = number[place]
            first.append(made)
            made += int(keep.sum())
        at = np.flatnonzero(node >= first[d])
        counts = np.zeros((made - first[d], wide, langs), np.int32)
        np.add.at(counts, (node[at] - first[d], byte[at], which[at]), n[at])
        tables.append(counts)
    child = np.concatenate(child)
    parent = np.zeros(made, np.int64)
    above, older = np.nonzero(child >= 0)
    parent[child[above, older]] = above
    cost, escapes = np.zeros((made, wide, langs), np.float32), np.zeros((made, langs), np.float32)
    for d, table_ in enumerate(tables):
        for lo in range(0, len(table_), 1024):
            counts = table_[lo : lo + 1024]
            rows = np.arange(first[d] + lo, first[d] + lo + len(counts))
            after = cost[parent[rows]] if d else np.full((1, wide, langs), 8, np.float32)
            total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                known_cost = -np.log2(counts / (total + kinds))
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0).astype(np.float32)
            cost[rows] = np.where(counts > 0, known_cost, escape + after)
            escapes[rows] = escape[:, 0]
    own = np.zeros(langs)
    size = np.zeros(langs)
    here, going = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)  # the longest context of each key that is in the tree
    for e in range(1, ORDER + 1):
        to = np.where(going & (known >= e), child[here, ((keys >> np.uint64(8 * e)) & np.uint64(255)).astype(int)], -1)
        going = to >= 0
        here = np.where(going, to, here)
    np.add.at(own, which, cost[here, byte, which] * n)
    np.add.at(size, which, n)
    model = Model(languages, child, cost, column, own / np.maximum(size, 1))
    return model.packed(first, parent, np.concatenate([(t > 0).any(axis=2) for t in tables]), escapes)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Models:
    """Learns from rows with a non-null language and text. Each language's documents are sampled by a hash of the id, to about settings.docs."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Models([], np.zeros(0), [])
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, settings.docs / sizes[lang]))])[F.col("lang")]
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30))
    counts = count(chosen, "lang", "text", settings)
    many = len(languages) > GROUP
    if many:
        counts = stored(counts)
    parts, usual = [], []
    for lo in range(0, len(languages), GROUP):
        group = languages[lo : lo + GROUP]
        got = (counts.filter(F.col("lang").isin(group)) if many else counts).toPandas()
        number = {lang: i for i, lang in enumerate(group)}
        if len(got):
            model = build(group, got["lang"].map(number).to_numpy(), got["key"].to_numpy(), got["n"].to_numpy(), settings)
        else:  # texts without a byte
            model = (group, np.zeros(256, np.int64), np.full(len(group), 8.0), [0], np.zeros(1, np.int32), np.zeros(1, np.uint8), np.zeros((1, len(group)), np.float32), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros((0, len(group)), np.float32))
        usual.append(model[2])
        parts.append(docs.sparkSession.sparkContext.broadcast(model))
    if many:
        dropped(counts)
    return Models(languages, np.concatenate(usual), parts)


def score_block(models: Models, column: pa.Array):
    """(first row, last row + 1, languages, scores, excess bits) of blocks of a text column."""
    for lo, hi, data, off, bits in models.blocks(column):
        yield lo, hi, *models.predict(bits, off, has_letter(column[lo:hi], data, off))


def identify(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row; ``und`` and 0 where the text is null or has no letter.

    Ties go to the first language by name.  Only these two columns are read.
    """

    def work(batch: pa.RecordBatch):
        for lo, hi, langs, score, _ in score_block(models, batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return per_block(df.select(id_col, text_col), work, "doc_id bigint, lang_pred string, score double")


def keep_identified(df: DataFrame, models: Models, text_col: str = "text", most_excess: float = 2.5, spare: float = 256.0) -> DataFrame:
    """The rows (all columns) whose language is told: not ``und``, and a code at most ``most_excess`` bits a byte,
    and ``spare`` bits a text, longer than the language's own text took.

    Text of another script or language, of encoded bytes or of shouted words takes 4 to 20 bits more a byte, prose with
    numbers, keys and repeated words up to 2 (see the README).  A short text needs only a letter.  Null texts go.
    """
    at = df.columns.index(text_col)

    def work(batch: pa.RecordBatch):
        for lo, hi, langs, _, excess in score_block(models, batch.column(at)):
            size = np.diff(tx.buffers(batch.column(at)[lo:hi])[1])
            keep = (np.array(langs, object) != "und") & ((excess - most_excess) * size <= spare)
            yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return per_block(df, work, df.schema)


HELD_OUT = (3, 1)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs.filter(bucket_of(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]))
    out = identify(docs, models)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "lang_pred", "score")

"""Offset-mapped token counts: a document is encoded once, and its tokens are dealt to its sections by their spans.

Tokens of a byte-level BPE are consecutive byte spans.  A token inside one section belongs to it.
One that crosses a boundary is dealt by the rule:

``start``     to the section that holds its first byte;
``majority``  to the section that holds most of its bytes, of equals to the first;
``split``     to each section it touches, in shares of its bytes.

Bytes outside all sections belong to none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import tokens as tk
from blockwright.llm.spark import per_block, table

RULES = ("start", "majority", "split")


def line_sections(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines; a line end belongs to the line before it. Empty data: one empty section."""
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]), ends


def allocate(lengths: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens or shares, whole tokens inside, crossing tokens touched) of each section.

    lengths: bytes of each token, in order.  Sections are sorted and don't overlap; they may leave gaps and be empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r}; known: {', '.join(RULES)}")
    n = len(start)
    t_end = np.cumsum(lengths)
    t_start = t_end - lengths
    # the interval join: (token, section) pairs that overlap, by the first and last section of each token
    lo = np.searchsorted(end, t_start, "right")
    hi = np.searchsorted(start, t_end, "left")
    many = np.maximum(hi - lo, 0)
    token = np.repeat(np.arange(len(lengths)), many)
    section = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    common = np.minimum(t_end[token], end[section]) - np.maximum(t_start[token], start[section])
    token, section, common = token[common > 0], section[common > 0], common[common > 0]
    inside = common == lengths[token]
    whole = np.bincount(section[inside], minlength=n)
    crossing = np.bincount(section[~inside], minlength=n)
    if rule == "split":
        return np.bincount(section, common / lengths[token], n), whole, crossing
    if rule == "start":
        own = t_start[token] >= start[section]
        return np.bincount(section[own], minlength=n).astype(float), whole, crossing
    order = np.lexsort((section, -common, token))
    first = np.ones(len(order), bool)
    first[1:] = token[order][1:] != token[order][:-1]
    return np.bincount(section[order][first], minlength=n).astype(float), whole, crossing


def apart(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, end): spans sorted, cut to 0 to n and made apart.

    What an earlier span (by start, then by place in the array) holds is taken from later ones; a span that ends
    before it starts is empty at its start.
    """
    start = np.clip(start, 0, n)
    end = np.maximum(np.clip(end, 0, n), start)
    order = np.argsort(start, kind="stable")
    held = np.concatenate([[0], np.maximum.accumulate(end[order])])[:-1] if len(order) else np.zeros(0, np.int64)
    start = np.maximum(start[order], held)
    return order, start, np.maximum(end[order], start)


SCHEMA = "doc_id bigint, section int, start bigint, end bigint, n_tokens double, n_inside bigint, n_crossing bigint, doc_tokens bigint"


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "majority") -> DataFrame:
    """One row per section of each document: its character span and its tokens.

    sections_col: array of structs (start, end) of character places; by default the lines.  Sections keep their numbers
    in the array.  Spans are cut to the text, and where spans overlap, the common part is the earlier's (see ``apart``);
    the row gives what is left.  A null span, or one with a null start or end, is a row with null places and 0 tokens.
    A null or empty text has one empty section (by default) without tokens; null sections, or an empty array: none.
    Rows that share an id are documents of their own.  Other columns are not read.
    """

    def work(batch: pa.RecordBatch):
        bpe = tk.byte_bpe(path)
        given = batch.column(2).to_pylist() if sections_col else None
        held: list[list] = [[] for _ in range(8)]
        size = 0

        def flush():
            cols = [np.concatenate(h) for h in held]
            for h in held:
                h.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k, from_pandas=True) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for i, key in enumerate(batch.column(0).to_pylist()):
            text = batch.column(1)[i].as_py() or ""
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            chars = None if len(raw) == len(text) else np.append(np.cumsum((data & 0xC0) != 0x80) - ((data & 0xC0) != 0x80), len(text))
            if given is None:
                start, end = line_sections(data)
            else:
                spans = [None if s is None or s["start"] is None or s["end"] is None else (s["start"], s["end"]) for s in given[i] or []]
                blank = np.array([s is None for s in spans], bool)
                kept = np.array([s for s in spans if s is not None], np.int64).reshape(-1, 2)
                place = np.arange(len(raw) + 1) if chars is None else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))
                order, start, end = apart(kept[:, 0], kept[:, 1], len(text))
                order, start, end = np.flatnonzero(~blank)[order], place[start], place[end]
            lengths = bpe.length[bpe.ids(text)]
            got, whole, crossing = allocate(lengths, start, end, rule)
            start, end = (start, end) if chars is None else (chars[start], chars[end])
            n = len(start)
            if given is not None:
                n = len(spans)
                put = np.full((5, n), np.nan)  # places and numbers are exact in doubles
                put[2:] = 0
                put[:, order] = start, end, got, whole, crossing
                start, end, got, whole, crossing = put
            cols = (np.full(n, key, object), np.arange(n), start, end, got, whole, crossing, np.full(n, len(lengths)))
            for h, c in zip(held, cols, strict=True):
                h.append(c)
            size += n
            if size > 50_000:
                yield flush()
                size = 0
        if held[0]:
            yield flush()

    return per_block(df.select(id_col, text_col, *([sections_col] if sections_col else [])), work, SCHEMA)


def token_sections(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op6's rows: the sections, and that their tokens are the document's."""
    rows = op6_token_counts(spark, sf_dir)
    own = rows.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(F.col("end") - F.col("start")).alias("n_chars"), F.max("end").alias("last_end"), F.sum(F.col("section").cast("long") * F.col("start")).alias("starts"), (F.sum("n_tokens") - F.max("doc_tokens")).cast("long").alias("lost_tokens"))
    return own


SECTIONS_ORACLE = """
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS k, len(x) AS n, unnest(x) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
e AS (SELECT doc_id, k, n, s, length(s) + CASE WHEN k < n THEN 1 ELSE 0 END AS size FROM l),
f AS (SELECT * FROM e WHERE size > 0 OR n = 1),
p AS (SELECT doc_id, k - 1 AS section, size, sum(size) OVER (PARTITION BY doc_id ORDER BY k) - size AS start FROM f)
SELECT doc_id, count(*) AS n_sections, sum(size)::BIGINT AS n_chars, max(start + size)::BIGINT AS last_end, sum(section * start)::BIGINT AS starts, 0::BIGINT AS lost_tokens FROM p GROUP BY doc_id
"""


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tk.tokenizer_path("byte_bpe_50k.tiktoken"))

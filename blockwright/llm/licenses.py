"""License scans: matching statistics of a generalised suffix automaton, chained into template spans.

The automaton holds the words of all templates (whole licence notices and the base phrases).
A document's words are streamed through it; the state and length after each word are the
longest piece of any template that ends there.  Maximal matches are attributed to every
template that contains them, chained where they stand in the same order in both, and a
template is reported when its chain covers enough of its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import text as tx
from blockwright.llm.spark import per_block, table

# Phrases whose every place counts, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Words of public licence notices, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
]


class Automaton:
    """A generalised suffix automaton of word sequences, built online."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        where: list[dict[int, int]] = [{}]  # state -> template -> where its words end there first
        for which, seq in enumerate(sequences):
            state = 0
            for at, word in enumerate(seq):
                state = self._extend(state, word, where)
                where[state].setdefault(which, at + 1)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = where[self.link[s]]
            for which, at in where[s].items():
                up[which] = min(at, up.get(which, at))
        self.where = where
        #: Templates that end as a whole in a state or one of its suffixes: what a match of that state completes.
        self.whole: list[tuple[int, ...]] = [()] * len(self.len)
        full = {}
        for which, seq in enumerate(sequences):
            state = 0
            for word in seq:
                state = self.next[state][word]
            full.setdefault(state, []).append((which, len(seq)))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.whole[s] = tuple(full.get(s, ())) + self.whole[self.link[s]]

    def _new(self, length: int, where: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        where.append({})
        return len(self.len) - 1

    def _split(self, p: int, q: int, word: int, where: list) -> int:
        clone = self._new(self.len[p] + 1, where)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int, where: list) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another template already has this piece
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, word, where)
        cur, p = self._new(self.len[last] + 1, where), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, word, where)
        return cur

    def statistics(self, words: list[int]):
        """(state, length) after each word: the longest piece of a template that ends there."""
        state = length = 0
        follow, link, size = self.next, self.link, self.len
        for w in words:
            to = follow[state].get(w)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = follow[state].get(w)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length


@dataclass(frozen=True)
class Scan:
    """What a scan reports. coverage: share of a template's words that a chain must cover;
    least: words of the shortest match that a chain may use; gap: words between two matches of a chain, in either text."""

    coverage: float = 0.8
    least: int = 3
    gap: int = 6


class Scanner:
    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]], scan: Scan) -> None:
        self.scan, self.n_base = scan, len(base)
        named = [(label, phrase) for phrase, label in base.items()] + templates
        self.labels = [label for label, _ in named]
        seqs = [re.findall(r"[0-9a-z]+", t) for _, t in named]
        vocabulary = sorted({w for s in seqs for w in s})
        self.seqs = [[vocabulary.index(w) for w in s] for s in seqs]
        joined = "\0".join(vocabulary).encode()
        ends = np.cumsum([len(w) + 1 for w in vocabulary])
        self.lookup = tx.Lookup(tx.Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).hash)
        assert len(self.lookup.keys) == len(ends)
        self.pair = np.zeros((len(vocabulary) + 1,) * 2, bool)  # adjacent words of templates; the last row: other words
        for s in self.seqs:
            self.pair[s[:-1], s[1:]] = True
        self.single = {s[0]: i for i, s in enumerate(self.seqs[: self.n_base]) if len(s) == 1}
        self.automaton = Automaton(self.seqs)

    def runs(self, ids: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges in which every two neighbours are neighbours in a template; matches of two words or more lie in them."""
        good = self.pair[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
        ends = off[1:-1]
        good[ends[(ends > 0) & (ends < len(ids))] - 1] = False
        edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
        return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True))

    def matches(self, ids: np.ndarray, lo: int, hi: int):
        """Whole base phrases of two words or more (phrase, start), and maximal matches (start, end, state) of a word range."""
        words = ids[lo:hi].tolist()
        phrases, long, before = [], [], (0, 0)
        for at, (state, length) in enumerate(self.automaton.statistics(words)):
            if before[1] >= length and before[1] >= self.scan.least:  # the match before couldn't go on
                long.append((lo + at - before[1], lo + at, before[0]))
            for which, size in self.automaton.whole[state]:
                if which < self.n_base and 1 < size <= length:
                    phrases.append((which, lo + at + 1 - size))
            before = (state, length)
        if before[1] >= self.scan.least:
            long.append((hi - before[1], hi, before[0]))
        return phrases, long

    def chains(self, long: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, coverage) of each best chain of a document's matches."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in long:
            for which, t_end in self.automaton.where[state].items():
                if which >= self.n_base:
                    by.setdefault(which, []).append((start, end, t_end))
        found = []
        for which, parts in by.items():
            size, best = len(self.seqs[which]), None
            chain = None  # (start, end, template end, words covered)
            for start, end, t_end in sorted(parts):
                t_start = t_end - (end - start)
                if chain and t_end > chain[2] and end > chain[1] and start - chain[1] <= self.scan.gap and t_start - chain[2] <= self.scan.gap:
                    new = min(end - start, end - chain[1], t_end - chain[2])
                    chain = (chain[0], end, t_end, chain[3] + new)
                else:
                    chain = (start, end, t_end, end - start)
                if best is None or chain[3] > best[3]:
                    best = chain
            found.append((which, best[0], best[1], min(1.0, best[3] / size)))
        return found


@lru_cache(maxsize=4)
def scanner(scan: Scan = Scan()) -> Scanner:
    return Scanner(BASE, TEMPLATES, scan)


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,coverage:double>>"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: Scan = Scan()) -> DataFrame:
    """One row per document: base phrases, template spans (words from 0) and a score.

    score: the largest share of a template that one chain covers (a whole base phrase is 1).
    Null and empty texts: no words, empty labels, null places, score 0.  Repeated rows and
    ids give repeated results.  Other columns are not read, so their names can't clash.
    """

    def work(batch: pa.RecordBatch):
        s = scanner(scan)
        for lo, hi, data, off in tx.blocks(batch.column(1)):
            words = tx.Words(data, off)
            ids = s.lookup(words.hash)
            ids[ids < 0] = len(s.pair) - 1
            n = hi - lo
            places: dict[int, list] = {}
            matched: dict[int, list] = {}
            for word, which in s.single.items():
                for at in np.flatnonzero(ids == word).tolist():
                    places.setdefault(int(np.searchsorted(words.off, at, "right")) - 1, []).append((which, at))
            for a, b in s.runs(ids, words.off):
                phrases, long = s.matches(ids, a, b)
                if phrases or long:
                    doc = int(np.searchsorted(words.off, a, "right")) - 1
                    places.setdefault(doc, []).extend(phrases)
                    matched.setdefault(doc, []).extend(long)
            n_base, first, last = [0] * n, [None] * n, [None] * n
            base, labels, score, spans = [""] * n, [""] * n, [0.0] * n, [[] for _ in range(n)]
            for doc in matched.keys() | places.keys():
                at0, here = int(words.off[doc]), places.get(doc, [])
                n_base[doc] = len(here)
                names = {s.labels[which] for which, _ in here}
                base[doc] = ",".join(sorted(names))
                if here:
                    first[doc], last[doc] = min(p for _, p in here) - at0, max(p for _, p in here) - at0
                chained = s.chains(matched.get(doc, []))
                score[doc] = max([1.0] * bool(here) + [c for *_, c in chained], default=0.0)
                kept = [(s.labels[w], a - at0, b - at0, c) for w, a, b, c in chained if c >= scan.coverage]
                labels[doc] = ",".join(sorted(names | {x[0] for x in kept}))
                spans[doc] = [dict(label=a, start=b, end=c, coverage=d) for a, b, c, d in sorted(kept)]
            out = [batch.column(0)[lo:hi].cast(pa.int64()), pa.array(words.counts(), pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())]
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*out, pa.array(spans, kind)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return per_block(df.select(id_col, text_col), work, SCHEMA)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def license_base(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op1's rows: words, and places (-1: none) and labels of base phrases."""
    places = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("first_word", "last_word")]
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", *places, "base_labels")


BASE_ORACLE = f"""
WITH w AS (SELECT doc_id, {tx.WORDS_SQL} AS k FROM documents),
p AS (SELECT unnest({[p.split() for p in BASE]}) AS phrase, unnest({list(BASE.values())}) AS label),
i AS (SELECT doc_id, k, unnest(generate_series(1, len(k))) AS i FROM w),
f AS (SELECT doc_id, label, i - 1 AS at_word FROM i JOIN p ON k[i : i + len(phrase) - 1] = phrase)
SELECT w.doc_id, any_value(len(w.k))::BIGINT AS n_words, count(label) AS n_base, coalesce(min(at_word), -1)::BIGINT AS first_word, coalesce(max(at_word), -1)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS base_labels
FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id
"""

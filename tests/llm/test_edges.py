"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

import corpus_pipeline
from blockwright.llm import chat, decontaminate, language, licenses, lm_score, near_dup, packing, quality, tiff, token_counts
from blockwright.llm import tokens as tk
from blockwright.llm.queries import OPERATORS, ORACLES, QUERIES

BPE = tk.tokenizer_path("byte_bpe_50k.tiktoken")
_rng = random.Random(1)
LONG = " ".join("".join(_rng.choices("abcdefgh", k=5)) for _ in range(400_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, labels int, class_id string, sequence_id string"
TEXTS = ["plain words of one text here", None, "", " \n\t", "!!! ???", LONG, "plain words of one text here", "é", " x\x00y", "a" * 100_000, "word"]
ROWS = [(i, t, ["en", "fr", None][i % 3], None, None, None, None, None, None, None) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], ROWS[0], (None, "text without an id", "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int, text string"


def operators(spark):
    labels = spark.createDataFrame([(0, 1, 0, "x"), (4, 0, None, None), (5, None, 1, None), (None, 1, 1, None), (0, 1, 0, "x")], LABELS)
    items = spark.createDataFrame([(1, "plain words of one text here"), (2, None), (3, ""), (4, "word"), (None, "é")], "item_id long, text string")
    return {
        "licenses": licenses.scan_licenses,
        "near": near_dup.near_duplicates,
        "tiff": lambda d: tiff.media_digests(tiff.text_media(d)),
        "packing": packing.pack,
        "lm": lambda d: lm_score.score(d, lm_score.train(d.select("doc_id", "text"), labels.select("doc_id"), BPE), BPE),
        "tokens": lambda d: token_counts.count_tokens(d, BPE),
        "contained": lambda d: decontaminate.find_contained(d, items),
        "language": lambda d: language.identify(d, language.train(d)),
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
    }


@pytest.mark.parametrize("name", ["licenses", "near", "tiff", "packing", "lm", "tokens", "contained", "language", "quality"])
def test_odd_and_empty_tables(spark, odd, none, name):
    f = operators(spark)[name]
    assert f(none).count() == 0
    rows = f(odd).collect()
    per_row = {"licenses", "tiff", "lm", "language", "quality"}
    if name in per_row:
        assert len(rows) == len(ROWS)
    if name == "near":
        got = {r["doc_id"]: r["class_id"] for r in rows}
        assert len(rows) == len([r for r in ROWS if r[0] is not None])
        assert got[6] == got[0] == 0 and all(got[i] == i for i in (1, 2, 3, 4, 5, 7, 10))
    if name == "language":
        assert {r["doc_id"]: r["lang_pred"] for r in rows}[1] == "und" and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3, 4))
    if name == "contained":
        assert sorted((r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] is not None and r["item_id"] is not None) == sorted([(0, 1)] * 3 + [(6, 1), (10, 4)])


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(0, 1, 0, "x"), (4, 0, None, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "unlike anything else in these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "best_fit_packing":
                assert out.columns == docs.columns
                now = out
        assert out.count() >= (docs is odd)


def test_near_copies_keep_one(spark, odd):
    kept = near_dup.keep_one(odd)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10] and ids.count(None) == 2


def test_near_copies_of_ids_that_come_again(spark):
    """An id with different texts loses none of them; one with the same words is one document."""
    a, b = "plain words of one text here and some more of it", "quite another text with words of its own and nothing shared"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (7, b, "x"), (8, a + "!", "y"), (9, a, "x"), (9, a + ".", "y"), (3, "third text alone in the world, twice the same", "x"), (3, "third text alone in the world, twice the same.", "y"), (4, None, "x"), (4, "a text beside a null one", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, x0 string").repartition(4)
    got = near_dup.near_duplicates(frame).collect()
    assert sorted(map(tuple, got)) == sorted([(1, 1), (5, 5), (5, 5), (5, 5), (7, 7), (8, 1), (9, 1), (9, 1), (3, 3), (3, 3), (4, 4), (4, 4)])
    kept = near_dup.keep_one(frame)
    assert kept.columns == frame.columns
    by = {}
    for r in kept.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert {k: len(v) for k, v in by.items()} == {1: 1, 5: 2, 7: 1, 3: 1, 4: 2}
    assert set(by[5]) == {a, b}


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, chosen string, prompt int"
    empty = spark.createDataFrame([], schema)
    assert chat.format_pairs(chat.branch_pairs(empty)).count() == 0
    rows = [(1, 0, None, None, "x", 1), (2, 0, "user", LONG, None, None), (2, 0, "user", LONG, None, None), (None, 1, "user", "y", None, None)]
    got = chat.format_pairs(chat.branch_pairs(spark.createDataFrame(rows, schema))).collect()
    assert got == []  # no reply, nothing to prefer
    rows += [(4, 0, "user", None, None, 1), (4, 1, "assistant", None, None, 1), (5, 0, "user", "", None, 1), (5, 1, "assistant", LONG, None, 1), (5, 1, "assistant", LONG, None, 1)]
    got = chat.format_pairs(chat.branch_pairs(spark.createDataFrame(rows, schema))).collect()
    assert {(r["kind"], r["chosen_id"], r["rejected_id"], r["n_prefix"]) for r in got} == {("swapped", 4, 5, 1), ("swapped", 5, 4, 2)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    now, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SMALL)
        assert out.columns == docs.columns and out.subtract(now).count() == 0
        if name == "language_id":
            assert out.count() >= 0.99 * n
        if name == "quality_classifier":
            good = labels.filter("quality = 1").join(now, "doc_id").count()
            assert out.join(labels.filter("quality = 1"), "doc_id").count() >= 0.97 * good
            assert out.join(labels.filter("quality = 0"), "doc_id").count() <= 0.1 * labels.filter("quality = 0").count() + 1
        now = out
    last = corpus_pipeline.run(spark, SMALL)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in now.select("doc_id").collect()}
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OPERATORS) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, duck, name):
    show = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and show(got) == show(want)

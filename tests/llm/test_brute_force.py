"""Operators against brute force on small fixtures."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import SMALL

from blockwright.llm import chat, decontaminate, language, licenses, lm_score, near_dup, packing, quality, tiff, token_counts
from blockwright.llm import text as tx
from blockwright.llm import tokens as tk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(lowered(text))


def shingles_of(text, k=5):
    w = words_of(text)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def corpus(seed, n, vocabulary=400, longest=200):
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choices(names, k=rng.randint(0, longest))) for _ in range(n)]


def test_words_and_shingles():
    texts = ["Ab c,d É-é x1", "", "one", "a b c d e f", "…", "A" * 3000, "a b c d e f"]
    for block in (10, 1 << 20):
        got = []
        for _, _, data, off in tx.blocks(pa.array(texts), block):
            w = tx.Words(data, off)
            s, s_off = tx.shingles(w.hash, w.off)
            got += [(w.hash[a:b].tolist(), s[c:d].tolist()) for a, b, c, d in zip(w.off, w.off[1:], s_off, s_off[1:], strict=False)]
        assert [len(g[0]) for g in got] == [len(words_of(t)) for t in texts]
        assert [len(g[1]) for g in got] == [len(shingles_of(t)) for t in texts]
        assert got[3] == got[6] and len(set(got[3][0])) == 6


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    table = tx.Lookup(keys[:3000], 5000)
    table.add(keys[3000:])
    assert (table(keys) == np.arange(len(keys))).all()
    assert (table(keys + np.uint64(1)) == -1).sum() > 4000


# License scans


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_license_base(spark, docs):
    extra = [(10**6, "CC BY cc by, All Rights\nreserved! the GENERAL public license. all rights all rights reserved cc-by"), (10**6 + 1, "cc byé ccby ÉCC by")]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame).collect()}
    for key, text in docs + extra:
        w = words_of(text)
        at = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        r = got[key]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def test_license_automaton_statistics():
    rng = random.Random(4)
    seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    a = licenses.Automaton(seqs)
    text = [rng.randrange(5) for _ in range(400)]
    pieces = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for at, (_, length) in enumerate(a.statistics(text)):
        want = max((n for n in range(1, 13) if tuple(text[max(0, at + 1 - n) : at + 1]) in pieces and n <= at + 1), default=0)
        assert length == want


def test_license_spans(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 200).split()
    edited = mit[:20] + ["changed"] + mit[21:]
    rows = [(1, "intro words " + " ".join(edited) + " outro"), (2, " ".join(mit[:10])), (3, "Licensed under the Apache License, Version 2.0."), (4, " ".join(reversed(mit)))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["spans"][0]["start"] == 2 and got[1]["spans"][0]["end"] == 2 + len(mit)
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 0.5
    assert got[3]["labels"] == "apache-2.0" and got[4]["labels"] == ""


def test_base_phrases_of_one_word():
    scan = licenses.Scanner({"unlicense": "public-domain", "all rights reserved": "reserved"}, [], licenses.Scan())
    text = b"Unlicense: all rights reserved, unlicense unlicensed"
    words = tx.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    ids = scan.lookup(words.hash)
    assert list(scan.single.values()) == [0] and [int(np.flatnonzero(ids == w)[k]) for w in scan.single for k in (0, 1)] == [0, 4]
    ids[ids < 0] = len(scan.pair) - 1
    assert [p for a, b in scan.runs(ids, words.off) for p in scan.matches(ids, a, b)[0]] == [(1, 1)]


# Near copies


def near_fixture():
    rng = random.Random(7)
    texts = corpus(8, 40, 3000, 150)
    names = [f"n{i}" for i in range(500)]
    for base in range(4):
        source = rng.choices(names, k=rng.randint(60, 120))
        for _ in range(60):  # a group of near copies of which many straddle the threshold
            copy = list(source)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(names)
            texts.append(" ".join(copy))
    texts += [' '.join(names[i % 9 + i // 40 * 9] for i in range(200 + k)) + ' ' + ' '.join(names[:k]) for k in range(0, 30, 3)]  # repeated shingles
    texts += texts[:10] + ["", "", "!!", "!!", "?", "one two", "One TWO", "one two three"]
    return list(enumerate(texts, 100))


def brute_classes(rows):
    bags = {i: Counter(shingles_of(t)) for i, t in rows}
    n = len(rows)
    df = Counter(s for b in bags.values() for s in b)
    idf = {s: float(near_dup.Idf.of(np.array([d]), n)[0]) for s, d in df.items()}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if bags[i] and bags[j]:
                low = sum((1 + math.log(min(c, bags[j][s]))) * idf[s] for s, c in bags[i].items() if s in bags[j])
                union = sum((1 + math.log(c)) * idf[s] for x in (i, j) for s, c in bags[x].items()) - low
                same = low >= (near_dup.SIMILARITY - near_dup.TIE) * union
            else:
                same = a == b
            if same:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rows = near_fixture()
    want = brute_classes(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame).collect()} == want
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 7)  # buckets in many blocks
    monkeypatch.setattr(near_dup, "HOT", 5)  # representatives with salted followers
    monkeypatch.setattr(near_dup, "CELLS_LOG2", 12)  # a sketch that is too small at first
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame).collect()} == want


def test_bag_similarities_agree():
    rows = near_fixture()[180:300]
    data, off = tx.buffers(pa.array([t for _, t in rows]))
    bag = near_dup.Bag(data, off)
    weight = np.full(len(bag.hash), 1.25, np.float32)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(120), np.arange(120)))
    got = bag.similarities(weight, i, j).reshape(120, 120)
    full = np.diff(bag.off) > 0
    dense = bag.all_similar(weight, np.arange(120), np.arange(120))
    other = ~np.eye(120, dtype=bool) & full[:, None] & full[None, :]  # a text isn't compared with itself
    assert ((got >= near_dup.SIMILARITY - near_dup.TIE) == dense)[other].all()


def test_similar_at_exactly_the_threshold():
    names = [f"w{i}" for i in range(40)]
    texts = [names[:13], [*names[:12], "x"], names[:12], names[1:13]]  # 9, 9, 8 and 8 shingles; 8 in common of 10, then of 9
    data, off = tx.buffers(pa.array([" ".join(t) for t in texts]))
    bag = near_dup.Bag(data, off)
    weight = np.ones(len(bag.hash), np.float32)
    i, j = np.array([0, 0, 1, 2]), np.array([1, 2, 3, 3])
    assert np.allclose(bag.similarities(weight, i, j), [0.8, 8 / 9, 7 / 10, 7 / 9])
    assert bag.all_similar(weight, np.arange(4), np.arange(4))[i, j].tolist() == [True, True, False, False]


def test_sketch_keeps_all_common_shingles(spark):
    rng = random.Random(4)
    shared = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=8)) for _ in range(20)]
    texts = [" ".join([f"u{i}x{j}" for j in range(60)] + rng.sample(shared, 3)) for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = Counter(s for t in texts for s in set(shingles_of(t)))
    for bits in (12, 20):
        near_dup_bits, near_dup.CELLS_LOG2 = near_dup.CELLS_LOG2, bits
        try:
            keys, n = near_dup._common(frame, 300)
        finally:
            near_dup.CELLS_LOG2 = near_dup_bits
        assert sorted(n.tolist()) == sorted(x for x in df.values() if x >= 2) and len(set(keys.tolist())) == len(keys)


def test_tables_of_steps_are_removed(spark):
    import os

    folder = near_dup.stored(spark.range(1))._stored_at.rpartition("/")[0].removeprefix("file:")
    before = set(os.listdir(folder))
    near_dup.near_duplicates(spark.createDataFrame(near_fixture(), "doc_id long, text string")).collect()
    packing.pack(spark.createDataFrame(near_fixture(), "doc_id long, text string")).collect()
    assert len(set(os.listdir(folder)) - before) == 2  # the results


def test_samples_estimate_similarity():
    rng = random.Random(2)
    a = [f"w{i}" for i in range(400)]
    b = [w if rng.random() < 0.97 else "x" + w for w in a]
    data, off = tx.buffers(pa.array([" ".join(a), " ".join(b)]))
    bag = near_dup.Bag(data, off)
    idf = near_dup.Idf(np.zeros(0, np.uint64), np.zeros(0), 1000)
    want = float(bag.similarities(idf(bag.hash), np.array([0]), np.array([1]))[0])
    weight = np.log(near_dup.damped(bag.count) * idf(bag.hash)).astype(np.float32)
    same = 0
    for k in range(near_dup.BANDS * near_dup.R):
        at, level = near_dup.samples(bag, weight, k)
        same += bag.hash[at[0]] == bag.hash[at[1]] and level[at[0]] == level[at[1]]
    n = near_dup.BANDS * near_dup.R
    assert abs(same / n - want) < 4 * math.sqrt(want * (1 - want) / n)


def test_components(spark):
    rng = random.Random(3)
    edges = [tuple(sorted(rng.sample(range(300), 2))) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = near_dup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["doc"]: r["comp"] for r in got.collect()} == {i: find(i) for i in list(parent)}


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([], {}),
        ([(1, 2)], {1: 1, 2: 1}),
        ([(1, 5), (1, 5), (1, 6), (2, 7)], {1: 1, 5: 1, 6: 1, 2: 2, 7: 2}),  # stars already, with a repeated edge
        ([(1, 2), (2, 3)], {1: 1, 2: 1, 3: 1}),
        ([(1, 9), (2, 9)], {1: 1, 2: 1, 9: 1}),  # two stars share a leaf
        ([(4, 5), (3, 4), (2, 3), (1, 2)], dict.fromkeys(range(1, 6), 1)),
    ],
)
def test_components_of_small_graphs(spark, edges, want):
    got = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["doc"]: r["comp"] for r in got} == want and len(got) == len(want)


# Media


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trips(compression, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (37, 53), np.uint8), np.zeros((5, 300), np.uint8), rng.integers(0, 4, (64, 64, 3)).astype(np.uint8), rng.integers(0, 60000, (20, 30), np.uint16), np.arange(200, dtype=np.uint32).reshape(10, 20), (np.arange(40_000) % 251).astype(np.uint8).reshape(200, 200)]
    for predictor in (1, 2):
        for tile in (None, (16, 32)):
            got = tiff.decode(tiff.encode(pages, compression, predictor, 16, tile, order))
            for a, b in zip(pages, got, strict=True):
                assert (a.reshape(b.pixels.shape) == b.pixels).all()


def test_tiff_codecs_and_damage():
    rng = random.Random(1)
    for n in (1, 2, 127, 128, 129, 5000, 70_000):
        for raw in (bytes(rng.choices(b"ab", k=n)), bytes(n), bytes(rng.choices(range(256), k=n))):
            assert tiff.packbits_decode(tiff.packbits_encode(raw), n) == raw
            assert tiff.lzw_decode(tiff.lzw_encode(raw), n) == raw
    whole = tiff.encode([np.ones((9, 9), np.uint8)])
    for bad in (b"", b"II*\0", whole[:-20], b"XX" + whole[2:], whole[:4] + struct.pack("<I", 10**6) + whole[8:]):
        with pytest.raises(tiff.TiffError):
            tiff.decode(bad)


def test_tiff_codes_written_by_hand():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the example in descriptions of PackBits
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.packbits_decode(packed, len(plain)) == plain and tiff.packbits_decode(b"\x80" + packed, len(plain)) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the example in the format's description, 9 bits each
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))[: len(data)] == data
    with pytest.raises(tiff.TiffError):
        tiff.lzw_decode(data, 10)
    with pytest.raises(tiff.TiffError):
        tiff.packbits_decode(packed, len(plain) + 1)


def with_fields(data, changes):
    """A one-page file with other (kind, count, value) in some fields."""
    data = bytearray(data)
    at = struct.unpack_from("<I", data, 4)[0]
    for i in range(struct.unpack_from("<H", data, at)[0]):
        field = at + 2 + 12 * i
        tag = struct.unpack_from("<H", data, field)[0]
        if tag in changes:
            struct.pack_into("<HHII", data, field, *([tag, *changes[tag]] if changes[tag] else [60000, 3, 1, 0]))
    return bytes(data)


def test_tiff_sizes_that_make_no_sense(spark):
    tiled = tiff.encode([np.ones((9, 9), np.uint8)], tile=(16, 16))
    plain = tiff.encode([np.ones((9, 9), np.uint8)], tiff.NONE)
    files = [
        with_fields(tiled, {tiff.TILE_WIDTH: None}),
        with_fields(tiled, {tiff.TILE_WIDTH: (4, 1, 0)}),
        with_fields(plain, {tiff.WIDTH: (4, 0, 0)}),
        with_fields(plain, {tiff.SAMPLES: (3, 1, 0), tiff.PLANAR: (3, 1, 2)}),
        with_fields(plain, {tiff.WIDTH: (4, 1, 4 * 10**9), tiff.HEIGHT: (4, 1, 4 * 10**9)}),
        with_fields(plain, {tiff.WIDTH: (4, 1, 30_000), tiff.HEIGHT: (4, 1, 30_000)}),
        with_fields(tiled, {tiff.TILE_WIDTH: (4, 1, 10**9), tiff.TILE_HEIGHT: (4, 1, 10**9)}),
        with_fields(plain, {tiff.HEIGHT: (9, 1, 0xFFFFFFFF)}),
        with_fields(plain, {tiff.BITS: (3, 0, 0)}),
    ]
    rows = tiff.read_pages(spark.createDataFrame(list(enumerate(files)), "media_id long, media binary")).collect()
    assert sorted((r["media_id"], r["page"]) for r in rows) == [(i, 0) for i in range(len(files))] and all(r["error"] and r["pixels"] is None for r in rows)


@pytest.mark.parametrize("seed", range(5))
def test_tiff_flipped_bytes_give_pages_or_errors(seed):
    rng = np.random.default_rng(seed)
    whole = [tiff.encode([rng.integers(0, 9, (20, 30), np.uint8), rng.integers(0, 9, (12, 9, 3)).astype(np.uint16)], how, 2, 8, tile) for how in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE) for tile in (None, (16, 16))]
    for data in whole:
        for _ in range(60):
            bad = bytearray(data)
            for at in rng.integers(0, len(bad), rng.integers(1, 5)):
                bad[at] = rng.integers(0, 256)
            try:
                for page in tiff.each_page(bytes(bad[: rng.integers(1, len(bad) + 1)] if rng.random() < 0.3 else bad)):
                    assert isinstance(page, (tiff.Page, tiff.TiffError))
            except tiff.TiffError:
                pass


def test_tiff_float_predictor():
    image = np.linspace(-5, 5, 60, dtype=">f4").reshape(6, 10)
    raw = image.view(np.uint8).reshape(6, 10, 4).transpose(0, 2, 1).reshape(6, 40)
    coded = np.concatenate([raw[:, :1], np.diff(raw, axis=1)], axis=1)
    plain = tiff.encode([image.view(">u4").astype(np.uint32)], tiff.NONE)
    at = struct.unpack_from("<I", plain, 4)[0]
    data = bytearray(plain)
    data[8 : 8 + 240] = coded.tobytes()
    for i in range(struct.unpack_from("<H", plain, at)[0]):
        tag = struct.unpack_from("<H", plain, at + 2 + 12 * i)[0]
        if tag == tiff.PREDICTOR:
            struct.pack_into("<H", data, at + 2 + 12 * i + 8, 3)
    assert (tiff.decode(bytes(data))[0].pixels[:, :, 0].astype(">u4").view(">f4") == image).all()


def test_tiff_pages_and_digests(spark, docs):
    media = [(1, tiff.encode([np.ones((3, 4), np.uint8), np.zeros((2, 2), np.uint16)], tiff.LZW)), (2, b"junk"), (3, None)]
    rows = tiff.read_pages(spark.createDataFrame(media, "media_id long, media binary")).orderBy("media_id", "page").collect()
    assert [(r["media_id"], r["page"], r["width"], r["bits"]) for r in rows[:2]] == [(1, 0, 4, 8), (1, 1, 2, 16)]
    assert bytes(rows[0]["pixels"]) == b"\1" * 12 and all(r["error"] for r in rows[2:])
    got = {r["doc_id"]: r for r in tiff.media_digests(tiff.text_media(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    for key, text in docs:
        n, payload = tiff.payload_of(text)
        r = got[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n) and payload[:n] == text.encode()
    small = spark.createDataFrame(docs[:20], "doc_id long, text string")
    for row in tiff.text_media(small).collect():
        assert tiff.decode(bytes(row["media"]))[0].pixels.tobytes() == tiff.payload_of(dict(docs)[row["doc_id"]])[1]


def test_tiff_pages_beside_damaged_ones(spark):
    whole = tiff.encode([np.full((3, 4), i, np.uint8) for i in range(4)], tiff.NONE)

    def changed(damage):
        data, at, link = bytearray(whole), 0, 4
        for page in range(4):
            at = struct.unpack_from("<I", data, link)[0]
            n = struct.unpack_from("<H", data, at)[0]
            for i in range(n):
                field = at + 2 + 12 * i
                if (page, struct.unpack_from("<H", data, field)[0]) in damage:
                    struct.pack_into("<HII", data, field + 2, *damage[page, struct.unpack_from("<H", data, field)[0]])
            link = at + 2 + 12 * n
            if (page, "next") in damage:
                struct.pack_into("<I", data, link, 10**6)
                break
        return bytes(data)

    files = [changed({(1, tiff.BITS): (3, 1, 1), (2, tiff.COMPRESSION): (3, 1, 99)}), changed({(0, tiff.STRIP_OFFSETS): (4, 9, 10**6)}), changed({(1, tiff.SAMPLES): (3, 1, 0), (1, tiff.PLANAR): (3, 1, 2)}), changed({(1, "next"): ()})]
    rows = tiff.read_pages(spark.createDataFrame(list(enumerate(files)), "media_id long, media binary")).collect()
    assert {(r["media_id"], r["page"]) for r in rows if r["error"]} == {(0, 1), (0, 2), (1, 0), (2, 1), (3, None)}
    good = {(r["media_id"], r["page"]): bytes(r["pixels"]) for r in rows if not r["error"]}
    assert good == {(f, i): bytes([i]) * 12 for f, i in [(0, 0), (0, 3), (1, 1), (1, 2), (1, 3), (2, 0), (2, 2), (2, 3), (3, 0), (3, 1)]}
    assert len(rows) == 15


# Packing


def slow_packing(lengths, capacity):
    left, bins = sorted(lengths, reverse=True), []
    while left:
        free, content = capacity, []
        for x in list(left):
            if x <= free:
                content.append(x)
                left.remove(x)
                free -= x
        if free:
            small = min(content)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= free + small]
            if pairs:
                _, a, b = max(pairs)
                content.remove(small)
                left += [small]
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
                content += [a, b]
        bins.append(sorted(content))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_packing_against_piece_by_piece(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 150))]
    counts = np.bincount(lengths, minlength=51) if lengths else np.zeros(51, np.int64)
    got = []
    for times, content in packing.pack_counts(counts, 50).bins:
        got += [sorted(x for x, n in content for _ in range(n))] * times
    assert sorted(got) == sorted(slow_packing(lengths, 50))


def test_packing_places_every_token(spark, docs):
    path = tk.tokenizer_path("word_bpe_49k.json")
    tokenizer = tk.WordBpe(path).tokenizer
    frame = spark.createDataFrame([*docs, (10**6, None), (10**6 + 1, "")], "doc_id long, text string")
    rows = packing.pack(frame).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in [*docs, (10**6, ""), (10**6 + 1, "")]:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == packing.cut(np.array(ids))
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])) for r in parts]
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) * 1.02 + 1
    made = packing.sequences(frame.limit(50)).collect()
    assert max(len(r["ids"]) for r in made) <= packing.CAPACITY


def test_packing_ranks_in_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    rows = packing.stored(spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "CAST(1000 + id % 3 AS BIGINT) AS length"))
    spans = defaultdict(list)
    for r in packing.place(rows).collect():
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, spans.values())) == 500 and len(spans) == 125
    for s in spans.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))]


def test_word_bpe_against_its_library():
    bpe = tk.WordBpe(tk.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["", "It's he'll I'd we've they're I'm ''s x's 'S '", "a1b22 ½ ² x", "ÉÀ ŒŸ", "Σ ΣΑΣ", "<|endoftext|> hi", "é", "日本語", "\t\r\n", "!!'s !'s", "İ 'ſ", "'re've'll"]
    texts += ["".join(rng.choice("abs tdmrevl'' 1é!\n<|") for _ in range(rng.randrange(60))) for _ in range(1500)]
    got = []
    for _, _, data, off in tx.blocks(pa.array(texts), 3000):
        ids, at = bpe.encode(data, off)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [bpe.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# Language models


def test_ranges_grow_with_the_blocks():
    assert [lm_score.parts_for(n) for n in (0, 1, 4000, 4096, 7500, 16000, 10**9)] == [256, 256, 256, 512, 512, 1024, 4096]
    keys = np.arange(10**5) * 977
    for parts in (256, 1024):
        got = dict(lm_score._split(keys, parts))
        assert len(got) == parts and sorted(np.concatenate(list(got.values())).tolist()) == list(range(10**5))


@pytest.mark.parametrize("parts", [256, 512])
def test_loss_differences(spark, monkeypatch, parts):
    monkeypatch.setattr(lm_score, "PARTS", parts)
    path = tk.tokenizer_path("byte_bpe_50k.tiktoken")
    bpe = tk.byte_bpe(path)
    texts = ["the cat sat on the mat"] * 3 + ["a dog and the cat"] * 2 + ["numbers 1 2 3", "", None]
    good = {0, 3, 5}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_score.train(frame, spark.createDataFrame([(i,) for i in good], "doc_id long"), path)
    size = bpe.size + 1
    ids = [[bpe.size, *bpe.ids(t or "").tolist()] for t in texts]
    both = []
    for part in (range(len(texts)), good):
        pairs = Counter(p for i in part for p in zip(ids[i], ids[i][1:], strict=False))
        both.append((pairs, Counter(p[0] for p in pairs.elements()), Counter(p[1] for p in pairs.elements())))
    def prob(k, v, w):
        pairs, contexts, words = both[k]
        p1 = (words[w] + 1) / (words.total() + size)
        c = contexts[v]
        return lm_score.WEIGHT * pairs[v, w] / c + (1 - lm_score.WEIGHT) * p1 if c else p1

    rows = {r["doc_id"]: r for r in lm_score.score(frame, model, path).collect()}
    for i, own in enumerate(ids):
        want = [math.log2(prob(0, v, w) / prob(1, v, w)) for v, w in zip(own, own[1:], strict=False)]
        assert rows[i]["n_tokens"] == len(want)
        assert rows[i]["loss_difference"] is None if not want else abs(rows[i]["loss_difference"] - sum(want) / len(want)) < 1e-5


# Token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation(rule):
    rng = random.Random(6)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 5) for _ in range(rng.randint(0, 20))], np.int64)
        n = int(lengths.sum())
        cuts = sorted(rng.choices(range(n + 1), k=2 * rng.randint(0, 4)))
        start, end = np.array(cuts[::2], np.int64), np.array(cuts[1::2], np.int64)
        got, whole, crossing = token_counts.allocate(lengths, start, end, rule)
        want, inside, touched = np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start))
        at = 0
        for size in lengths.tolist():
            share = [sum(s <= b < e for b in range(at, at + size)) for s, e in zip(start, end, strict=True)]
            for k, x in enumerate(share):
                inside[k] += x == size
                touched[k] += 0 < x < size
                if rule == "split":
                    want[k] += x / size
                elif rule == "start":
                    want[k] += bool(start[k] <= at < end[k])
            if rule == "majority" and any(share):
                want[int(np.argmax(share))] += 1
            at += size
        assert np.allclose(got, want) and (whole == inside).all() and (crossing == touched).all()
    with pytest.raises(ValueError):
        token_counts.allocate(lengths, start, end, "other")


def test_token_counts(spark, docs):
    path = tk.tokenizer_path("byte_bpe_50k.tiktoken")
    frame = spark.createDataFrame([*docs, (10**6, None), (10**6 + 1, "a\n\n\nb  \n\nç")], "doc_id long, text string")
    by = defaultdict(list)
    for r in token_counts.count_tokens(frame, path).orderBy("doc_id", "section").collect():
        by[r["doc_id"]].append(r)
    texts = dict([*docs, (10**6, ""), (10**6 + 1, "a\n\n\nb  \n\nç")])
    for key, text in texts.items():
        assert [text[r["start"] : r["end"]] for r in by[key]] == (text.splitlines(True) if "\r" not in text and not re.search("[\x0b\x0c\x1c-\x1e\x85  ]", text) and text else [text])
        assert sum(r["n_tokens"] for r in by[key]) == len(tk.byte_bpe(path).ids(text)) == by[key][0]["doc_tokens"]
    given = spark.createDataFrame([(1, "grüße aus köln", [(0, 5), (6, 9)]), (2, "x", None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    rows = token_counts.count_tokens(given, path, sections_col="parts").orderBy("section").collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in rows] == [(1, 0, 5), (1, 6, 9)]


def test_token_counts_of_odd_spans(spark):
    """Null, reversed, overlapping, unsorted and outlying spans, against the owner of each character."""
    path = tk.tokenizer_path("byte_bpe_50k.tiktoken")
    text = "one two three four, fünf und sechs"
    cases = {
        1: [(0, 4), (2, 5)],
        2: [(2, 5), (0, 4), None, (None, 3), (3, None)],
        3: [(9, 3), (0, 99), (-5, 2), (30, 40)],
        4: [(0, 10), (0, 10), (4, 6), (5, 5)],
        5: [],
        6: None,
        7: [(40, 50), None],
    }
    given = spark.createDataFrame([(k, text if k < 7 else None, v) for k, v in cases.items()], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    for rule in token_counts.RULES:
        by = defaultdict(dict)
        for r in token_counts.count_tokens(given, path, sections_col="parts", rule=rule).collect():
            by[r["doc_id"]][r["section"]] = r
        assert {k: len(v) for k, v in by.items()} == {k: len(v) for k, v in cases.items() if v}
        for key, spans in cases.items():
            own = text if key < 7 else ""
            owner = [None] * len(own)
            whole = [(k, s) for k, s in enumerate(spans or []) if s is not None and None not in s]
            for k, (a, b) in sorted(whole, key=lambda x: max(0, x[1][0])):
                for c in range(max(0, a), min(len(own), b)):
                    owner[c] = k if owner[c] is None else owner[c]
            for k, s in enumerate(spans or []):
                row = by[key][k]
                if s is None or None in s:
                    assert (row["start"], row["end"], row["n_tokens"], row["n_inside"], row["n_crossing"]) == (None, None, 0, 0, 0)
                else:
                    assert 0 <= row["start"] <= row["end"] <= len(own) and row["end"] - row["start"] == owner.count(k)
            total = sum(r["n_tokens"] for r in by[key].values())
            assert total <= len(tk.byte_bpe(path).ids(own))
            if key == 3 and rule != "start":
                assert total == len(tk.byte_bpe(path).ids(own))


# Decontamination


def test_contained_items(spark):
    rng = random.Random(9)
    names = [f"v{i}" for i in range(2000)]
    items = [rng.choices(names, k=n) for n in (1, 2, 4, 5, 6, 9, 17, 30, 31, 45, 64, 65, 120, 300)]
    texts = corpus(10, 30)
    for item in items:
        for keep in (1.0, 0.97, 0.9, 0.7, 0.5):
            w = [x if rng.random() < keep else "zzz" for x in item]
            filler = rng.choices(names, k=rng.randint(0, 3000))
            at = rng.randint(0, len(filler))
            texts.append(" ".join(filler[:at] + w + filler[at:]))
    half = items[9]
    texts.append(" ".join([*half[:22], *rng.choices(names, k=500), *half[18:]]))  # in two parts
    texts += ["", None, "..."]
    docs = list(enumerate(texts))
    want = {}
    for k, item in enumerate(items):
        size = min(5, len(item))
        own = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i, t in docs:
            w = words_of(t)
            have = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
            if len(own & have) >= 0.8 * len(own):
                want[i, k] = (len(own & have), len(own))
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "..")], "item_id long, text string")
    got = decontaminate.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), frame)
    assert {(r["doc_id"], r["item_id"]): (r["n_common"], r["n_item"]) for r in got.collect()} == want
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), frame)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_items_that_repeat_themselves_or_stand_apart(spark):
    rng = random.Random(3)
    names = [f"v{i}" for i in range(5000)]
    items, docs = [], []
    for places, distinct in ((65, 5), (130, 13), (257, 20), (33, 4), (70, 14)):
        for _ in range(12):
            items.append((rng.sample(names, distinct) * places)[: places + 4])
            filler = rng.choices(names, k=3000)
            at = rng.randint(0, 3000)
            docs.append(filler[:at] + items[-1] + filler[at:])
    items.append(rng.sample(names, 124))
    pieces = [items[-1][i : i + 12] + rng.choices(names, k=3000) for i in range(0, 120, 8)]
    docs += [sum(pieces, []), sum(pieces[:12] * 3, []), sum(pieces[:11] * 3, [])]  # 120, 96 and 88 of 120 shingles, 3000 words apart
    tables = [spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x)], f"{key} long, text string") for x, key in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r["doc_id"], r["item_id"]): r["n_common"] for r in decontaminate.find_contained(*tables).collect()}
    assert got == {(i, i): len(set(shingles_of(" ".join(items[i])))) for i in range(60)} | {(60, 60): 120, (61, 60): 96}


def test_items_in_blocks(spark, monkeypatch, docs):
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find_contained(frame, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 3000)
    shared = decontaminate.Items(items, "item_id", "text", 0.8)
    assert len(shared.parts) > 1
    for held in (decontaminate._HELD, 0):
        monkeypatch.setattr(decontaminate, "_HELD", held)
        rows = [r for lo, hi, found in shared.hits(pa.array([t for _, t in docs])) for r in found]
        assert len(rows) == len(whole)
    assert sorted(map(tuple, decontaminate.find_contained(frame, items).collect())) == whole and whole


def test_sketches_are_as_long_as_their_partition_needs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64)) for n in (1, 1, 4, 9, 10, 11, 40, 41, 300)]
    index = decontaminate.Index(5, list(range(len(sets))), sets, 0.8)
    sizes = index.sketch_sizes()
    assert sizes.tolist() == [1, 1, 1, 2, 3, 3, 9, 9, 61]
    listed = [set() for _ in sets]
    for shingle in range(len(index.lookup.keys)):
        for item in index.items[index.first[shingle] : index.first[shingle + 1]]:
            listed[item].add(shingle)
    for item, own in enumerate(listed):
        have = set(index.own[index.off[item] : index.off[item + 1]].tolist())
        assert own <= have and len(own) == min(sizes[item], len(have)) and len(have) - len(own) < index.need[item]


# Language ID


def test_code_lengths():
    settings = language.Settings(least=2)
    texts = {"aa": b"abracadabra abra cadabra", "bb": b"banana bandana anna"}
    which, keys, counts = [], [], []
    for i, t in enumerate(texts.values()):
        k, n = np.unique(language._ngrams(np.frombuffer(t, np.uint8), np.array([0, len(t)])), return_counts=True)
        which += [i] * len(k)
        keys += k.tolist()
        counts += n.tolist()
    model = language.Model.unpacked(*language.build(list(texts), np.array(which), np.array(keys, np.uint64), np.array(counts), settings))
    seen = [defaultdict(Counter) for _ in texts]
    for i, t in enumerate(texts.values()):
        for at, b in enumerate(t):
            for d in range(min(at, 3) + 1):
                seen[i][t[at - d : at]][b] += 1
    tree = {c for c in set().union(*seen) if all(max(s[c[k:]].total() for s in seen) >= 2 or not c[k:] for k in range(len(c) + 1))}

    def bits(i, context, b):
        after = 8.0 if not context else bits(i, context[1:], b)
        c = seen[i][context]
        if not c.total():
            return after
        if c[b]:
            return -math.log2(c[b] / (c.total() + len(c)))
        return -math.log2(len(c) / (c.total() + len(c))) + after

    test = [b"banal abracadabra", b"", b"zq", b"an"]
    data, off = tx.buffers(pa.array(test, pa.binary()))
    got = model.code_lengths(data, off)
    for row, t in zip(got, test, strict=True):
        for i in range(2):
            want = 0.0
            for at, b in enumerate(t):
                d = max(d for d in range(min(at, 3) + 1) if t[at - d : at] in tree or d == 0)
                want += bits(i, t[at - d : at], b)
            assert abs(row[i] - want) < 1e-3
    assert np.allclose(model._whole(np.frombuffer(test[0], np.uint8)), got[0])


def test_language_counts_whole_texts(spark):
    data = np.random.default_rng(3).integers(97, 101, language._PIECE + 5000).astype(np.uint8)
    frame = spark.createDataFrame([("x", data.tobytes().decode()), ("x", ""), ("x", None)], "lang string, text string")
    got = language.count(frame, "lang", "text", language.Settings()).toPandas()
    keys, n = np.unique(language._ngrams(data, np.array([0, len(data)])), return_counts=True)
    assert dict(zip(got["key"], got["n"], strict=True)) == dict(zip(keys.astype(np.int64).tolist(), n.tolist(), strict=True))


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    rows = []
    for i in range(261):  # the last has the fewest documents
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 5)
        rows += [(1000 * i + j, " ".join("".join(rng.choices(letters, k=4)) for _ in range(60)), f"l{i:03}") for j in range(1 if i == 260 else 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.train(frame)
    assert models.languages == sorted({r[2] for r in rows})
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame, models).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_packed_tables_are_small(spark):
    """A language's share of what is broadcast is under 2 MB (so 100 take less than 200), and it unpacks to what was built."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    models = language.train(docs)
    size = sum(x.nbytes for part in models.parts for x in part.value if isinstance(x, np.ndarray))
    assert size / len(models.languages) < 2e6
    dense = language.Model.unpacked(*models.parts[0].value)
    assert dense.cost.nbytes + dense.child.nbytes > 4 * size
    assert np.isfinite(dense.cost).all() and (dense.cost >= 0).all()


def test_contexts_of_a_language_with_little_text():
    def counted(text):
        return np.unique(language._ngrams(np.frombuffer(text, np.uint8), np.array([0, len(text)])), return_counts=True)

    (much, n), (few, m) = counted(b"abcd" * 300_000), counted(b"wxyz" * 5)
    model = language.Model.unpacked(*language.build(["a", "w"], np.repeat([0, 1], [len(much), len(few)]), np.concatenate([much, few]), np.concatenate([n, m]), language.Settings()))
    data = np.frombuffer(b"wxyzwxyz", np.uint8)
    assert (model.contexts(data, np.array([0, len(data)]))[3:] > 0).all()


def test_equal_codes_give_the_first_language_by_name():
    models = language.Models(["aa", "bb", "cc"], np.zeros(3), [])
    bits = np.array([[5.0, 5.0, 5.0], [9.0, 7.0, 7.0]])
    langs, share, _ = models.predict(bits, np.array([0, 2, 4]), np.array([True, True]))
    assert langs == ["aa", "bb"] and abs(share[0] - 1 / 3) < 1e-9 and abs(share[1] - 1 / 2.25) < 1e-9


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = random.Random(1)
    some = [r["text"] for r in docs.orderBy("doc_id").limit(30).collect()]
    bad = ["".join(rng.choices("абвгдежзиклмнопрст ", k=300)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(300)), "".join(rng.choices("ABCDEFGHQXZabcxyz0123456789+/", k=600)), "".join(rng.choices("QXZKWJ!#", k=500)), "12 ½", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*some, "É.", *bad])], "doc_id long, text string")
    kept = {r["doc_id"] for r in language.keep_identified(frame, language.train(docs)).collect()}
    assert kept == set(range(31))


def test_language_accuracy(spark):
    rows = language.op8_language_id(spark, SMALL.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    got = rows.join(truth, "doc_id").filter("held_out").selectExpr("avg(cast(lang = lang_pred AS int))", "min(score)", "max(score)").first()
    assert got[0] > 0.98 and 0 <= got[1] <= got[2] <= 1


# Quality


def test_statistics_by_hand():
    texts = ["Ab, cd!\nAb, cd!\nx y.", "", "ÉÉ 12", "one\n\n  two two"]
    data, off = tx.buffers(pa.array(texts))
    got = quality.statistics(data, off)
    at = {n: i for i, n in enumerate(quality.NAMES)}
    for row, t in zip(got, texts, strict=True):
        raw, w = t.encode(), [x.encode() for x in words_of(t)]
        size = max(len(raw), 1)
        assert abs(row[at["log_bytes"]] - math.log1p(len(raw))) < 1e-5
        assert abs(row[at["upper"]] - sum(65 <= b <= 90 for b in raw) / size) < 1e-5
        assert abs(row[at["wide"]] - sum(b >= 128 for b in raw) / size) < 1e-5
        assert abs(row[at["distinct_words"]] - len(set(w)) / max(len(w), 1)) < 1e-5
        assert abs(row[at["word_bytes"]] - (sum(map(len, w)) / len(w) if w else 0)) < 1e-5
        lines = [tuple(words_of(x)) for x in t.split("\n") if words_of(x)]
        assert abs(row[at["repeated_lines"]] - (1 - len(set(lines)) / len(lines) if lines else 0)) < 1e-5
    assert not got[1].any()


def test_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000], quality.Settings(trees=40, depth=3))
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for row in x[:20]:
        total = model.base
        for feature, limit, value in zip(model.feature, model.limit, model.value, strict=True):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + (2 if row[feature[at]] > limit[at] else 1)
            total += value[at]
        assert abs(total - model.raw(row[None])[0]) < 1e-6
    assert (quality.fit(x[:0], y[:0]).score(x[:3]) == 0.5).all()
    assert (quality.fit(x[:50], np.ones(50)).score(x[:3]) > 0.9).all()


def test_trees_against_a_plain_search():
    """One tree of depth 1 and 2 against all splits of the bins, by the same gain."""
    rng = np.random.default_rng(8)
    for depth in (1, 2):
        x = rng.integers(0, 12, (300, 3)).astype(np.float32)
        y = ((x[:, 1] > 6) ^ (rng.random(300) < 0.2)).astype(float)
        s = quality.Settings(trees=1, depth=depth, bins=64, leaf=20)
        model = quality.fit(x, y, s)
        p = (y.sum() + 1) / (len(y) + 2)
        grad, hess = p - y, np.full(len(y), p * (1 - p))

        def grow(rows, d, s=s, x=x, grad=grad, hess=hess, depth=depth):
            leaf = -s.rate * grad[rows].sum() / (hess[rows].sum() + s.shrink)
            if d == depth:
                return {i: leaf for i in rows}
            best = None
            for f in range(3):
                for limit in sorted(set(x[:, f]))[:-1]:
                    left = [i for i in rows if x[i, f] <= limit]
                    right = [i for i in rows if x[i, f] > limit]
                    if min(len(left), len(right)) < s.leaf:
                        continue
                    part = lambda r: grad[r].sum() ** 2 / (hess[r].sum() + s.shrink)
                    gain = part(left) + part(right) - part(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, left, right)
            if best is None:
                return {i: leaf for i in rows}
            return grow(best[1], d + 1) | grow(best[2], d + 1)

        want = grow(list(range(300)), 0)
        got = model.raw(x) - model.base
        assert np.allclose([want[i] for i in range(300)], got, atol=1e-6)


def test_a_score_of_exactly_the_limit_is_good(spark):
    none = np.zeros((0, 3), np.float32)
    trees = quality.Trees(1.0, 1, none.astype(np.int16), none, none)
    score = float(trees.score(np.zeros((1, len(quality.NAMES)), np.float32))[0])
    frame = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert quality.keep_good(frame, trees, least=score).count() == 2 and quality.keep_good(frame, trees, least=np.nextafter(score, 1)).count() == 0


def test_quality_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    rows = quality.op10_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


# Chats


@pytest.mark.parametrize("hot", [1024, 8])
def test_pairs_against_sql(spark, monkeypatch, hot):
    import duckdb

    monkeypatch.setattr(chat, "HOT", hot)

    rng = random.Random(12)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            text = rng.choice(["hi", "hello", "", None, "long\ntext é"]) if rng.random() < 0.7 else f"t{rng.random()}"
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]) if turn else "user", text))
    rows += [(200 + i, t, r, x) for i in range(60) for t, r, x in ((0, "user", "q"), (1, "assistant", "a"))] + rows[:3]
    rows += [(400 + i, t, r, x) for i, turns in enumerate(((("user", "a"), ("user", None), ("assistant", "yes")), (("user", "a"), ("user", ""), ("assistant", "no"), ("user", "why"), ("assistant", "so")), (("user", "a"), (None, None), ("assistant", "yes")))) for t, (r, x) in enumerate(turns)]
    rows[-2] = (402, 1, "user", "")
    rows += [(2000 + i, t, r, x) for i, (q, a) in enumerate((("q1", "same"), ("q2", "same"), ("q3", "other"), ("q4", None))) for t, r, x in ((0, "user", q), (1, "assistant", a), (2, "user", "bye"))]
    rows += [(9000, 0, "user", "nobody near"), (9000, 1, "assistant", "x"), (None, 0, "user", "x"), (300, None, "user", "no turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_pairs(chat.branch_pairs(frame)).toPandas()
    con = duckdb.connect()
    con.register("given", frame.toArrow())
    con.sql("CREATE VIEW conversations AS SELECT * FROM given")
    want = con.sql(chat.ORACLE).df()
    show = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert show(got) == show(want)
    plan = chat.format_pairs(chat.branch_pairs(frame))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert not len(got[got.rejected_id == 201]) and ((got.chosen != "") | (got.rejected != "")).all()  # equal conversations are no pair
    row = got[got.rejected_id == 401].iloc[0]
    assert (row["kind"], row["chosen_id"], row["n_prefix"]) == ("branch", 400, 2)
    assert (row["chosen"], row["rejected"]) == ("<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n<|assistant|>\nso<|end|>\n")
    assert (row["chosen_mask"], row["rejected_mask"]) == ("14:25", "14:24,58:68")
    assert not len(got[got.rejected_id == 402]) and set(got.kind) == {"branch", "swapped"}
    for mask, body in zip(got.chosen_mask, got.chosen, strict=True):
        for span in filter(None, mask.split(",")):
            a, b = map(int, span.split(":"))
            assert body[:a].endswith("<|assistant|>\n") and body[a:b].endswith("<|end|>\n")

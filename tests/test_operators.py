import hashlib
import io
import math
import random
import struct
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from blockwright import api, guards
from blockwright.functions import kernels as k
from blockwright.functions.codecs import Codec
from blockwright.operators import dictionary, stats
from blockwright.operators.blocks import adaptive_size, reassemble, to_blocks
from blockwright.operators.frames import decode_frames, roundtrip
from blockwright.operators.search import Search, best, candidate_table, candidates, choose, encode_blocks, transformed
from blockwright.sources import container, datasource

OBJECTS = [("a", b""), ("b", None), ("c", b"x"), ("d", bytes(range(256)) * 40), ("e", b"word " * 3000), ("f", struct.pack("<2000I", *range(5, 2005)))]


def objects(spark):
    return spark.createDataFrame(OBJECTS, "object_id string, data binary")


def back(df):
    return {r["object_id"]: bytes(r["data"]) for r in df.collect()}


WANT = {i: d or b"" for i, d in OBJECTS}


def test_blocks(spark):
    rows = to_blocks(objects(spark), 4096).collect()
    assert Counter(r["object_id"] for r in rows) == {i: max(1, -(-len(d) // 4096)) for i, d in WANT.items()}
    assert all(len(r["data"]) == r["orig_len"] for r in rows)
    assert back(reassemble(to_blocks(objects(spark), 100))) == WANT
    sizes = objects(spark).select(adaptive_size(F.lit(5 << 20)).alias("a"), adaptive_size(F.lit(100)).alias("b"), adaptive_size(F.lit(5 << 20), max_block=True).alias("c")).first()
    assert tuple(sizes) == (1 << 20, 100, 5 << 20)


@pytest.mark.parametrize("search", [Search(Codec("zlib", 6)), Search(Codec("zstd", 3), version=4), Search(Codec("lzma", 1), fast=True), Search(Codec("huffman"), tids=(0, 1, 19))])
def test_roundtrip(spark, search):
    assert back(roundtrip(objects(spark), search, 3000)) == WANT
    assert back(roundtrip(objects(spark), search, 3000, xor_previous=True)) == WANT


def test_payloads_differ_from_input(spark):
    frames = encode_blocks(to_blocks(objects(spark).filter("object_id = 'f'")), Search(Codec("zlib", 6))).collect()
    assert frames[0]["tid"] != 0 and frames[0]["comp_len"] < 1000


def test_search_rules():
    data = struct.pack("<500I", *range(1000, 1500))
    whole, quick = best(data, Search(Codec("zlib", 6))), best(data, Search(Codec("zlib", 6), fast=True))
    every = list(candidates(data, Search(Codec("zlib", 6))))
    assert whole.cost == min(x.cost for x in every) and whole.tid == min(x.tid for x in every if x.cost == whole.cost)
    assert quick.cost >= whole.cost
    assert {5, 12} & {x.tid for x in candidates(b"ab" * 2000, Search())} == set()
    assert {5, 12} <= {x.tid for x in candidates(b"ab" * 900, Search())}
    assert len(list(candidates(b"a" * 60000, Search(Codec("zstd", 3), version=4)))) == 1  # RAW is under 1 %


def test_choice_table(spark):
    blocks = to_blocks(objects(spark), 4096)
    search = Search(Codec("zlib", 6), tids=(0, 1, 7))
    won = {(r["object_id"], r["block_no"]): (r["tid"], r["cost"]) for r in choose(candidate_table(blocks, search)).collect()}
    direct = {(r["object_id"], r["block_no"]): (r["tid"], r["cost"]) for r in encode_blocks(blocks, search).collect()}
    assert won == direct


def test_limits_and_errors(spark):
    frames = encode_blocks(to_blocks(objects(spark), 4096), Search(Codec("zlib", 6)))
    with pytest.raises(Exception, match="declared in all"):
        decode_frames(frames, "zlib", max_total=100).collect()
    over = decode_frames(frames, "zlib", permissive=True, max_total=5000).filter("error_class IS NOT NULL").collect()
    assert {r["error_class"] for r in over} == {"OutputLimitError"} and {r["object_id"] for r in over} == {k for k, v in WANT.items() if len(v) > 5000}
    broken = frames.withColumn("orig_len", F.when(F.col("object_id") == "c", 50).otherwise(F.col("orig_len")))
    got = {r["object_id"]: r["error_class"] for r in decode_frames(broken, "zlib", permissive=True).filter("error_class IS NOT NULL").collect()}
    assert got == {"c": "FormatError"}
    with pytest.raises(PythonException, match="declares"):
        decode_frames(broken, "zlib").collect()


def test_plans_start_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        for linked in (False, True):
            roundtrip(objects(spark), Search(Codec("zlib", 6)), 4096, linked)
        decode_frames(encode_blocks(to_blocks(objects(spark), 4096)), "zlib", max_total=10)
        assert not tracker.getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_search_makes_no_transform_after_it_ends():
    made = []
    search = Search(Codec("zlib", 6), version=4)
    for t, *_ in transformed(b"a" * 50_000, search):
        made.append(t.tid)
        if len(made) == 2:
            break
    assert made == [0, 19]
    assert [c.tid for c in candidates(b"a" * 50_000, search)] == [0]


def test_errors_of_transforms_are_told(spark):
    k.register_transform(201, "FAULTY", lambda d, m: 1 / 0, lambda d, e: d, searched=False)
    try:
        search = Search(Codec("zlib", 6), tids=(0, 201), strict=False)
        one = spark.createDataFrame([(1, b"abc")], "object_id long, data binary")
        assert best(b"abc", search).tid == 0
        with pytest.raises(ZeroDivisionError):
            best(b"abc", Search(Codec("zlib", 6), tids=(0, 201)))
        skipped: list = []
        best(b"abc", search, skipped)
        assert skipped == ["FAULTY: ZeroDivisionError: division by zero"]
        assert encode_blocks(to_blocks(one), Search(Codec("zlib", 6))).first()["skipped"] == []
    finally:
        del k.REGISTRY[201]


def test_linked_blocks_after_a_bad_one(spark):
    data = hashlib.sha256(b"x").digest() * 40
    frames = encode_blocks(to_blocks(spark.createDataFrame([(1, data)], "object_id long, data binary"), 320), Search(Codec("zlib", 6), tids=(0,)), xor_previous=True)
    assert [r["tid"] for r in frames.orderBy("block_no").collect()] == [0, 99, 99, 99]
    broken = frames.withColumn("orig_len", F.when(F.col("block_no") == 1, 7).otherwise(F.col("orig_len")))
    got = {r["block_no"]: r["error_message"] for r in decode_frames(broken, "zlib", permissive=True).collect()}
    assert got[0] is None and "over 71 bytes" in got[1] and got[2] == got[3] == "the block before can't be decoded"


def test_ngrams_of_string_ids(spark):
    grams = stats.ngrams(spark.createDataFrame([("b", b"xyxyxy"), ("a", b"qxy"), (None, b"xyz")], "object_id string, data binary"), 2, 2, 1).collect()
    assert [(r["gram"], r["n"], r["first_object"], r["first_pos"]) for r in grams] == [("7879", 4, "a", 1)]


def test_api(spark):
    assert back(api.decode(api.encode(objects(spark), "object_id", "data", backend="zlib", level=1), "zlib")) == WANT
    text = spark.createDataFrame([(1, "grüß"), (2, None)], "id long, text string")
    assert back(api.decode(api.encode(text, "id", "text"))) == {1: "grüß".encode(), 2: b""}
    with pytest.raises(ValueError):
        api.encode(text, "id", "text", backend="brotli")


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.bin").write_bytes(WANT["e"])
    (tmp_path / "x/b.bin").write_bytes(b"")
    datasource.register(spark)
    got = spark.read.format("byteblocks").option("block_size", 1000).option("blocks_per_task", 4).load(str(tmp_path / "x"))
    assert got.rdd.getNumPartitions() == 5
    assert sorted(back(reassemble(got)).values(), key=len) == [b"", WANT["e"]]
    made = datasource.containers_of(objects(spark), Search(Codec("zstd", 3)), 4096)
    assert back(datasource.open_containers(made)) == WANT
    bad = spark.createDataFrame([("ok", container.compress(b"abc" * 500, block_size=500)), ("cut", container.compress(b"abc" * 500, block_size=500)[:-3]), ("no", b"zzzzzz")], "path string, content binary")
    rows = datasource.read_frames(bad).collect()
    assert Counter(r["object_id"] for r in rows if r["error"] is None) == {"ok": 3, "cut": 2}
    assert {r["object_id"]: r["error"].split(":")[0] for r in rows if r["error"]} == {"cut": "TruncatedError", "no": "FormatError"}
    decoded = decode_frames(datasource.read_frames(bad.filter("path = 'ok'")), "zstd")
    assert back(reassemble(decoded)) == {"ok": b"abc" * 500}
    datasource.write_frames(to_blocks(objects(spark), 4096), str(tmp_path / "frames"), Search(Codec("zstd", 3)))
    assert back(reassemble(decode_frames(spark.read.parquet(str(tmp_path / "frames")), "zstd"))) == WANT


def test_statistics(spark):
    rows = {r["object_id"]: r for r in stats.object_entropy(spark.createDataFrame([(1, b"abracadabra"), (2, b""), (3, b"aaaa")], "object_id long, data binary")).collect()}
    want = -sum(n / 11 * math.log2(n / 11) for n in Counter("abracadabra").values())
    assert rows[1]["micro_bits"] == round(want * 1e6) and rows[2]["micro_bits"] == rows[3]["micro_bits"] == 0
    grams = stats.ngrams(spark.createDataFrame([(1, b"abcabcabcabc"), (2, b"zzabc"), (3, b"q")], "object_id long, data binary"), 3, 2, 3).collect()
    assert [(bytes.fromhex(r["gram"]), r["n"], r["first_object"], r["first_pos"]) for r in grams] == [(b"abc", 5, 1, 0), (b"bca", 3, 1, 1), (b"cab", 3, 1, 2)]
    far = stats.ngrams(spark.createDataFrame([(1 << 40, b"abcabcabcabc"), (-2, b"zzabc"), (3, b"q")], "object_id long, data binary"), 3, 2, 2).collect()
    assert [(bytes.fromhex(r["gram"]), r["n"], r["first_object"], r["first_pos"]) for r in far] == [(b"abc", 5, -2, 2), (b"bca", 3, 1 << 40, 1)]
    with pytest.raises(ValueError):
        stats.ngrams(objects(spark), 9)


def slow_chunks(data, multiplier=191, most=1024):
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h * multiplier + b) % 2**32
        if (h % 4096 == 0 or i - start >= 8192) and i - start >= 1024:
            out.append((start, i + 1))
            start = i + 1
            if len(out) > most:
                break
    return out + [(start, len(data))] if start < len(data) else out


def test_chunks(spark):
    for seed in range(4):
        data = bytes(random.Random(seed).choices(range(4 if seed % 2 else 256), k=50_000))
        for options in ({}, {"multiplier": 31, "most": 256}, {"most": 2}):
            assert stats.chunk_bounds(data, **options) == slow_chunks(data, **options)
    df = spark.createDataFrame([(1, data), (2, b""), (3, data), (4, b"abc")], "object_id long, data binary")
    found = stats.chunks(df)
    dup = stats.duplicate_chunks(found).collect()
    assert {r["n"] for r in dup} == {2} and len(dup) == len(slow_chunks(data))
    entries = spark.createDataFrame([(dup[0]["sha256"], 0)], "sha256 string, entry int")
    assert stats.substitute_chunks(found, entries).filter("entry = 0").count() == 2


def test_dictionary(spark):
    rows = [(i, f"user {i} wrote a line about topic {i % 7} in the usual words of this log\n".encode() * 3) for i in range(2000)]
    pieces = dictionary.sample(to_blocks(spark.createDataFrame(rows, "object_id long, data binary")))
    trained = dictionary.train(pieces, 4096)
    assert trained and len(trained) <= 4096
    without, with_it, pays = dictionary.gate(pieces, trained, 3, 256)
    assert pays == (with_it < without)
    assert dictionary.train([b"x"]) == b""
    data = rows[5][1]
    codec = Codec("zstd", 3, dictionary=trained)
    from blockwright.functions.codecs import inflate

    assert inflate("zstd", codec.compress(data), len(data), trained) == data


def slow_grams(data, size, least):
    seen = Counter(data[i : i + size] for i in range(len(data) - size + 1))
    return sorted((g for g, n in seen.items() if n >= least), key=lambda g: (-seen[g], data.find(g)))


def test_ranked_grams():
    for seed in range(6):
        data = bytes(random.Random(seed).choices(b"abc", k=400))
        for size in (1, 3, 8):
            assert dictionary.ranked_grams(data, size, 2) == slow_grams(data, size, 2)
    assert dictionary.ranked_grams(b"ab", 3) == []


def log_lines(n, seed=1):
    rng = random.Random(seed)
    return b"".join(f'{{"time": {1600000000 + i}, "level": "{rng.choice(["INFO", "WARN"])}", "user": "u{rng.randint(1, 99)}", "message": "request handled in {rng.randint(1, 900)} ms"}}\n'.encode() for i in range(n))


def test_dictionaries_of_one_object():
    data = log_lines(9000)
    assert len(data) > 1 << 19
    for version in (3, 4):
        made = dictionary.dictionary_for(data, version, 3, force=True)
        assert 512 < len(made) <= (dictionary.STORED if version == 4 else dictionary.TARGET)
        assert dictionary.dictionary_for(b"short", version, 3, force=True) == b""
        packed = container.compress(data, 1, 4096, version=version, force_dict=True)
        assert container.decompress(packed) == data and container.Reader(io.BytesIO(packed)).header().dictionary == made
        payloads = [sum(len(f.payload) for _, f in container.frames(io.BytesIO(x))) for x in (packed, container.compress(data, 1, 4096, version=version))]
        assert version == 4 or payloads[0] < payloads[1]  # small blocks gain by a trained one; 8-grams may not help
        plain = container.compress(data, 1, 65536, version=version, use_dict=True)
        kept = container.Reader(io.BytesIO(plain)).header().dictionary
        pays = dictionary.shared_pays(data, made, 3) if version == 3 else dictionary.gathered_pays(data, made, 3)
        assert bool(kept) == pays and container.decompress(plain) == data
    noise = random.Random(2).randbytes(100_000)
    assert not dictionary.dictionary_for(noise, 3, 3) and not dictionary.dictionary_for(noise, 4, 3)
    assert dictionary.gathered(data, sample_bytes=1 << 12)[:8] in data
    large = log_lines(100, 3) * 1200
    assert len(large) > 8 << 20 and dictionary.gathered(large)
    with pytest.raises(ValueError):
        container.compress(data, backend="lzma", use_dict=True)
    chunks = [b"", b"abc", b"x" * 300]
    assert dictionary.unpack_chunks(dictionary.pack_chunks(chunks)) == chunks
    assert dictionary.unpack_chunks(dictionary.pack_chunks(chunks, 10)) == chunks[:2]
    with pytest.raises(guards.TruncatedError):
        dictionary.unpack_chunks(b"\0\5ab")


def test_version_4_in_full(spark):
    block = random.Random(1).randbytes(3000)
    data = block * 3 + bytes(x ^ 1 for x in block) + struct.pack("<900f", *(20 + i / 900 for i in range(900)))
    found = set()
    for backend in ("lzma", "zstd", "zlib", "huffman"):
        for options in ({"block_size": 3000, "xor_previous": True}, {"block_size": 3600}, {}, {"max_block": True}):
            made = container.compress(data, 4, backend=backend, version=4, **options)
            assert container.decompress(made) == data
            found |= {f.tid for _, f in container.frames(io.BytesIO(made))}
            if "block_size" not in options:
                assert container.Reader(io.BytesIO(made)).header().num_blocks == 1
    floats = struct.pack("<3000f", *(16 + random.Random(i).random() for i in range(3000)))
    made = container.compress(floats, 4, backend="lzma", version=4)
    found |= {f.tid for _, f in container.frames(io.BytesIO(made))}
    assert {k.XOR_PREV, k.BIT_PLANE} <= found and container.decompress(made) == floats
    with pytest.raises(ValueError):
        container.compress(data, version=3, xor_previous=True)
    rows = spark.createDataFrame([("a", data), ("b", b""), ("c", block)], "object_id string, data binary")
    want = {"a": data, "b": b"", "c": block}
    frames = api.encode(rows, "object_id", "data", "lzma", version=4)
    assert frames.count() == 3 and back(api.decode(frames, "lzma")) == want
    shared = dictionary.train([log_lines(20, s) for s in range(60)], 4096)
    frames = api.encode(rows, "object_id", "data", block_size=1000, dictionary=shared)
    assert back(api.decode(frames, dictionary=shared)) == want


def test_modelled_backends_of_frames(spark):
    data = log_lines(20)
    rows = spark.createDataFrame([("a", data), ("b", b""), ("c", b"abab" * 99)], "object_id string, data binary")
    for backend in ("grammar", "order1_huffman", "range"):
        search = Search(Codec(backend), tids=(0, 1, 19))
        frames = encode_blocks(to_blocks(rows, 1000), search)
        assert back(reassemble(decode_frames(frames, backend, linked=False))) == {"a": data, "b": b"", "c": b"abab" * 99}
        assert backend == "order1_huffman" or frames.agg(F.sum("comp_len")).first()[0] < len(data)  # its tables are long
        cut = frames.withColumn("payload", F.expr("substring(payload, 1, length(payload) - 3)")).filter("object_id = 'a'")
        assert {r["error_class"] for r in decode_frames(cut, backend, permissive=True, linked=False).collect()} <= {"TruncatedError", "FormatError"}
        with pytest.raises(ValueError, match="no id"):
            container.pack(data, search)


def test_shared_dictionary(spark):
    rows = spark.createDataFrame([(i, log_lines(30, i)) for i in range(200)], "object_id long, data binary")
    made = api.shared_dictionary(rows, "object_id", "data", 1, 4096)
    assert made
    size = lambda d: api.encode(rows, "object_id", "data", level=1, block_size=4096, dictionary=d).agg(F.sum("comp_len")).first()[0]
    assert size(made) < size(b"")
    noise = spark.createDataFrame([(i, random.Random(i).randbytes(9000)) for i in range(20)], "object_id long, data binary")
    assert api.shared_dictionary(noise, "object_id", "data") == b""


def test_arrow_codec(spark):
    codec = api.BlockCodec(1, 4096)
    data = log_lines(50)
    for given in (data, bytearray(data), pa.py_buffer(data)):
        assert codec.decompress(codec.compress(given)).to_pybytes() == data
    assert codec.decompress(codec.compress(data, asbytes=True), asbytes=True) == data
    with pytest.raises(guards.OutputLimitError):
        codec.decompress(codec.compress(data), 10)
    df = spark.createDataFrame([(1, data), (2, None), (3, b"")], "id long, data binary")
    there = df.select("id", api.packed(F.col("data"), 1).alias("data"))
    assert {r["id"]: r["data"] for r in there.select("id", api.unpacked(F.col("data")).alias("data")).collect()} == {1: data, 2: None, 3: b""}


def test_files_and_streams_of_containers(spark, tmp_path):
    datasource.register(spark)
    made = datasource.containers_of(objects(spark), Search(Codec("zstd", 3)), 4096)
    folder = tmp_path / "containers"
    made.write.format("blockcontainers").mode("append").save(str(folder))
    assert sorted(p.name for p in folder.iterdir()) == [f"{i}.blocks" for i in "abcdef"]
    files = spark.read.format("binaryFile").load(str(folder)).selectExpr("regexp_extract(path, '([^/]*)[.]blocks$', 1) AS object_id", "content")
    assert back(datasource.open_containers(files)) == WANT

    data = log_lines(300)
    whole = io.BytesIO()
    container.compress_stream(io.BytesIO(data), whole, 5000, level=3)
    whole = whole.getvalue()
    source, out, state = tmp_path / "stream", tmp_path / "out", tmp_path / "state"
    for n in (10, 3000, 3001, len(whole)):  # cut in the header, in a frame, and grown by a byte
        source.write_bytes(whole[:n])
        stream = spark.readStream.format("framestream").option("max_blocks_per_trigger", 3).load(str(source))
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    limited = spark.readStream.format("framestream").option("max_total", 9000).load(str(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "other")).start()
    with pytest.raises(Exception, match="declared in all"):
        limited.processAllAvailable()
    rows = spark.read.parquet(str(out)).orderBy("block_no").collect()
    assert [r["block_no"] for r in rows] == list(range(-(-len(data) // 5000))) and b"".join(bytes(r["data"]) for r in rows) == data


def test_streams_with_dictionaries():
    data = log_lines(4000)
    for size in (1000, 70_000):
        made, plain, out = io.BytesIO(), io.BytesIO(), io.BytesIO()
        container.compress_stream(io.BytesIO(data), made, size, level=3, use_dict=True)
        container.compress_stream(io.BytesIO(data), plain, size, level=3)
        assert container.Reader(io.BytesIO(made.getvalue())).header().dictionary
        assert [f.orig_len for _, f in container.frames(io.BytesIO(made.getvalue()))] == [f.orig_len for _, f in container.frames(io.BytesIO(plain.getvalue()))]
        assert container.decompress_stream(io.BytesIO(made.getvalue()), out) == len(data) and out.getvalue() == data
    with pytest.raises(ValueError):
        container.compress_stream(io.BytesIO(data), io.BytesIO(), backend="lzma", use_dict=True)


def test_streaming(spark, tmp_path):
    from blockwright.streaming.frames import read_blocks, write_stream

    spark.createDataFrame([(i, bytes([i]) * (i * 50)) for i in range(40)], "object_id long, data binary").repartition(4).write.parquet(str(tmp_path / "in"))
    search = Search(Codec("zlib", 6), tids=(0, 19))
    for _ in range(2):  # a second run finds nothing new: each row once
        stream = spark.readStream.schema("object_id long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), search, 500).awaitTermination()
    assert back(reassemble(read_blocks(spark, str(tmp_path / "out"), search))) == {i: bytes([i]) * (i * 50) for i in range(40)}


@pytest.mark.parametrize("layout", ["one part", "parts", "file", "file in a directory of its name", "by language", "no rows", "beside directories by a column"])
def test_stream_of_a_table_in_any_layout(spark, tmp_path, layout):
    from blockwright.plans.queries import QUERIES

    table = tmp_path / "documents.parquet"
    rows = spark.createDataFrame([(i, None if i == 3 else "text é " * (i * 200), "ab"[i % 2]) for i in range(0 if layout == "no rows" else 9)], "doc_id long, text string, lang string")
    one = layout in ("one part", "no rows", "file", "file in a directory of its name", "beside directories by a column")
    made = rows.coalesce(1).write if one else rows.repartition(3).write
    if layout == "by language":
        made = made.partitionBy("lang")
    if layout in ("one part", "parts", "by language", "no rows"):
        made.parquet(str(table))
    else:
        made.parquet(str(tmp_path / "made"))
        if layout == "file in a directory of its name":
            table.mkdir()
        next((tmp_path / "made").glob("*.parquet")).rename(table / table.name if table.is_dir() else table)
    if layout == "beside directories by a column":
        rows.write.partitionBy("lang").parquet(str(tmp_path / "labels.parquet"))
    got = {r["object_id"]: (r["n_bytes"], r["sha256"]) for r in QUERIES["stream_roundtrip"](spark, str(tmp_path)).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows.collect()}
    assert got == {i: (len(t), hashlib.sha256(t).hexdigest()) for i, t in texts.items()}


def test_previous_block_sha(spark):
    data = hashlib.sha256(b"x").digest() * 40
    one = spark.createDataFrame([(1, data), (2, data[:100])], "object_id long, data binary")
    frames = encode_blocks(to_blocks(one, 320), Search(Codec("zlib", 6), tids=(0,)), xor_previous=True)
    assert frames.filter(f"tid = {k.XOR_PREV}").count() == 3
    assert back(reassemble(decode_frames(frames, "zlib"))) == {1: data, 2: data[:100]}

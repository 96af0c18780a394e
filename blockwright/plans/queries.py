"""Queries by name, and the SQL for DuckDB that gives the same rows.

Each reads whole tables and whole texts.  Byte transforms run as kernels over Arrow batches, without any exchange;
the SQL forms of the oracles work on one row per byte instead, so the two share no code.
"""

from __future__ import annotations

import bz2
import hashlib
import math
import struct
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockwright import guards
from blockwright.functions import kernels
from blockwright.functions.batched import BATCHED
from blockwright.functions.codecs import FRAMES_ONLY, Codec, Huffman, native_level
from blockwright.functions.modelled import MODELLED
from blockwright.operators import dictionary, stats
from blockwright.operators.blocks import adaptive_size, csv_objects, pack_column, to_blocks
from blockwright.operators.frames import roundtrip
from blockwright.operators.search import Search, best, candidate_table, choose
from blockwright.plans.storage import fresh_path
from blockwright.sources import container
from blockwright.sources.datasource import containers_of, open_containers
from blockwright.streaming.frames import read_blocks, write_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "roundtrip_documents"
BLOCK = 4096

_I64, _STR = pa.int64(), pa.string()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.objects_of(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _digests(objects: DataFrame) -> DataFrame:
    return objects.select("object_id", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))


def _source_digests(table: str, key: str, column: str) -> str:
    return f"SELECT {key} AS object_id, octet_length(encode(coalesce({column}, '')))::BIGINT AS n_bytes, sha256(coalesce({column}, '')) AS sha256 FROM {table}"


# Round trips: what comes back has the digests of what went in.

_LIGHT = (0, 1, 2, 7, 19)


@query(_source_digests("documents", "doc_id", "text"))
def roundtrip_documents(spark, sf_dir):
    """Documents in blocks through five transforms and zlib, the cheapest kept, and back."""
    return _digests(roundtrip(_documents(spark, sf_dir), Search(Codec("zlib", 6), tids=_LIGHT), BLOCK))


@query(_source_digests("pages", "page_id", "html"))
def roundtrip_pages(spark, sf_dir):
    return _digests(roundtrip(stats.objects_of(_table(spark, sf_dir, "pages"), "page_id", "html"), Search(Codec("zstd", 3), version=4), BLOCK))


@query(_source_digests("conversations", "conv_id || ':' || turn", "text"))
def roundtrip_conversations(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return _digests(roundtrip(stats.objects_of(rows, "id", "text"), Search(Codec("zstd", 3), fast=True), BLOCK))


@query(_source_digests("documents", "doc_id", "text"))
def roundtrip_xor_previous(spark, sf_dir):
    """Blocks may be xored with the block before; decoding goes object by object."""
    return _digests(roundtrip(_documents(spark, sf_dir), Search(Codec("zlib", 6), tids=(0,)), 256, xor_previous=True))


_ALL = [t for t in kernels.REGISTRY]


@query(f"SELECT doc_id AS object_id, tid::BIGINT AS tid, sha256(coalesce(text, '')) AS sha256 FROM documents, (SELECT unnest({_ALL}) AS tid) WHERE tid NOT IN (5, 12) OR octet_length(encode(coalesce(text, ''))) <= {kernels.BWT_LIMIT}")
def roundtrip_every_transform(spark, sf_dir):
    def f(data: bytes) -> list[tuple]:
        memo, out = kernels.Memo(data), []
        for t in kernels.REGISTRY.values():
            if (got := t.encode(data, memo)) is not None:
                out.append((t.tid, hashlib.sha256(t.decode(*got)).hexdigest()))
        return out

    return stats.map_objects(_documents(spark, sf_dir), f, [("tid", "bigint", _I64), ("sha256", "string", _STR)])


@query("SELECT backend, object_id, n_bytes, sha256 FROM (" + _source_digests("documents", "doc_id", "text") + "), (SELECT unnest(['zlib', 'lzma', 'zstd', 'huffman']) AS backend)")
def roundtrip_every_backend(spark, sf_dir):
    out = None
    for backend, level in (("zlib", 6), ("lzma", 0), ("zstd", 3), ("huffman", 0)):
        one = _digests(roundtrip(_documents(spark, sf_dir), Search(Codec(backend, level), tids=(0, 1)), 65536)).select(F.lit(backend).alias("backend"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT codec, object_id, n_bytes, sha256 FROM (" + _source_digests("benchmark", "item_id", "text") + f"), (SELECT unnest({list(MODELLED)}) AS codec)")
def roundtrip_modelled(spark, sf_dir):
    """Benchmark items through order-1 Huffman codes, the range coder and pair grammars, and back."""

    def f(data: bytes) -> list[tuple]:
        back = [(name, decode(encode(data), len(data))) for name, (encode, decode) in MODELLED.items()]
        return [(name, len(b), hashlib.sha256(b).hexdigest()) for name, b in back]

    objects = stats.objects_of(_table(spark, sf_dir, "benchmark"), "item_id", "text")
    return stats.map_objects(objects, f, [("codec", "string", _STR), ("n_bytes", "bigint", _I64), ("sha256", "string", _STR)])


@query("SELECT backend, object_id, n_bytes, sha256 FROM (" + _source_digests("benchmark", "item_id", "text") + f"), (SELECT unnest({list(FRAMES_ONLY)}) AS backend)")
def roundtrip_modelled_frames(spark, sf_dir):
    """Benchmark items through the search of all transforms with the modelled codecs as backends, and back."""
    objects = stats.objects_of(_table(spark, sf_dir, "benchmark"), "item_id", "text")
    out = None
    for backend in FRAMES_ONLY:
        one = _digests(roundtrip(objects, Search(Codec(backend), fast=True), BLOCK)).select(F.lit(backend).alias("backend"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT codec, object_id, n_bytes, sha256 FROM (" + _source_digests("documents", "doc_id", "text") + f"), (SELECT unnest({list(MODELLED)}) AS codec)")
def roundtrip_modelled_documents(spark, sf_dir):
    """Whole documents, in blocks, through the codecs of roundtrip_modelled, and back."""

    def f(some: list[bytes]) -> list[list[tuple]]:
        rows: list[list[tuple]] = [[] for _ in some]
        for name, (encode, decode) in BATCHED.items():
            at = 0
            while at < len(some):  # objects of about 16 MB
                end, size = at + 1, len(some[at])
                while end < len(some) and size + len(some[end]) <= 4096 * BLOCK:
                    size, end = size + len(some[end]), end + 1
                parts = [data[i : i + BLOCK] for data in some[at:end] for i in range(0, len(data), BLOCK)]
                back = iter(decode(encode(parts), list(map(len, parts))))
                for i in range(at, end):
                    b = b"".join(islice(back, -(-len(some[i]) // BLOCK)))
                    rows[i].append((name, len(b), hashlib.sha256(b).hexdigest()))
                at = end
        return rows

    return stats.map_together(_documents(spark, sf_dir).repartition("object_id"), f, [("codec", "string", _STR), ("n_bytes", "bigint", _I64), ("sha256", "string", _STR)])


def _container(version: int, backend: str, level: int):
    def f(spark, sf_dir):
        search = Search(Codec(backend, level), version=version, fast=True)
        return _digests(open_containers(containers_of(_documents(spark, sf_dir), search, BLOCK, version, xor_previous=version == 4)))

    f.__name__ = f"roundtrip_container_v{version}"
    f.__doc__ = f"Each document as a container of version {version}, by the screened search of all its transforms, and back."
    return f


for _version, _backend, _level in ((1, "huffman", 0), (2, "zlib", 6), (3, "zstd", 3), (4, "lzma", 0)):
    query(_source_digests("documents", "doc_id", "text"))(_container(_version, _backend, _level))


@query("SELECT version, object_id, n_bytes, sha256 FROM (" + _source_digests("documents", "doc_id", "text") + "), (SELECT unnest([3, 4])::BIGINT AS version)")
def roundtrip_dictionary(spark, sf_dir):
    """Each document with a dictionary of its own, where it is long enough to make one and whether or not it pays, and back."""
    out = None
    for version in (3, 4):
        made = containers_of(_documents(spark, sf_dir), Search(Codec("zstd", 3), tids=_LIGHT, version=version), BLOCK, version, force_dict=True)
        one = _digests(open_containers(made)).select(F.lit(version).cast("long").alias("version"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(_source_digests("documents", "doc_id", "text"))
def stream_roundtrip(spark, sf_dir):
    """Documents as a file stream, encoded micro-batch by micro-batch into frames, then decoded."""
    table = f"{sf_dir}/documents.parquet"
    # a stream takes a plain path for a directory, whatever it holds; one file is found by a pattern
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    stream = spark.readStream.schema(_table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 4)
    rows = stream.parquet(f"{sf_dir}/documents.parque[t]" if single else table)
    search = Search(Codec("zstd", 3), fast=True)
    path = fresh_path(spark, "frames")
    write_stream(stats.objects_of(rows, "doc_id", "text"), path, fresh_path(spark, "state"), search, BLOCK).awaitTermination()
    from blockwright.operators.blocks import reassemble

    return _digests(reassemble(read_blocks(spark, path, search)))


@query("""WITH l AS (SELECT l_orderkey // 4096 AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')) || chr(10) AS line FROM lineitem),
o AS (SELECT id, string_agg(line, '' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, line) AS data FROM l GROUP BY id)
SELECT id AS object_id, octet_length(encode(data))::BIGINT AS n_bytes, sha256(data) AS sha256 FROM o""")
def roundtrip_csv(spark, sf_dir):
    """All rows of lineitem as lines of comma-separated values, in objects of 4096 order keys, through the screened search and back."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]
    objects = csv_objects(rows, columns, columns[:4], F.shiftright("l_orderkey", 12))
    return _digests(roundtrip(objects, Search(Codec("zstd", 3), fast=True), 65536))


# Blocks and transforms, byte by byte.

_BYTES = """d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
b AS (SELECT doc_id, len(h) AS n, unnest(generate_series(0, len(h) - 1)) AS pos, ('0x' || unnest(h))::INT AS v FROM d)"""


@query(f"""SELECT doc_id AS object_id, i AS block_no, least({BLOCK}, n - i * {BLOCK})::BIGINT AS orig_len
FROM (SELECT doc_id, n, unnest(generate_series(0, greatest((n + {BLOCK - 1}) // {BLOCK} - 1, 0))) AS i FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents))""")
def block_layout(spark, sf_dir):
    return to_blocks(_documents(spark, sf_dir), BLOCK).select("object_id", F.col("block_no").cast("long").alias("block_no"), F.col("orig_len").cast("long").alias("orig_len"))


def _digest_sql(y: str, order: str = "pos", ctes: str = "") -> str:
    """Digest of the bytes y, in order, of table y, made from b with v, its two predecessors p and q, pos and n."""
    return f"""WITH {_BYTES},
w AS (SELECT doc_id, n, pos, v, lag(v, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS p, lag(v, 2, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM b){ctes},
y AS (SELECT doc_id, {order} AS o, pos, {y} AS y FROM w)
SELECT d.doc_id AS object_id, count(y.y) AS n_out, sha256(coalesce(string_agg(printf('%02X', y.y), '' ORDER BY y.o, y.pos), '')) AS sha256
FROM d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id"""


def _transform(tid: int):
    def f(spark, sf_dir):
        def digest(data: bytes) -> list[tuple]:
            got = kernels.encode(tid, data)
            return [(len(got[0]), hashlib.sha256(got[0].hex().upper().encode()).hexdigest())] if got else []

        return stats.map_objects(_documents(spark, sf_dir), digest, [("n_out", "bigint", _I64), ("sha256", "string", _STR)])

    f.__name__ = f"transform_{kernels.REGISTRY[tid].name.lower()}"
    f.__doc__ = f"Length and digest of each document's bytes after transform {tid}."
    return f


_D1, _D2 = "((v - p + 256) % 256)", "((v - 2 * p + q + 512) % 256)"
_ZZ = "CASE WHEN {0} < 128 THEN 2 * {0} ELSE 511 - 2 * {0} END"


def _moved_sql(key: str) -> str:
    """y: move-to-front of the bytes v at pos of table b, by the number of symbols since a symbol's last place."""
    return f"""w AS (SELECT {key}, pos, v, lag(pos) OVER (PARTITION BY {key}, v ORDER BY pos) AS prev, lead(pos) OVER (PARTITION BY {key}, v ORDER BY pos) AS nxt FROM b),
g AS (SELECT {key}, pos, unnest(generate_series(prev + 1, pos - 1)) AS q FROM w WHERE prev IS NOT NULL AND prev + 1 < pos),
k AS (SELECT g.{key}, g.pos, count(*) AS y FROM g JOIN w ON w.{key} = g.{key} AND w.pos = g.q AND (w.nxt IS NULL OR w.nxt > g.pos) GROUP BY g.{key}, g.pos),
f AS (SELECT a.{key}, a.pos, a.v + count(o.pos) AS y FROM w a LEFT JOIN w o ON o.{key} = a.{key} AND o.prev IS NULL AND o.pos < a.pos AND o.v > a.v WHERE a.prev IS NULL GROUP BY a.{key}, a.pos, a.v),
y AS (SELECT w.{key}, w.pos, CASE WHEN prev IS NULL THEN f.y ELSE coalesce(k.y, 0) END::INT AS y FROM w LEFT JOIN k USING ({key}, pos) LEFT JOIN f USING ({key}, pos))"""


_EVERY = {
    1: _digest_sql(_D1),
    2: _digest_sql("xor(v, p)"),
    3: _digest_sql(f"CASE WHEN pos < 2 THEN {_D1} ELSE {_D2} END"),
    4: f"""WITH {_BYTES}, {_moved_sql("doc_id")}
SELECT d.doc_id AS object_id, count(y.y) AS n_out, sha256(coalesce(string_agg(printf('%02X', y.y), '' ORDER BY y.pos), '')) AS sha256 FROM d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id""",
    5: None,
    6: _digest_sql("v", "CASE WHEN n < 4 THEN 0 ELSE pos % 2 END"),
    7: _digest_sql("v", "CASE WHEN n < 8 THEN 0 ELSE pos % 4 END"),
    8: _digest_sql("v", "CASE WHEN n < 16 THEN 0 ELSE pos % 8 END"),
    9: _digest_sql(f"CASE WHEN pos < 1 THEN v ELSE {_ZZ.format(_D1)} END"),
    10: _digest_sql(f"CASE WHEN pos < 2 THEN {_D1} ELSE {_ZZ.format(_D2)} END"),
    11: _digest_sql(f"CASE WHEN pos < 2 THEN v ELSE {_D2} END"),
    12: None,
    13: _digest_sql("v", "CASE WHEN n < 8 OR n % 4 > 0 THEN 0 ELSE pos % 4 END"),
    14: f"""WITH {_BYTES},
y AS (SELECT a.doc_id, a.pos, sum(((o.v >> (a.pos % 8)::INT) & 1) << (o.pos % 8)::INT)::INT AS y
  FROM b a JOIN b o ON a.doc_id = o.doc_id AND a.pos // 8 = o.pos // 8 WHERE a.pos < a.n // 8 * 8 GROUP BY a.doc_id, a.pos
  UNION ALL SELECT doc_id, pos, v FROM b WHERE pos >= n // 8 * 8)
SELECT d.doc_id AS object_id, count(y.y) AS n_out, sha256(coalesce(string_agg(printf('%02X', y.y), '' ORDER BY y.pos), '')) AS sha256 FROM d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id""",
    15: f"""WITH {_BYTES},
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n < 8 THEN 0 ELSE pos % 4 END, pos) AS pos, v FROM b),
y AS (SELECT doc_id, pos, (v - lag(v, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) + 256) % 256 AS y FROM s)
SELECT d.doc_id AS object_id, count(y.y) AS n_out, sha256(coalesce(string_agg(printf('%02X', y.y), '' ORDER BY y.pos), '')) AS sha256 FROM d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id""",
    16: None,
    18: r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS line, unnest(x) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, line, regexp_extract_all(s, '[ \t\r\f\x0B]+|[^ \t\r\f\x0B]+') AS k FROM l),
t AS (SELECT doc_id, line, unnest(generate_series(1, len(k))) AS c, hex(encode(unnest(k))) AS x FROM k),
c AS (SELECT doc_id, c, string_agg(x, '0A' ORDER BY line) AS x FROM t GROUP BY doc_id, c),
cs AS (SELECT doc_id, string_agg(printf('%08X', (length(x) // 2)::INT), '' ORDER BY c) AS sizes, string_agg(x, '' ORDER BY c) AS body FROM c GROUP BY doc_id),
ls AS (SELECT doc_id, printf('%08X', count(*)::INT) || printf('%08X', max(len(k))::INT) AS head, string_agg(printf('%08X', len(k)::INT), '' ORDER BY line) AS counts FROM k GROUP BY doc_id),
y AS (SELECT doc_id, head || counts || coalesce(sizes, '') || coalesce(body, '') AS y FROM ls LEFT JOIN cs USING (doc_id))
SELECT doc_id AS object_id, (length(y) // 2)::BIGINT AS n_out, sha256(y) AS sha256 FROM y""",
    19: f"""WITH {_BYTES},
w AS (SELECT doc_id, pos, v, CASE WHEN v = lag(v) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM b),
r AS (SELECT doc_id, v, run, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM w) GROUP BY doc_id, v, run),
t AS (SELECT doc_id, run, v, n, unnest(generate_series(0, (n - 1) // 65535)) AS k FROM r)
SELECT d.doc_id AS object_id, 3 * count(t.v) AS n_out, sha256(coalesce(string_agg(printf('%02X%04X', t.v, least(65535, t.n - t.k * 65535)::INT), '' ORDER BY t.run, t.k), '')) AS sha256 FROM d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""",
}
for _tid, _sql in _EVERY.items():
    query(_sql)(_transform(_tid))


# Rotations are sorted as strings in SQL, so these take the short texts of benchmark; transform_bwt_* take all documents.

_ROTATED = _BYTES.replace("doc_id", "item_id").replace("documents", "benchmark").partition("\n")[0] + f"""
r AS (SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY substr(x || x, 2 * s + 1, 2 * len(h)), s) - 1 AS k, h[(s + len(h) - 1) % len(h) + 1] AS last
  FROM (SELECT item_id, h, array_to_string(h, '') AS x, unnest(generate_series(0, len(h) - 1)) AS s FROM d WHERE len(h) > 0)),
b AS (SELECT item_id, k AS pos, ('0x' || last)::INT AS v FROM r), {_moved_sql("item_id")},
u AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY item_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM y)),
z AS (SELECT item_id, run, CASE WHEN y > 0 THEN repeat(printf('%02X', y), n) ELSE repeat('00000000FF', n // 259) || CASE WHEN n % 259 < 4 THEN repeat('00', n % 259) ELSE '00000000' || printf('%02X', (n % 259 - 4)::INT) END END AS x
  FROM (SELECT item_id, run, y, count(*) AS n FROM u GROUP BY item_id, run, y)),
e AS (SELECT item_id, string_agg(x, '' ORDER BY run) AS x FROM z GROUP BY item_id)"""


def _rotated_sql(extra: str, hexed: str) -> str:
    """extra: the field's hexadecimal from the primary index p; hexed: the bytes', from tables y, z of the item."""
    return f"""WITH {_ROTATED},
o AS ({hexed})
SELECT d.item_id AS object_id, coalesce({extra}, '00000000') AS extra, coalesce(length(o.x) // 2, 0)::BIGINT AS n_out, sha256(coalesce(o.x, '')) AS sha256
FROM d LEFT JOIN o USING (item_id) LEFT JOIN r ON r.item_id = d.item_id AND r.s = 0"""


def _rotated(tid: int):
    def f(spark, sf_dir):
        def digest(data: bytes) -> list[tuple]:
            got, extra = kernels.encode(tid, data)
            return [(extra.hex().upper(), len(got), hashlib.sha256(got.hex().upper().encode()).hexdigest())]

        objects = stats.objects_of(_table(spark, sf_dir, "benchmark"), "item_id", "text")
        return stats.map_objects(objects, digest, [("extra", "string", _STR), ("n_out", "bigint", _I64), ("sha256", "string", _STR)])

    f.__name__ = f"benchmark_{kernels.REGISTRY[tid].name.lower()}"
    f.__doc__ = f"Extra field, length and digest of each benchmark item's bytes after transform {tid}."
    return f


_PRIMARY = "printf('%08X', r.k::INT)"
_PLAIN = "SELECT item_id, string_agg(printf('%02X', y), '' ORDER BY pos) AS x FROM y GROUP BY item_id"
for _tid, _hexed in ((5, _PLAIN), (12, "SELECT item_id, x FROM e"), (16, _PLAIN)):
    query(_rotated_sql(_PRIMARY, _hexed))(_rotated(_tid))


@query(_digest_sql("CASE WHEN pos < 4096 THEN v ELSE xor(v, before) END", ctes="").replace("FROM b)", ", lag(v, 4096, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b)"))
def transform_xor_previous(spark, sf_dir):
    """Digest of each document's blocks of 4096 bytes, each xored with the one before."""

    def digest(data: bytes) -> list[tuple]:
        parts = [data[i : i + 4096] for i in range(0, len(data), 4096)]
        out = b"".join(kernels.xor_previous(x, parts[i - 1] if i else None) for i, x in enumerate(parts))
        return [(len(out), hashlib.sha256(out.hex().upper().encode()).hexdigest())]

    return stats.map_objects(_documents(spark, sf_dir), digest, [("n_out", "bigint", _I64), ("sha256", "string", _STR)])


# Transforms of typed columns, with window functions inside blocks of rows: no block needs another's rows.


@query("""WITH t AS (SELECT event_id // 4096 AS block, event_id, epoch_us(ts) AS t FROM events),
a AS (SELECT block, event_id, t, t - lag(t) OVER (PARTITION BY block ORDER BY event_id) AS d FROM t),
b AS (SELECT block, d - lag(d) OVER (PARTITION BY block ORDER BY event_id) AS dd FROM a)
SELECT block, count(*) AS n_rows, count(dd) AS n_values, sum(CASE WHEN dd >= 0 THEN 2 * dd ELSE -2 * dd - 1 END)::BIGINT AS zigzag_sum, bit_xor(CASE WHEN dd >= 0 THEN 2 * dd ELSE -2 * dd - 1 END)::BIGINT AS zigzag_xor FROM b GROUP BY block""")
def column_delta2_zigzag(spark, sf_dir):
    """Second differences of event times, zigzag, per block of 4096 events."""
    w = W.partitionBy("block").orderBy("event_id")
    t = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4096).alias("block"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    d = t.withColumn("d", F.col("t") - F.lag("t").over(w)).withColumn("dd", F.col("d") - F.lag("d").over(w))
    z = F.when(F.col("dd") >= 0, 2 * F.col("dd")).otherwise(-2 * F.col("dd") - 1)
    return d.groupBy("block").agg(F.count("*").alias("n_rows"), F.count("dd").alias("n_values"), F.sum(z).alias("zigzag_sum"), F.bit_xor(z).alias("zigzag_xor"))


@query("""WITH t AS (SELECT l_orderkey // 1024 AS block, l_orderkey AS x, xor(l_orderkey, lag(l_orderkey, 1, 0) OVER (PARTITION BY l_orderkey // 1024 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS y FROM lineitem)
SELECT block, plane::BIGINT AS plane, count(*) AS n_rows, sum((x >> (8 * plane)::INT) & 255)::BIGINT AS sum_raw, sum((y >> (8 * plane)::INT) & 255)::BIGINT AS sum_xor, count(CASE WHEN (y >> (8 * plane)::INT) & 255 = 0 THEN 1 END) AS n_zero
FROM t, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS plane) GROUP BY block, plane""")
def column_byte_planes(spark, sf_dir):
    """Byte planes of order keys, as they are and xored with the key before, per block."""
    w = W.partitionBy("block").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    t = _table(spark, sf_dir, "lineitem").withColumn("block", F.floor(F.col("l_orderkey") / 1024))
    t = t.withColumn("y", F.col("l_orderkey").bitwiseXOR(F.lag("l_orderkey", 1, 0).over(w)))
    planes = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("plane"), F.shiftright("l_orderkey", 8 * k).bitwiseAND(F.lit(255)).alias("x"), F.shiftright("y", 8 * k).bitwiseAND(F.lit(255)).alias("y")) for k in range(8)]))
    return t.select("block", planes.alias("p")).groupBy("block", "p.plane").agg(F.count("*").alias("n_rows"), F.sum("p.x").alias("sum_raw"), F.sum("p.y").alias("sum_xor"), F.count(F.when(F.col("p.y") == 0, 1)).alias("n_zero"))


@query("""SELECT doc_id AS object_id, size AS block_size, count(*) AS n_blocks, sum(least(size, n - i * size))::BIGINT AS n_bytes
FROM (SELECT doc_id, n, size, unnest(generate_series(0, greatest((n + size - 1) // size - 1, 0))) AS i
  FROM (SELECT doc_id, n, CASE WHEN n <= 16384 THEN greatest(n, 1) ELSE 1024 END::BIGINT AS size FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)))
GROUP BY doc_id, size""")
def block_layout_adaptive(spark, sf_dir):
    """Blocks whose size goes by the object's length: one block up to 16 KiB, else blocks of 1 KiB (the container's limits are 4 and 1 MiB)."""
    size = adaptive_size(F.length("data"), 1024, 16384)
    blocks = to_blocks(_documents(spark, sf_dir).withColumn("object_id", F.struct("object_id", size.cast("long").alias("block_size"))), size)
    return blocks.groupBy("object_id.object_id", "object_id.block_size").agg(F.count("*").alias("n_blocks"), F.sum("orig_len").alias("n_bytes"))


# Statistics.


@query(f"WITH {_BYTES} SELECT doc_id AS object_id, v::BIGINT AS v, count(*) AS n FROM b GROUP BY doc_id, v")
def byte_histogram(spark, sf_dir):
    return stats.byte_counts(_documents(spark, sf_dir))


@query(f"""WITH {_BYTES},
h AS (SELECT doc_id, abs(-sum(n * 1.0::DOUBLE / t * log2(n * 1.0::DOUBLE / t))) AS h FROM (SELECT doc_id, v, count(*) AS n, any_value(n) AS t FROM b GROUP BY doc_id, v) GROUP BY doc_id)
SELECT d.doc_id AS object_id, len(d.h)::BIGINT AS n_bytes, round(coalesce(h.h, 0) * 1e6)::BIGINT AS micro_bits, round(coalesce(h.h, 0) * len(d.h) / 8)::BIGINT AS shannon_bytes FROM d LEFT JOIN h USING (doc_id)""")
def byte_entropy(spark, sf_dir):
    return stats.object_entropy(_documents(spark, sf_dir))


@query(f"""WITH {_BYTES},
w AS (SELECT doc_id, pos, CASE WHEN v = lag(v) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM b),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM w) GROUP BY doc_id, run)
SELECT d.doc_id AS object_id, count(r.n) AS n_runs, coalesce(max(r.n), 0)::BIGINT AS longest, coalesce(sum(3 * ((r.n + 65534) // 65535)), 0)::BIGINT AS rle_bytes FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def rle_runs(spark, sf_dir):
    return stats.run_sizes(_documents(spark, sf_dir))


@query(f"""WITH {_BYTES},
x AS (SELECT doc_id, pos, n, printf('%02X', v) AS x FROM b),
g AS (SELECT doc_id, pos, n, x || lead(x, 1) OVER w || lead(x, 2) OVER w || lead(x, 3) OVER w || lead(x, 4) OVER w || lead(x, 5) OVER w AS gram FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT gram, count(*) AS n, min(doc_id) AS first_object, (min(doc_id * 4294967296::HUGEINT + pos) % 4294967296)::BIGINT AS first_pos FROM g WHERE pos + 6 <= n GROUP BY gram HAVING count(*) >= 3 ORDER BY n DESC, first_object, first_pos, gram LIMIT 4096""")
def ngram_top(spark, sf_dir):
    """The 4096 commonest 6-byte grams of all documents."""
    return stats.ngrams(_documents(spark, sf_dir))


@query(f"WITH {_BYTES}, w AS (SELECT v, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM b) SELECT p::BIGINT AS before, v::BIGINT AS v, count(*) AS n FROM w WHERE p IS NOT NULL GROUP BY p, v")
def order1_contexts(spark, sf_dir):
    return stats.contexts(_documents(spark, sf_dir))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, list_filter(regexp_split_to_array(line, '[ \t\r]+'), lambda x: x <> '') AS k FROM l),
u AS (SELECT doc_id, unnest(generate_series(0, len(k) - 1)) AS column_no, unnest(k) AS token FROM t)
SELECT doc_id AS object_id, column_no, count(*) AS n_tokens, sum(length(token))::BIGINT AS n_chars FROM u GROUP BY doc_id, column_no""")
def token_columns(spark, sf_dir):
    return stats.record_columns(_table(spark, sf_dir, "documents"), "doc_id", "text")


_CHUNKS = f"""WITH RECURSIVE {_BYTES},
p AS (SELECT 0 AS i, 1 AS up, 1 AS down UNION ALL SELECT i + 1, up * 191 % 4096, down * 3903 % 4096 FROM p WHERE i < 63),
q AS (SELECT doc_id, pos, sum(v * down % 4096) OVER (PARTITION BY doc_id ORDER BY pos) % 4096 * up % 4096 AS low FROM b JOIN p ON pos % 64 = i),
cut AS (SELECT doc_id, list(pos ORDER BY pos) AS cuts FROM q WHERE low = 0 GROUP BY doc_id),
o AS (SELECT doc_id, len(h) AS n, array_to_string(h, '') AS hex, coalesce(cuts, []) AS cuts FROM d LEFT JOIN cut USING (doc_id)),
s AS (
  SELECT doc_id, 0 AS chunk_no, 0::BIGINT AS start, n, cuts, least(coalesce(list_filter(cuts, lambda x: x >= 1024)[1], n), 8192, n - 1) + 1 AS fin FROM o WHERE n > 0
  UNION ALL
  SELECT doc_id, chunk_no + 1, fin, n, cuts, CASE WHEN chunk_no + 1 > 1024 THEN n ELSE least(coalesce(list_filter(cuts, lambda x: x >= fin + 1024)[1], n), fin + 8192, n - 1) + 1 END FROM s WHERE fin < n),
c AS (SELECT doc_id AS object_id, chunk_no::INT AS chunk_no, start, fin - start AS size, sha256(unhex(substr(hex, 2 * start + 1, 2 * (fin - start)))) AS sha256 FROM s JOIN o USING (doc_id)),
u AS (SELECT sha256, size, count(*) AS n FROM c WHERE size >= 8 GROUP BY sha256, size HAVING count(*) > 1 ORDER BY n DESC, sha256 LIMIT 4096)"""


@query(f"{_CHUNKS} SELECT * FROM c")
def chunk_layout(spark, sf_dir):
    """Content-defined chunks of each document. After 1025 chunks the rest of a document is one (the rule's own limit)."""
    return stats.chunks(_documents(spark, sf_dir))


@query(f"{_CHUNKS} SELECT * FROM u")
def chunk_duplicates(spark, sf_dir):
    return stats.duplicate_chunks(stats.chunks(_documents(spark, sf_dir)))


@query(f"{_CHUNKS} SELECT c.object_id, count(*) AS n_chunks, count(u.n) AS n_known, coalesce(sum(CASE WHEN u.n > 0 THEN c.size END), 0)::BIGINT AS known_bytes FROM c LEFT JOIN u USING (sha256, size) GROUP BY c.object_id")
def chunk_substitution(spark, sf_dir):
    """Bytes that a dictionary of the commonest chunks would save, by document."""
    found = stats.chunks(_documents(spark, sf_dir))
    entries = stats.duplicate_chunks(found).select("sha256", F.row_number().over(W.orderBy(F.desc("n"), "sha256")).alias("entry"))  # at most 4096 rows
    return stats.substitute_chunks(found, F.broadcast(entries)).groupBy("object_id").agg(F.count("*").alias("n_chunks"), F.count("entry").alias("n_known"), F.coalesce(F.sum(F.when(F.col("entry").isNotNull(), F.col("size"))), F.lit(0)).cast("long").alias("known_bytes"))


# The search.

_PRICED = (0, 1, 2, 11)


def order_entropy_cost(data: bytes) -> int:
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(len(data), 1)
    return math.ceil(round(float(-(p * np.log2(p)).sum()) * len(data) / 8, 6)) + 1


def _packed_orders(spark, sf_dir) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return pack_column(orders, F.col("o_orderkey"), ["o_orderkey"], F.concat(F.lit("o"), F.floor(F.col("o_orderkey") / 1024)), 8)


def _priced_objects(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("object_id", F.concat(F.lit("d"), "object_id"))
    return docs.unionByName(_packed_orders(spark, sf_dir))


@query(f"""WITH {_BYTES},
o AS (SELECT 'o' || (o_orderkey // 1024) AS id, row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) - 1 AS i, o_orderkey AS x FROM orders),
a AS (SELECT 'd' || doc_id AS id, pos, v FROM b UNION ALL SELECT id, 8 * i + k AS pos, ((x >> (8 * k)::INT) & 255)::INT AS v FROM o, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k)
  UNION ALL SELECT 'p' || id, k * count(*) OVER (PARTITION BY id, k) + i AS pos, ((x >> (8 * k)::INT) & 255)::INT AS v FROM o, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k)),
c AS (SELECT id, pos // {BLOCK} AS block, pos % {BLOCK} AS pos, v FROM a),
w AS (SELECT *, lag(v, 1, 0) OVER (PARTITION BY id, block ORDER BY pos) AS p, lag(v, 2, 0) OVER (PARTITION BY id, block ORDER BY pos) AS q FROM c),
y AS (SELECT id, block, 0 AS tid, v AS y FROM w UNION ALL SELECT id, block, 1, {_D1} FROM w UNION ALL SELECT id, block, 2, xor(v, p) FROM w UNION ALL SELECT id, block, 11, CASE WHEN pos < 2 THEN v ELSE {_D2} END FROM w),
h AS (SELECT id, block, tid, y, count(*) AS n FROM y GROUP BY ALL),
e AS (SELECT id, block, tid, ceil(round(-sum(n * log2(n * 1.0::DOUBLE / t)) / 8, 6))::BIGINT + 1 AS cost FROM (SELECT *, sum(n) OVER (PARTITION BY id, block, tid) AS t FROM h) GROUP BY id, block, tid)
SELECT id AS object_id, block AS block_no, arg_min(tid, (cost, tid))::BIGINT AS tid, min(cost) AS cost FROM e GROUP BY id, block""")
def mdl_choice_entropy(spark, sf_dir):
    """The cheapest of four transforms by order-0 entropy, for blocks of documents, of packed order keys, and of their byte planes."""

    def f(data: bytes) -> list[tuple]:
        out = []
        for no, at in enumerate(range(0, len(data), BLOCK)):
            block = data[at : at + BLOCK]
            cost, tid = min((order_entropy_cost(kernels.encode(t, block)[0]), t) for t in _PRICED)
            out.append((no, tid, cost))
        return out

    keys = _packed_orders(spark, sf_dir)
    planes = stats.map_objects(keys, lambda data: [(kernels.shuffle(data, 8),)], [("data", "binary", pa.binary())])
    objects = _priced_objects(spark, sf_dir).unionByName(planes.withColumn("object_id", F.concat(F.lit("p"), "object_id")))
    return stats.map_objects(objects, f, [(n, "bigint", _I64) for n in ("block_no", "tid", "cost")])


@query(ORACLES["mdl_choice_entropy"].replace("SELECT id AS object_id, block AS block_no, arg_min", "SELECT tid, count(*) AS n_blocks, sum(cost)::BIGINT AS cost FROM (SELECT arg_min").replace("AS cost FROM e GROUP BY id, block", "AS cost FROM e GROUP BY id, block) GROUP BY tid"))
def choice_histogram_entropy(spark, sf_dir):
    """How often each of mdl_choice_entropy's transforms is the cheapest."""
    return mdl_choice_entropy(spark, sf_dir).groupBy("tid").agg(F.count("*").alias("n_blocks"), F.sum("cost").alias("cost"))


def _choice(codec: Codec, version: int):
    def f(spark, sf_dir):
        table = candidate_table(to_blocks(_priced_objects(spark, sf_dir), 65536), Search(codec, version=version))
        won = choose(table)
        return won.groupBy("tid", "name").agg(F.count("*").alias("n_blocks"), F.sum(F.col("cost").cast("long")).alias("cost"))

    f.__name__ = f"mdl_choice_{codec.backend}"
    f.__doc__ = f"How often each transform is the cheapest before {codec.backend}."
    return f


for _codec, _version in ((Codec("zlib", 6), 3), (Codec("zstd", 3), 4), (Codec("lzma", 0), 3), (Codec("huffman", 0), 3)):
    query()(_choice(_codec, _version))


@query()
def screen_misses(spark, sf_dir):
    """Blocks for which the fast screen's winner costs more than the whole search's, with the bytes lost."""

    def f(data: bytes) -> list[tuple]:
        out = []
        for no, at in enumerate(range(0, max(len(data), 1), 65536)):
            block = data[at : at + 65536]
            a, b = best(block, Search(Codec("zstd", 3))), best(block, Search(Codec("zstd", 3), fast=True))
            if b.cost > a.cost:
                out.append((no, a.name, b.name, b.cost - a.cost))
        return out

    return stats.map_objects(_priced_objects(spark, sf_dir), f, [("block_no", "bigint", _I64), ("best", "string", _STR), ("screened", "string", _STR), ("lost_bytes", "bigint", _I64)])


def _zstd_long(data: bytes) -> bytes:
    """Level 22 with matches over a window of 128 MiB."""
    wide = zstandard.ZstdCompressionParameters.from_level(22, window_log=27, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=wide).compress(data)


@query()
def codec_report(spark, sf_dir):
    """Bytes of all documents, each compressed on its own, by codec."""
    codecs = {"zlib-9": Codec("zlib", 9).compress, "xz-9": Codec("lzma", 9).compress, "zstd-19": Codec("zstd", 19).compress, "zstd-22": Codec("zstd", 22).compress, "zstd-22-long": _zstd_long, "bzip2-9": lambda d: bz2.compress(d, 9), "huffman": lambda d: b"\0" * 512 + Codec("huffman").compress(d)}

    def f(data: bytes) -> list[tuple]:
        return [(name, len(data), len(c(data))) for name, c in codecs.items()]

    rows = stats.map_objects(_documents(spark, sf_dir), f, [("codec", "string", _STR), ("raw", "bigint", _I64), ("packed", "bigint", _I64)])
    return rows.groupBy("codec").agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"))


@query(f"""WITH RECURSIVE {_BYTES},
c AS (SELECT doc_id, list(n ORDER BY n) AS w FROM (SELECT doc_id, v, count(*) AS n FROM b GROUP BY doc_id, v) GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN [0, w[1]] ELSE w END AS w, 0::BIGINT AS bits FROM c
  UNION ALL SELECT doc_id, list_sort(list_append(w[3:], w[1] + w[2])), bits + w[1] + w[2] FROM m WHERE len(w) > 1)
SELECT d.doc_id AS object_id, len(d.h)::BIGINT AS n_bytes, ((coalesce(max(bits), 0) + 7) // 8 + 512)::BIGINT AS huffman_bytes FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id, d.h""")
def huffman_sizes(spark, sf_dir):
    """Bytes of each document's order-0 Huffman code with its table, estimated from counts.

    The SQL sums the weights of merges, which is the least for counts that aren't scaled down to 16 bits.
    """

    def f(data: bytes) -> list[tuple]:
        n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        return [(len(data), Huffman.of(data).size(n))]

    return stats.map_objects(_documents(spark, sf_dir), f, [("n_bytes", "bigint", _I64), ("huffman_bytes", "bigint", _I64)])


@query(ORACLES["huffman_sizes"].replace("SELECT d.doc_id AS object_id", ", s AS (SELECT d.doc_id AS object_id").replace("GROUP BY d.doc_id, d.h", """GROUP BY d.doc_id, d.h),
h AS (SELECT doc_id, -sum(n * log2(n / t::DOUBLE)) / 8 AS shannon FROM (SELECT doc_id, v, count(*) AS n, any_value(n) AS t FROM b GROUP BY doc_id, v) GROUP BY doc_id)
SELECT object_id, round(huffman_bytes * 8000.0::DOUBLE / n_bytes)::BIGINT AS milli_bits_per_symbol, CASE WHEN shannon > 1e-9 THEN round((huffman_bytes - shannon) / shannon * 1000)::BIGINT ELSE -1 END AS milli_distance FROM s JOIN h ON doc_id = object_id"""))
def shannon_distance(spark, sf_dir):
    """Bits a byte of each document's Huffman code with its table, and how far that is over the entropy (-1: the entropy is 0)."""

    def f(data: bytes) -> list[tuple]:
        if not data:
            return []
        n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        size, p = Huffman.of(data).size(n), n[n > 0] / len(data)
        shannon = float(-(p * np.log2(p)).sum()) * len(data) / 8
        return [(round(size * 8000 / len(data)), round((size - shannon) / shannon * 1000) if shannon > 1e-9 else -1)]

    return stats.map_objects(_documents(spark, sf_dir), f, [("milli_bits_per_symbol", "bigint", _I64), ("milli_distance", "bigint", _I64)])


@query()
def dictionary_gate(spark, sf_dir):
    """Whether a zstd dictionary trained on a sample of blocks of all documents pays on the first 64 KiB of the sample, which is all that the rule prices."""
    pieces = dictionary.sample(to_blocks(_documents(spark, sf_dir), dictionary.PIECE))
    trained = dictionary.train(pieces)
    without, with_it, pays = dictionary.gate(pieces, trained, 19)
    return spark.createDataFrame([(len(trained), without, with_it, pays)], "dictionary_bytes long, without long, with_dictionary long, pays boolean")


# Id, name, most bytes made of one, rank in version 4, whether it is searched.
_LISTED = """(0, 'RAW', 1, 0, true), (1, 'DELTA', 1, 4, true), (2, 'XOR_DELTA', 1, 7, true), (3, 'DELTA2', 1, 8, true), (4, 'MTF', 1, 1004, true),
(5, 'BWT_MTF', 1, 2, true), (6, 'SHUFFLE_2', 1, 9, true), (7, 'SHUFFLE_4', 1, 5, true), (8, 'SHUFFLE_8', 1, 10, true), (9, 'DELTA_ZIGZAG', 1, 11, true),
(10, 'DELTA2_ZIGZAG', 1, 12, true), (11, 'ORDER2', 1, 13, true), (12, 'BWT_MTF_RLE', 2, 6, true), (13, 'FLOAT_SPLIT', 1, 14, true), (14, 'BIT_TRANSPOSE', 1, 15, true),
(15, 'SHUFFLE4_DELTA', 1, 16, true), (16, 'BWT_SUBBLOCK', 1, 3, true), (17, 'DICT_RESERVED', 1, 17, false), (18, 'RECORD_COLUMNS', 9, 1018, false), (19, 'RLE', 3, 1, true),
(99, 'XOR_PREV', 1, 1099, false), (100, 'BIT_PLANE', 1, 1100, false)"""


@query(f"SELECT * FROM (VALUES {_LISTED}) t(tid, name, expansion, rank, searched)")
def transform_registry(spark, sf_dir):
    """The transforms, as registered. Searches by version 4 and lzma try BIT_PLANE too, and XOR_PREV is an option."""
    return spark.createDataFrame([(r["tid"], r["name"], r["expansion"], r["rank"], r["searched"]) for r in kernels.listing()], "tid int, name string, expansion int, rank int, searched boolean")


@query(f"""WITH r AS (SELECT * FROM (VALUES {_LISTED}) t(tid, name, expansion, rank, searched)),
v AS (SELECT * FROM (SELECT unnest([2, 3, 4]) AS version), (SELECT unnest([0, 2048, 2049, 262144, 262145]) AS n))
SELECT version, n, tid, (row_number() OVER (PARTITION BY version, n ORDER BY CASE WHEN version = 4 THEN rank ELSE tid END) - 1)::INT AS place
FROM v, r WHERE searched AND NOT (tid = 5 AND n > CASE WHEN version = 4 THEN 262144 ELSE 2048 END) AND NOT (tid = 12 AND version > 2 AND n > CASE WHEN version = 4 THEN 262144 ELSE 2048 END)""")
def search_order(spark, sf_dir):
    """Transforms that a search tries on a block of n bytes, in the order of ties, by version."""
    rows = [(v, n, t.tid, i) for v in (2, 3, 4) for n in (0, 2048, 2049, 1 << 18, (1 << 18) + 1) for i, t in enumerate(Search(Codec("zstd"), version=v).order(n))]
    return spark.createDataFrame(rows, "version int, n int, tid int, place int")


# Native levels of the portable levels 1 to 4; others are clamped where the codec has a range.
@query("""WITH p AS (SELECT * FROM (VALUES ('zstd', [3, 6, 19, 22]), ('zlib', [1, 6, 9, 9]), ('lzma', [0, 3, 9, 9]), ('huffman', NULL)) t(backend, portable))
SELECT backend, level::INT AS level, CASE WHEN portable IS NOT NULL AND level BETWEEN 1 AND 4 THEN portable[level] WHEN backend IN ('zlib', 'lzma') THEN greatest(0, least(9, level)) ELSE level END::INT AS native
FROM p, (SELECT unnest(generate_series(-3, 23)) AS level)""")
def level_map(spark, sf_dir):
    """Native levels of each backend."""
    return spark.createDataFrame([(b, n, native_level(b, n)) for b in ("zstd", "zlib", "lzma", "huffman") for n in range(-3, 24)], "backend string, level int, native int")


def _hostile() -> list[tuple[str, bytes, int | None]]:
    """(what is wrong, container, most bytes allowed)."""
    zeros, head = Codec("zlib").compress(bytes(10_000_000)), struct.Struct(">BBII")

    def framed(orig_len: int, payload: bytes, tid: int = 0, extra: bytes = b"") -> bytes:
        return container.pack_header(container.Header(3, "zlib", 1, 65536)) + container.pack_frame(container.Frame(tid, extra, orig_len, payload), "zlib")

    good = container.compress(b"some text " * 500, 1, 1000, "zlib")
    return [
        ("block over the absolute limit", framed(2 << 30, zeros), None),
        ("blocks over the limit of blocks", container.MAGIC + head.pack(3, 1, 100_001, 1) + bytes(4), None),
        ("bytes after the last block", good + b"x", None),
        ("container cut in a frame", good[:-3], None),
        ("dictionary over its limit", container.MAGIC + head.pack(3, 3, 1, 65536) + struct.pack(">I", (1 << 20) + 1), None),
        ("good", good, 5000),
        ("length after decoding", framed(100, Codec("zlib").compress(b"a" * 95)), None),
        ("no mark", b"XXXX" + good[4:], None),
        ("payload cut", framed(100, Codec("zlib").compress(bytes(100))[:-6]), None),
        ("payload over its bound", framed(100, zeros), None),
        ("payload over its bound, runs", framed(100, zeros, 19), None),
        ("primary index outside the block", framed(3, Codec("zlib").compress(b"abc"), 5, struct.pack(">I", 9)), None),
        ("sub-block table", framed(3, Codec("zlib").compress(b"abc"), 16, struct.pack(">II", 1 << 25, 1) + bytes(4)), None),
        ("total over its ceiling", good, 4999),
        ("unknown backend", container.MAGIC + head.pack(3, 9, 1, 1) + bytes(4), None),
        ("unknown transform", framed(3, Codec("zlib").compress(b"abc"), 77), None),
        ("unknown version", container.MAGIC + head.pack(9, 1, 1, 1), None),
    ]


@query("""SELECT * FROM (VALUES ('block over the absolute limit', 'OutputLimitError'), ('blocks over the limit of blocks', 'FormatError'), ('bytes after the last block', 'FormatError'),
('container cut in a frame', 'TruncatedError'), ('dictionary over its limit', 'FormatError'), ('good', ''), ('length after decoding', 'FormatError'), ('no mark', 'FormatError'),
('payload cut', 'TruncatedError'), ('payload over its bound', 'OutputLimitError'), ('payload over its bound, runs', 'OutputLimitError'), ('primary index outside the block', 'FormatError'),
('sub-block table', 'FormatError'), ('total over its ceiling', 'OutputLimitError'), ('unknown backend', 'FormatError'), ('unknown transform', 'FormatError'), ('unknown version', 'FormatError')) t(what, error)""")
def guard_errors(spark, sf_dir):
    """The error that decoding ends with, for containers with something wrong."""
    rows = spark.createDataFrame([(what, data, most) for what, data, most in _hostile()], "what string, data binary, most long")

    def work(batches):
        for batch in batches:
            errors = []
            for data, most in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    container.decompress(data, most)
                    errors.append("")
                except guards.BlockError as e:
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, _STR)], names=["what", "error"])

    return rows.mapInArrow(work, "what string, error string")

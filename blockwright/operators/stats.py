"""Statistics of bytes: histograms, entropy, runs, n-grams, contexts, content-defined chunks, record columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions import kernels

MAX_CHUNK, MIN_CHUNK, CUT_MASK = 8192, 1024, 4095


def objects_of(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(object_id, data): a text's UTF-8 bytes; null: empty."""
    return df.select(F.col(id_col).alias("object_id"), F.coalesce(F.col(data_col).cast("binary"), F.lit("").cast("binary")).alias("data"))


def map_objects(objects: DataFrame, f: Callable[[bytes], list[tuple]], columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """f's rows for each object's bytes, with object_id before them. columns: (name, SQL type, Arrow type)."""
    return map_together(objects, lambda some: map(f, some), columns, 256)


def map_together(objects: DataFrame, f: Callable[[list[bytes]], Iterable[list[tuple]]], columns: list[tuple[str, str, pa.DataType]], most: int = 4096) -> DataFrame:
    """``map_objects`` of an f that takes at most so many objects at once, and gives a list of rows for each."""
    id_type = objects.schema["object_id"].dataType.simpleString()
    names = ["object_id", *(c[0] for c in columns)]

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                rows: list[tuple] = []
                some = batch.column(1)[lo : lo + most].to_pylist()
                for key, made in zip(batch.column(0)[lo : lo + most].to_pylist(), f(some), strict=True):
                    rows += [(key, *r) for r in made]
                if rows:
                    kinds = [batch.schema.field(0).type, *(c[2] for c in columns)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return objects.select("object_id", "data").mapInArrow(work, ", ".join([f"object_id {id_type}", *(f"{c[0]} {c[1]}" for c in columns)]))


def byte_counts(objects: DataFrame) -> DataFrame:
    """(object_id, v, n): times of each byte that an object has."""

    def f(data: bytes) -> list[tuple]:
        n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        return [(int(v), int(n[v])) for v in np.flatnonzero(n)]

    return map_objects(objects, f, [("v", "bigint", pa.int64()), ("n", "bigint", pa.int64())])


def entropy(n: Column, total: Column) -> Column:
    """Bits a byte from counts; an aggregate."""
    return -F.sum(n / total * F.log2(n / total))


def object_entropy(objects: DataFrame) -> DataFrame:
    """(object_id, n_bytes, micro_bits, shannon_bytes): entropy in millionths of a bit; an empty object has 0."""
    counts = byte_counts(objects)
    totals = objects.select("object_id", F.length("data").cast("long").alias("n_bytes"))
    sums = counts.join(totals, "object_id").groupBy("object_id").agg(entropy(F.col("n"), F.col("n_bytes")).alias("h"))
    h = F.abs(F.coalesce("h", F.lit(0.0)))
    return totals.join(sums, "object_id", "left").select("object_id", "n_bytes", F.round(h * 1e6).cast("long").alias("micro_bits"), F.round(h * F.col("n_bytes") / 8).cast("long").alias("shannon_bytes"))


def run_sizes(objects: DataFrame) -> DataFrame:
    """(object_id, n_runs, longest, rle_bytes)."""

    def f(data: bytes) -> list[tuple]:
        _, size = kernels.runs(data)
        return [(len(size), int(size.max()) if len(size) else 0, 3 * int((-(-size // 65535)).sum()))]

    return map_objects(objects, f, [(n, "bigint", pa.int64()) for n in ("n_runs", "longest", "rle_bytes")])


def ngrams(objects: DataFrame, size: int = 6, least: int = 3, top: int = 4096) -> DataFrame:
    """(gram, n, first_object, first_pos): the top n-grams by count, of equal counts by first place.

    Counts are merged in each task before they are exchanged; size is 1 to 8 bytes; gram is hexadecimal.  Ids may be
    numbers or strings, and are compared as such.
    """
    if not 1 <= size <= 8:
        raise ValueError("n-grams have 1 to 8 bytes")
    kind = "string" if objects.schema["object_id"].dataType.simpleString() == "string" else "bigint"
    objects = objects.filter(F.col("object_id").isNotNull())
    packed = False  # whether an object and a place in it are one number, which hash aggregation takes
    if kind == "bigint":
        ends = objects.agg(F.min("object_id").alias("lo"), F.max("object_id").alias("hi")).first()
        packed = ends["lo"] is None or 0 <= ends["lo"] and ends["hi"] < 1 << 31

    def f(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            held.sort(key=lambda x: x[0])
            keys = np.concatenate([x[1] for x in held])
            sizes = [len(x[1]) for x in held]
            owner = np.repeat(np.arange(len(held)), sizes)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(keys, kind="stable")  # so the first of equal ones is of the first object
            keys = keys[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            first = order[at]
            names = pa.array([x[0] for x in held], pa.string() if kind == "string" else pa.int64()).take(pa.array(owner[first]))
            held.clear()
            place = [pa.array(names.to_numpy() << 32 | pos[first])] if packed else [names, pa.array(pos[first])]
            return pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(np.diff(np.append(at, len(keys)))), *place], names=["k", "n", *(["first"] if packed else ["o", "p"])])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) < size:
                    continue
                x = np.frombuffer(data, np.uint8).astype(np.uint64)
                m = len(x) - size + 1
                g = np.zeros(m, np.uint64)
                for j in range(size):
                    g = g << np.uint64(8) | x[j : j + m]
                held.append((key, g))
                n += m
                if n > 1 << 22:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    rows = objects.select(F.col("object_id").cast(kind), "data").mapInArrow(f, "k bigint, n bigint, first bigint" if packed else f"k bigint, n bigint, o {kind}, p bigint")
    first = F.col("first") if packed else F.struct("o", "p")
    total = rows.groupBy("k").agg(F.sum("n").alias("n"), F.min(first).alias("first")).filter(F.col("n") >= least)
    best = total.orderBy(F.desc("n"), "first", F.hex("k")).limit(top)
    o, p = (F.shiftright("first", 32), F.col("first").bitwiseAND(F.lit((1 << 32) - 1))) if packed else (F.col("first.o"), F.col("first.p"))
    return best.select(F.lpad(F.hex("k"), 2 * size, "0").alias("gram"), "n", o.alias("first_object"), p.alias("first_pos")).orderBy(F.desc("n"), "first_object", "first_pos", "gram")


def contexts(objects: DataFrame) -> DataFrame:
    """(before, v, n): times of each byte after each, over all objects; a first byte has no byte before."""

    def f(batches):
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for data in batch.column(1).to_pylist():
                x = np.frombuffer(data, np.uint8).astype(np.int64)
                if len(x) > 1:
                    total += np.bincount(x[:-1] << 8 | x[1:], minlength=65536)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at >> 8), pa.array(at & 255), pa.array(total[at])], names=["before", "v", "n"])

    return objects.select("object_id", "data").mapInArrow(f, "before bigint, v bigint, n bigint").groupBy("before", "v").agg(F.sum("n").alias("n"))


def chunk_bounds(data: bytes, multiplier: int = 191, most: int = 1024, least: int = MIN_CHUNK, limit: int = MAX_CHUNK) -> list[tuple[int, int]]:
    """(start, end) of content-defined chunks.

    h = h * multiplier + byte, never reset; a chunk ends with the first byte that is at least ``least`` past its first, and
    where the low 12 bits of h are 0 or that is ``limit`` past.  After more than ``most`` chunks the rest is one.  As only the low 12 bits
    count, h at a place is a sum over the bytes of a window: odd multipliers have powers of a short period mod 4096.
    """
    n = len(data)
    if not n:
        return []
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    if multiplier % 2:
        inverse = pow(multiplier, -1, 4096)
        power = [1]
        back = [1]
        while True:
            power.append(power[-1] * multiplier % 4096)
            back.append(back[-1] * inverse % 4096)
            if power[-1] == 1:
                break
        period = len(power) - 1
        at = np.arange(n) % period
        total = np.cumsum(x * np.array(back[:period])[at] % 4096)
        low = total % 4096 * np.array(power[:period])[at] % 4096
    else:
        low = np.zeros(n, np.int64)
        h = 0
        for i, b in enumerate(data):
            h = (h * multiplier + b) % 4096
            low[i] = h
    cuts = np.flatnonzero(low == 0)
    out, start = [], 0
    while start < n and len(out) <= most:
        k = int(np.searchsorted(cuts, start + least))
        last = min(int(cuts[k]) if k < len(cuts) else n, start + max(least, limit))
        if last >= n:
            break
        out.append((start, last + 1))
        start = last + 1
    return [*out, (start, n)] if start < n else out


def chunks(objects: DataFrame, **options: int) -> DataFrame:
    """(object_id, chunk_no, start, size, sha256) of content-defined chunks."""

    def f(data: bytes) -> list[tuple]:
        return [(i, a, b - a, hashlib.sha256(data[a:b]).hexdigest()) for i, (a, b) in enumerate(chunk_bounds(data, **options))]

    return map_objects(objects, f, [("chunk_no", "int", pa.int32()), ("start", "bigint", pa.int64()), ("size", "bigint", pa.int64()), ("sha256", "string", pa.string())])


def duplicate_chunks(found: DataFrame, top: int = 4096, least: int = 8) -> DataFrame:
    """(sha256, size, n): the chunks that come most often, of equal counts by hash."""
    return found.filter(F.col("size") >= least).groupBy("sha256", "size").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "sha256").limit(top)


def substitute_chunks(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Chunks with the number of their entry in a dictionary of (sha256, entry), null for those it lacks; a join, no escapes."""
    return found.join(dictionary.select("sha256", "entry"), "sha256", "left")


def record_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(object_id, column_no, n_tokens, n_chars): pieces between white space of each line, by their place in the line."""
    lines = df.select(F.col(id_col).alias("object_id"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    tokens = lines.select("object_id", F.posexplode(F.filter(F.split("line", "[ \\t\\r]+"), lambda t: t != "")).alias("column_no", "token"))
    return tokens.groupBy("object_id", F.col("column_no").cast("long").alias("column_no")).agg(F.count("*").alias("n_tokens"), F.sum(F.length("token")).cast("long").alias("n_chars"))

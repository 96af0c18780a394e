"""The search for each block's cheapest transform, priced by a codec; ties go to the smaller rank."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.functions import kernels as k
from blockwright.functions.codecs import Codec, Huffman


@dataclass(frozen=True)
class Search:
    """codec: prices and makes payloads; tids: transforms (default: all that are searched); version: 3 or 4 sets gates and ties;
    fast: a cheap codec screens all, and the best 4 and RAW are encoded; stop_below: with version 4, a cost below this
    share of the block ends the search, and later transforms aren't made; strict: errors of a transform are raised, else the
    transform is left out, and a frame's ``skipped`` says which."""

    codec: Codec = field(default_factory=Codec)
    tids: tuple[int, ...] = ()
    version: int = 3
    fast: bool = False
    stop_below: float = 0.01
    strict: bool = True

    def order(self, n: int) -> list[k.Transform]:
        """Transforms that apply to a block of n bytes, in the order of ties."""
        chosen = [k.REGISTRY[t] for t in self.tids] if self.tids else [t for t in k.REGISTRY.values() if t.searched]
        if not self.tids and self.version >= 4 and self.codec.backend == "lzma":
            chosen.append(k.REGISTRY[k.BIT_PLANE])
        limit = 2048 if self.version < 4 else k.BWT_LIMIT
        gated = {5, 12} if self.version != 2 else {5}
        chosen = [t for t in chosen if self.tids or t.tid not in gated or n <= limit]
        return sorted(chosen, key=lambda t: (t.rank, t.tid) if self.version >= 4 else t.tid)


@dataclass
class Candidate:
    tid: int
    name: str
    extra: bytes
    transformed: bytes
    payload: bytes
    cost: int


def transformed(data: bytes, search: Search, skipped: list[str] | None = None) -> Iterator[tuple[k.Transform, bytes, bytes]]:
    """(transform, bytes, extra) of all that apply, made one by one; skipped: takes the errors of those that are left out."""
    memo = k.Memo(data)
    for t in search.order(len(data)):
        try:
            got = t.encode(data, memo)
        except Exception as e:
            if search.strict:
                raise
            if skipped is not None:
                skipped.append(f"{t.name}: {type(e).__name__}: {e}")
            continue
        if got is not None and len(got[1]) <= 255:
            yield t, *got


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _screened(made: list[tuple[k.Transform, bytes, bytes]]) -> list[tuple[k.Transform, bytes, bytes]]:
    """The four that a cheap codec finds cheapest, and RAW."""
    screen, seen, price = Codec("zstd", 1), {}, []
    for _, x, e in made:
        key = _digest(x)
        if key not in seen:
            seen[key] = len(screen.compress(x))
        price.append(seen[key] + 1 + len(e))
    best = sorted(range(len(made)), key=lambda i: (price[i], i))[:4]
    return [m for i, m in enumerate(made) if i in best or m[0].tid == 0]


def candidates(data: bytes, search: Search, skipped: list[str] | None = None) -> Iterator[Candidate]:
    """All that are encoded, in order. Equal transformed bytes are encoded once."""
    made = transformed(data, search, skipped)
    payloads: dict[bytes, bytes] = {}
    least = None
    for t, x, extra in _screened(list(made)) if search.fast else made:
        key = _digest(x)
        if key not in payloads:
            payloads[key] = search.codec.compress(x)
        got = Candidate(t.tid, t.name, extra, x, payloads[key], search.codec.cost(payloads[key], extra, search.version))
        yield got
        if least is None or got.cost < least:
            least = got.cost
            if search.version >= 4 and least < search.stop_below * len(data):
                return


def best(data: bytes, search: Search, skipped: list[str] | None = None) -> Candidate:
    found = None
    for c in candidates(data, search, skipped):
        if found is None or c.cost < found.cost:
            found = c
    if found is None:
        raise ValueError("no transform applies; RAW should be among them")
    return found


def xored(data: bytes, before: bytes, search: Search) -> Candidate:
    """The block xored with the one before, plain: transform 99."""
    x = k.xor_previous(data, before)
    extra = b"XORP" + len(before).to_bytes(4, "big")
    payload = search.codec.compress(x)
    return Candidate(k.XOR_PREV, "XOR_PREV", extra, x, payload, search.codec.cost(payload, extra, search.version))


_FRAME = "object_id {id}, block_no int, tid int, name string, extra binary, orig_len int, transformed_len int, comp_len int, cost int, padding int, counts array<int>, payload binary, skipped array<string>"


def _huffman_parts(codec: Codec, x: bytes) -> tuple[int | None, list | None]:
    if codec.backend != "huffman":
        return None, None
    h = Huffman.of(x)
    return h.encode(x)[1], [int(c) for c in h.counts]


def encode_blocks(blocks: DataFrame, search: Search = Search(), xor_previous: bool = False) -> DataFrame:
    """Frames: each block's winner, and only its payload leaves the worker.

    Blocks are dealt out by object and number first, so that a large object or file doesn't stay in one task:
    a search reads a few MB a second and core, an exchange costs next to nothing beside it.
    xor_previous: also tries the block xored with the one before (found by a join on its number, so that no
    task needs a whole object), plain, as transform 99.
    """
    id_type = blocks.schema["object_id"].dataType.simpleString()
    rows = blocks.select("object_id", "block_no", "data")
    if xor_previous:
        before = rows.select("object_id", (F.col("block_no") + 1).alias("block_no"), F.col("data").alias("previous"))
        rows = rows.join(before, ["object_id", "block_no"], "left")
    else:
        rows = rows.repartition("object_id", "block_no")
    schema = _FRAME.format(id=id_type)
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out: list[tuple] = []
                for i, data in enumerate(part.column(2).to_pylist()):
                    skipped: list[str] = []
                    got = best(data, search, skipped)
                    before = part.column(3)[i].as_py() if xor_previous else None
                    if before and (other := xored(data, before, search)).cost < got.cost:
                        got = other
                    padding, counts = _huffman_parts(search.codec, got.transformed)
                    out.append((got.tid, got.name, got.extra, len(data), len(got.transformed), len(got.payload), got.cost, padding, counts, got.payload, skipped))
                kinds = [pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    return rows.mapInArrow(work, schema)


def candidate_table(blocks: DataFrame, search: Search = Search()) -> DataFrame:
    """One row per block and candidate, with its cost; payloads stay in the worker."""
    id_type = blocks.schema["object_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, no, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(key, no, c.tid, c.name, c.extra, len(c.transformed), len(c.payload), c.cost) for c in candidates(data, search)]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["object_id", "block_no", "tid", "name", "extra", "transformed_len", "payload_len", "cost"])

    return blocks.select("object_id", "block_no", "data").repartition("object_id", "block_no").mapInArrow(work, f"object_id {id_type}, block_no int, tid int, name string, extra binary, transformed_len int, payload_len int, cost int")


def choose(table: DataFrame, rank: str = "tid") -> DataFrame:
    """The cheapest candidate of each block."""
    return table.groupBy("object_id", "block_no").agg(F.min_by(F.struct("tid", "name", "payload_len", "cost"), F.struct("cost", rank)).alias("x")).select("object_id", "block_no", "x.*")


def choice_histogram(frames: DataFrame) -> DataFrame:
    return frames.groupBy("name").agg(F.count("*").alias("n_blocks"))

"""Frames back to blocks and objects, under limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwright import guards
from blockwright.functions import codecs, kernels
from blockwright.operators.blocks import reassemble, to_blocks
from blockwright.operators.search import Search, encode_blocks


def decode_frame(backend: str, tid: int, extra: bytes, orig_len: int, payload: bytes, transformed_len: int | None = None, counts: list[int] | None = None, padding: int = 0, dictionary: bytes = b"", previous: bytes | None = None) -> bytes:
    """One block. Its declared length is checked before anything is made, and its real one after."""
    guards.check_declared(orig_len)
    if tid != kernels.XOR_PREV and tid not in kernels.REGISTRY:
        raise guards.FormatError(f"transform {tid} is unknown")
    if len(extra) > 255:
        raise guards.FormatError("the extra field is over 255 bytes")
    bound = guards.payload_bound(orig_len, 1 if tid == kernels.XOR_PREV else kernels.REGISTRY[tid].expansion)
    if backend == "huffman":
        import numpy as np

        n = orig_len if transformed_len is None else transformed_len
        if n > bound:
            raise guards.OutputLimitError(f"{n} symbols are declared; the bound is {bound}")
        data = codecs.Huffman(np.array(counts or [0] * 256)).decode(payload, n, padding)
    else:
        data = codecs.inflate(backend, payload, bound, dictionary)
    if tid == kernels.XOR_PREV:
        if extra[:4] != b"XORP":
            raise guards.FormatError("previous-block extra field")
        out = kernels.xor_previous(data, previous)
    else:
        try:
            out = kernels.decode(tid, data, extra)
        except (IndexError, OverflowError) as e:
            raise guards.FormatError(f"transform {tid}: {e}") from e
    if len(out) != orig_len:
        raise guards.FormatError(f"a block of {len(out)} bytes declares {orig_len}")
    return out


_COLUMNS = ("object_id", "block_no", "tid", "extra", "orig_len", "transformed_len", "padding", "counts", "payload")


def decode_frames(frames: DataFrame, backend: str, dictionary: bytes = b"", permissive: bool = False, max_total: int | None = None, linked: bool = True) -> DataFrame:
    """(object_id, block_no, data, error_class, error_message) of frames. Starts no job, and reads frames once.

    Payloads are decoded where they are.  linked: frames may refer to the block before (transform 99); then blocks are
    dealt out by object, and those that do are xored in order.  False saves that exchange where no such frame is.
    permissive: errors go to the last two columns, else they end the query; a block that refers to one that can't be
    decoded can't be either.  max_total: most bytes an object may declare in its blocks up to each one, checked before
    that one is decoded.
    """
    id_type = frames.schema["object_id"].dataType.simpleString()
    rows = frames.select(*_COLUMNS)
    if max_total is not None:
        before = W.partitionBy("object_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("total", F.sum(F.col("orig_len").cast("long")).over(before))
    schema = f"object_id {id_type}, block_no int, data binary, error_class string, error_message string"

    def error(e: guards.BlockError) -> tuple:
        if not permissive:
            raise e
        return None, type(e).__name__, str(e)

    def one(row: dict) -> tuple:
        try:
            guards.check_total(row.get("total", 0), max_total)
            return decode_frame(backend, row["tid"], row["extra"] or b"", row["orig_len"], row["payload"], row["transformed_len"], row["counts"], row["padding"] or 0, dictionary), None, None
        except guards.BlockError as e:
            return error(e)

    def batch_of(keys: pa.Array, nos: pa.Array, out: list[tuple], **more: pa.Array) -> pa.RecordBatch:
        made = (pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string(), pa.string()), strict=True))
        return pa.RecordBatch.from_arrays([keys, nos, *made, *more.values()], names=["object_id", "block_no", "data", "error_class", "error_message", *more])

    def alone(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                more = {"tid": part.column(2)} if linked else {}
                yield batch_of(part.column(0), part.column(1), [one(r) for r in part.to_pylist()], **more)

    def in_order(batches):
        key, previous = None, None  # of the object at hand: its block before; False if that can't be decoded
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, out = batch.slice(lo, 64), []
                for r in part.to_pylist():
                    if r["object_id"] != key:
                        key, previous = r["object_id"], None
                    got = (r["data"], r["error_class"], r["error_message"])
                    if r["tid"] == kernels.XOR_PREV and got[0] is not None:
                        got = error(guards.FormatError("the block before can't be decoded")) if previous is False else (kernels.xor_previous(got[0], previous), None, None)
                    out.append(got)
                    previous = False if got[0] is None else got[0]
                yield batch_of(part.column(0), part.column(1), out)

    if not linked:
        return rows.mapInArrow(alone, schema)
    return rows.mapInArrow(alone, schema + ", tid int").repartition("object_id").sortWithinPartitions("object_id", "block_no").mapInArrow(in_order, schema)


def roundtrip(objects: DataFrame, search: Search = Search(), block_size: int = 4096, xor_previous: bool = False) -> DataFrame:
    """(object_id, data): objects through blocks, search, payloads, decoding and reassembly."""
    frames = encode_blocks(to_blocks(objects, block_size), search, xor_previous)
    return reassemble(decode_frames(frames, search.codec.backend, search.codec.dictionary, linked=xor_previous))

"""Spark sources and sinks: containers through DataFrames and as files, stream containers, and byte ranges of large files."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import replace
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from blockwright import guards
from blockwright.functions import codecs, kernels
from blockwright.operators.dictionary import dictionary_for
from blockwright.operators.search import Search, encode_blocks
from blockwright.sources import container as c

FRAMES = "object_id string, block_no int, version int, backend string, block_size bigint, tid int, extra binary, orig_len int, transformed_len int, comp_len int, padding int, counts array<int>, payload binary, dictionary binary, error string"


def read_frames(containers: DataFrame, id_col: str = "path", data_col: str = "content", permissive: bool = True) -> DataFrame:
    """One row per frame of containers held in a binary column (as ``binaryFile`` reads them, from any file system).

    A damaged container gives the frames before the damage, then a row with the error; or, not permissive, an error.
    """

    def work(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, blank = [], dict.fromkeys(x.split()[0] for x in FRAMES.split(", "))
                try:
                    for i, (h, f) in enumerate(c.frames(io.BytesIO(data or b""))):
                        rows.append(blank | dict(object_id=str(key), block_no=i, version=h.version, backend=h.backend, block_size=h.block_size, tid=f.tid, extra=f.extra, orig_len=f.orig_len, comp_len=len(f.payload), padding=f.padding, counts=f.counts, payload=f.payload, dictionary=h.dictionary))
                except guards.BlockError as e:
                    if not permissive:
                        raise
                    rows.append(blank | dict(object_id=str(key), block_no=len(rows), error=f"{type(e).__name__}: {e}"))
                kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FRAMES.split(", ")]))

    return containers.select(id_col, data_col).mapInArrow(work, FRAMES)


def containers_of(objects: DataFrame, search: Search = Search(), block_size: int | None = None, version: int = 3, use_dict: bool = False, force_dict: bool = False, **options: bool) -> DataFrame:
    """(object_id, content): each object's container, made whole in one task; for objects that fit there.

    use_dict, force_dict: a dictionary for each object (see ``container.compress``); options: those of ``container.pack``.
    """
    id_type = objects.schema["object_id"].dataType.simpleString()

    def packed(data: bytes) -> bytes:
        own = search
        if use_dict or force_dict:
            own = replace(search, codec=replace(search.codec, dictionary=dictionary_for(data, version, search.codec.level, force_dict)))
        return c.pack(data, own, block_size, version, **options)

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                made = [packed(data) for data in batch.column(1)[lo : lo + 16].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 16], pa.array(made, pa.binary())], names=["object_id", "content"])

    return objects.select("object_id", F.coalesce("data", F.lit("").cast("binary")).alias("data")).mapInArrow(work, f"object_id {id_type}, content binary")


def open_containers(containers: DataFrame, id_col: str = "object_id", data_col: str = "content", max_total: int | None = None) -> DataFrame:
    """(object_id, data) of whole containers."""
    id_type = containers.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                made = [c.decompress(d, max_total) for d in batch.column(1)[lo : lo + 16].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 16], pa.array(made, pa.binary())], names=["object_id", "data"])

    return containers.select(id_col, data_col).mapInArrow(work, f"object_id {id_type}, data binary")


def write_frames(blocks: DataFrame, path: str, search: Search = Search(), **options: bool) -> None:
    """Frames as Parquet, by object and block: the primary storage, pruned by object and transform."""
    encode_blocks(blocks, search, **options).withColumn("backend", F.lit(search.codec.backend)).write.parquet(path)


def _opened(path: str):
    """(file system, path there) of a path or URI, whatever holds it (local files, HDFS, object stores)."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


class _Range(InputPartition):
    def __init__(self, path: str, name: str, start: int, size: int, block: int) -> None:
        super().__init__((name, start))
        self.path, self.name, self.start, self.size, self.block = path, name, start, size, block


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.block = int(options.get("block_size", 65536))
        self.per_task = int(options.get("blocks_per_task", 256))

    def partitions(self) -> list[_Range]:
        system, at = _opened(self.path)
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File), key=lambda f: f.path)
        step = self.block * self.per_task
        return [_Range(self.path, f.path, s, min(step, f.size - s), self.block) for f in files for s in range(0, max(f.size, 1), step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = _opened(partition.path)
        with system.open_input_file(partition.name) as f:
            f.seek(partition.start)
            left, no = partition.size, partition.start // partition.block
            while left > 0 or partition.size == 0:
                data = f.read(min(partition.block, left))
                yield partition.name, no, len(data), data
                left, no = left - len(data), no + 1
                if not data:
                    return


class ByteBlocks(DataSource):
    """``spark.read.format("byteblocks").option("block_size", n).load(path)``: blocks of a file or a folder's files.

    The path or URI may be of any file system that Arrow opens and all executors reach.  A task reads a range of
    blocks, so a file of any size is read in parallel and never whole.
    """

    @classmethod
    def name(cls) -> str:
        return "byteblocks"

    def schema(self) -> str:
        return "object_id string, block_no int, orig_len int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.names = names


class _ContainerWriter(DataSourceWriter):
    """Each row's container becomes a file when the job commits; until then it has a name of its own."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> _Written:
        system, at = _opened(self.path)
        system.create_dir(at)
        names = []
        for row in iterator:
            name = quote(str(row["object_id"]), safe="")
            made = f"{at}/_{name}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(made) as f:
                f.write(bytes(row["content"]))
            names.append((made, f"{at}/{name}.blocks"))
        return _Written(names)

    def commit(self, messages) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            for made, name in m.names if m else []:
                system.move(made, name)

    def abort(self, messages) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            for made, _ in m.names if m else []:
                system.delete_file(made)


class Containers(DataSource):
    """``df.write.format("blockcontainers").mode("append").save(path)``: one file for each row (object_id, content).

    ``containers_of`` makes such rows; ``binaryFile`` and ``read_frames`` read the files back.  Ids name the files, so
    they must differ: of rows that share one, one file is left.
    """

    @classmethod
    def name(cls) -> str:
        return "blockcontainers"

    def schema(self) -> str:
        return "object_id string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ContainerWriter(self.options["path"])


_STREAMED = "block_no bigint, version int, backend string, tid int, orig_len int, comp_len int, data binary"


class _StreamReader(SimpleDataSourceStreamReader):
    """Frames of a growing stream container; an offset is a byte, the number of blocks before it and the bytes they declare."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = int(options.get("max_blocks_per_trigger", 1024))
        self.max_total = int(options["max_total"]) if "max_total" in options else None

    def initialOffset(self) -> dict:
        return {"at": 0, "no": 0, "total": 0}

    def _from(self, start: dict, end: int | None) -> tuple[list, dict]:
        system, at = _opened(self.path)
        rows, now, no, total = [], start["at"], start["no"], start["total"]
        if system.get_file_info(at).type != fs.FileType.File:
            return rows, start
        with system.open_input_file(at) as f:
            reader = c.Reader(f)
            try:
                h = reader.header()
                now = max(now, f.tell())
                f.seek(now)
                while (end is None and len(rows) < self.most or end is not None and now < end) and (frame := reader.frame(h)):
                    if frame.tid == kernels.XOR_PREV:
                        raise guards.FormatError("streams hold no blocks that refer to the one before")
                    guards.check_total(total + frame.orig_len, self.max_total)
                    rows.append((no, h.version, h.backend, frame.tid, frame.orig_len, len(frame.payload), c.decode_one(h, frame)))
                    now, no, total = f.tell(), no + 1, total + frame.orig_len
            except guards.TruncatedError:  # its end isn't written yet
                pass
        return rows, {"at": now, "no": no, "total": total}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._from(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._from(start, end["at"])[0])


class FrameStream(DataSource):
    """``spark.readStream.format("framestream").load(path)``: decoded blocks of a stream container that may still grow.

    A frame whose end isn't there yet waits for a later batch; damage, or blocks that declare more than the option
    ``max_total`` in all, end the query.
    """

    @classmethod
    def name(cls) -> str:
        return "framestream"

    def schema(self) -> str:
        return _STREAMED

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (ByteBlocks, Containers, FrameStream):
        spark.dataSource.register(source)


def backend_id(name: str) -> int:
    if name not in codecs.BACKENDS:
        raise ValueError(f"backend {name!r}")
    return codecs.BACKENDS[name]

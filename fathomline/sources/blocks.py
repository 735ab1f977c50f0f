"""Blocks of vectors in their big-endian binary layout, as a Spark data source (`embblock`) and a writer.

A block file holds: u64 block, u32 count, then for each row u64 id, string filepath, u32 count of tags and the tags, a byte
that tells whether a subset follows (u64 start, u64 end), and the vector's f32 values without a length. Strings are a u32
length and UTF-8 bytes. The dimension isn't in the file; it is an option. An index file holds u32 size, u32 count of layers,
and of each layer u32 count of nodes with u64 id, u32 degree and (u64 id, f32 distance) pairs.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathomline.functions.vectors import normalise
from fathomline.schemas import EDGES, VECTORS
from fathomline.sources.files import file_system

#: Vectors of a block.
BLOCK_ROWS = 1024


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, kind: str) -> int | float:
        size = struct.calcsize(">" + kind)
        value = struct.unpack_from(">" + kind, self.data, self.at)[0]
        self.at += size
        return value

    def text(self) -> str:
        n = self.take("I")
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def floats(self, n: int) -> list[float]:
        self.at += 4 * n
        return np.frombuffer(self.data, ">f4", n, self.at - 4 * n).astype(np.float32).tolist()


def decode_block(data: bytes, dim: int) -> Iterator[tuple]:
    """Rows (id, filepath, meta, subset, block, data) of a block file."""
    c = _Cursor(data)
    block = c.take("Q")
    for _ in range(c.take("I")):
        i, path = c.take("Q"), c.text()
        meta = sorted(c.text() for _ in range(c.take("I")))
        subset = Row(start=c.take("Q"), end=c.take("Q")) if c.take("B") else None
        yield i, path, meta, subset, block, c.floats(dim)


def _text(s: str) -> bytes:
    b = s.encode()
    return struct.pack(">I", len(b)) + b


def encode_block(block: int, rows: list) -> bytes:
    out = [struct.pack(">QI", block, len(rows))]
    for r in rows:
        out.append(struct.pack(">Q", r["id"]) + _text(r["filepath"] or ""))
        meta = r["meta"] if r["meta"] is not None else []
        out.append(struct.pack(">I", len(meta)) + b"".join(map(_text, meta)))
        s = r["subset"]
        out.append(b"\0" if s is None else struct.pack(">BQQ", 1, s["start"], s["end"]))
        out.append(np.asarray(r["data"], ">f4").tobytes())
    return b"".join(out)


def decode_index(data: bytes) -> Iterator[tuple[int, int, int, float]]:
    """(layer, src, dst, dist) of an index file; an empty one is an error."""
    c = _Cursor(data)
    if len(data) <= 4:
        raise ValueError("empty index file")
    c.take("I")
    for layer in range(c.take("I")):
        for _ in range(c.take("I")):
            src = c.take("Q")
            for _ in range(c.take("I")):
                yield layer, src, c.take("Q"), c.take("f")


def encode_index(size: int, layers: list[dict[int, list[tuple[int, float]]]]) -> bytes:
    out = [struct.pack(">II", size, len(layers))]
    for layer in layers:
        out.append(struct.pack(">I", len(layer)))
        for src, edges in layer.items():
            out.append(struct.pack(">QI", src, len(edges)) + b"".join(struct.pack(">Qf", d, w) for d, w in edges))
    return b"".join(out)


class BlockDataSource(DataSource):
    """`spark.read.format("embblock").option("dim", 1536).load(folder)`: one task for each file with a numeric name. The option
    `file` adds a column of that name with the file's path. Any file system that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return "embblock"

    def schema(self) -> str:
        return VECTORS + (", file string" if self.options.get("file") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options["path"], int(self.options.get("dim", 1536)), self.options.get("blocks"), self.options.get("file") == "true")


class _BlockReader(DataSourceReader):
    def __init__(self, path: str, dim: int, blocks: str | None, with_file: bool) -> None:
        self.path, self.dim, self.with_file = path, dim, with_file
        self.only = {b.strip() for b in blocks.split(",")} if blocks else None

    def partitions(self) -> list[InputPartition]:
        fs, folder = file_system(self.path)
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(folder)) if i.base_name.isdigit() and (self.only is None or i.base_name in self.only)]
        return [InputPartition(n) for n in sorted(names, key=int)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, folder = file_system(self.path)
        with fs.open_input_stream(f"{folder}/{partition.value}") as f:
            for row in decode_block(f.read(), self.dim):
                yield (*row, f"{folder}/{partition.value}") if self.with_file else row


def read_blocks(spark: SparkSession, folder: str, dim: int, blocks: list[int] | None = None, unit: bool = False, with_file: bool = False) -> DataFrame:
    """Vectors of all block files of a folder, or of some; unit: with vectors of length 1; with_file: and the file's path."""
    spark.dataSource.register(BlockDataSource)
    reader = spark.read.format("embblock").option("dim", dim).option("file", "true" if with_file else "false")
    if blocks is not None:
        reader = reader.option("blocks", ",".join(map(str, blocks)) or "none")
    df = reader.load(folder)
    return df.withColumn("data", normalise(F.col("data")).cast("array<float>")) if unit else df


def write_blocks(vectors: DataFrame, folder: str) -> None:
    """The store as a file for each block, written where its rows are and named when it is whole; then files of blocks that
    are no more are deleted."""
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)

    def write(table: pa.Table) -> pa.Table:
        fs, at = file_system(folder)
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        block = rows[0]["block"]
        temporary = f"{at}/.{block}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as f:
            f.write(encode_block(block, rows))
        fs.move(temporary, f"{at}/{block}")
        return table.select(["block"]).slice(0, 1)

    columns = [c.split()[0] for c in ("id", "filepath", "meta", "subset", "block", "data")]
    written = {str(r["block"]) for r in vectors.select(*columns).groupBy("block").applyInArrow(write, "block bigint").collect()}  # a number of each block
    for info in fs.get_file_info(pafs.FileSelector(at)):
        if info.base_name.isdigit() and info.base_name not in written:
            fs.delete_file(info.path)


def write_index(edges: DataFrame, path: str, size: int) -> None:
    """edges (layer, src, dst, dist) as one index file, which is what the format is. The layers' counts come first; then the
    nodes pass through the driver one by one, in order."""
    fs, at = file_system(path)
    nodes = edges.groupBy("layer", "src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("links"))
    counts = {r["layer"]: r["count"] for r in nodes.groupBy("layer").count().collect()}
    layers = range(max(counts, default=-1) + 1)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(struct.pack(">II", size, len(layers)))
        for layer in layers:
            f.write(struct.pack(">I", counts.get(layer, 0)))
            for r in nodes.where(F.col("layer") == layer).orderBy("src").toLocalIterator() if layer in counts else ():
                f.write(struct.pack(">QI", r["src"], len(r["links"])) + b"".join(struct.pack(">Qf", e["dst"], e["dist"]) for e in r["links"]))
    fs.move(temporary, at)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            for data in pdf["content"]:
                yield pd.DataFrame(decode_index(bytes(data)), columns=["layer", "src", "dst", "dist"])

    return files.select("content").mapInPandas(run, EDGES)

"""Token-ID output by bit-plane shuffling.

A token table is a Parquet table of chunks. A chunk holds the ids of whole documents; its ids are cut into blocks of a
fixed number of ids, each block is transposed into byte (or bit) planes, and each plane is compressed with zstandard.
Beside its blocks a chunk stores its index: part, place in the part, the documents in it and their numbers of ids.
Parts are numbered in the order of the documents, so that the ids of all documents are one stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import each_batch, pick, text_slices
from marlstone.llm.tokens import END_ID, coder


def shuffle_block(ids: np.ndarray, unit: str = "byte", level: int = 1) -> list[bytes]:
    """The compressed planes of one block of unsigned 32-bit ids, lowest plane first."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(raw.T)
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(p.tobytes()) for p in planes]


def unshuffle_block(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of shuffle_block; 4 planes are bytes, 32 are bits."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes])
    if len(planes) == 32:
        raw = np.packbits(np.unpackbits(rows, axis=1, bitorder="little", count=n).T, axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(rows.T)
    return np.ascontiguousarray(raw).reshape(-1).view("<u4")


def write_token_table(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, block_ids: int = 1 << 16, chunk_ids: int = 1 << 18, unit: str = "byte") -> None:
    """Encode every whole text and write the token table in ascending order of id.

    Nulls in id come first; null and empty texts give the end id alone. Equal ids are ordered by text, and each row is
    a document of its own. A text longer than a chunk gets a chunk to itself. An empty table writes no chunk. Other
    columns are ignored.
    """
    source = pick(docs, doc=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie", "text").select("doc", "text")
    kind = ordered.schema["doc"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("doc_sizes", T.ArrayType(T.IntegerType())), T.StructField("block_sizes", T.ArrayType(T.IntegerType())), T.StructField("planes", T.ArrayType(T.ArrayType(T.BinaryType())))])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer, end_id).encode
        context = TaskContext.get()
        part, chunk, start = context.partitionId() if context else 0, 0, 0
        docs_in: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        count, id_type = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal chunk, start, docs_in, sizes, held, count
            ids = np.concatenate(held) if held else np.zeros(0, "<u4")
            blocks = [ids[i : i + block_ids] for i in range(0, len(ids), block_ids)]
            doc_ids = pa.concat_arrays(docs_in)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([np.concatenate(sizes).tolist()], pa.list_(pa.int32())),
                    pa.array([[len(b) for b in blocks]], pa.list_(pa.int32())), pa.array([[shuffle_block(b, unit) for b in blocks]], pa.list_(pa.list_(pa.binary()))),
                ],
                names=[f.name for f in schema],
            )
            chunk, start = chunk + 1, start + len(ids)
            docs_in, sizes, held, count = [], [], [], 0
            return row

        for batch in text_slices(batches, most=6_000_000):
            ids, edges = encode(batch.column(1))
            docs_in.append(batch.column(0))
            sizes.append(np.diff(edges))
            held.append(ids)
            count += len(ids)
            if count >= chunk_ids:
                yield flush()
        if docs_in:
            yield flush()

    each_batch(ordered, chunks, schema).write.option("compression", "none").parquet(path)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Chunks are decoded where they are read; only the totals of the parts, one row for each, are gathered.
    """
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, docs, sizes, lengths, planes = (c[i] for c in batch.columns)
                blocks = [unshuffle_block(p, n) for p, n in zip(planes.as_py(), lengths.as_py())]
                raw = memoryview(np.concatenate(blocks).view(np.uint8) if blocks else b"")
                n = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(n), pa.int32()), docs.values, pa.array(ends - n + start.as_py(), pa.int64()), pa.array(n), pa.array(crc, pa.int64())], names=[f.name for f in schema])

    rows = each_batch(table.select("part", "part_start", "doc_ids", "doc_sizes", "block_sizes", "planes"), decode, schema)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_planes(docs: DataFrame, path: str, tokenizer: str, **options) -> DataFrame:
    """Write the token table of docs to path and return what read_token_table reads from it."""
    write_token_table(docs, path, tokenizer, **options)
    return read_token_table(docs.sparkSession, path)

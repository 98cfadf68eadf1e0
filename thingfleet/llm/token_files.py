"""Token ids as Parquet list columns: controlled encodings, row groups and pages, read back in part or whole."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, rows_of, running_start, stored
from .token_ids import path, shared_ids

#: Row groups small enough to skip, pages small enough to read alone; the writer adds column and page indexes.
#: Ids of a vocabulary of tens of thousands repeat, so a dictionary page codes them in 16 bits or fewer;
#: numbers that only rise (starts, ids of documents) are coded as differences.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part": "false",
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
}


def tokenized(docs: DataFrame, file: str | None = None, end: int = 2, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``part, doc_id, n_tokens, ids`` in ascending order of ``doc_id`` (nulls first, ties by text).

    ``file`` is the vocabulary file as executors see it; by default the public one. Null text is empty:
    its only id is ``end``. Columns besides ``doc_id`` and ``text`` are left out.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        ids = shared_ids(file or path(vocabulary))
        last = np.array([end], dtype="<u4").tobytes()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            made = [x + last for x in ids.encode([t or "" for t in rows_of(b, "text")])]
            sizes = np.fromiter((len(x) // 4 for x in made), dtype=np.int64, count=len(made))
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(made), dtype="<i4"), pa.int32())
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values), b.column(2)],
                names=["doc_id", "n_tokens", "ids", "part"],
            )

        return one

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    return by_batch(ordered, make, "doc_id long, n_tokens long, ids array<int>, part int")


def write_tokens(tokens: DataFrame, target: str) -> str:
    """Write the files; one file per part, sorted by document, so statistics of pages let readers skip."""
    tokens.write.options(**LAYOUT).parquet(target)
    return target


def read_tokens(spark: SparkSession, target: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """The stored rows: only the columns asked for and, by the page indexes, only the pages that ``where`` needs."""
    df = spark.read.schema("doc_id long, n_tokens long, ids array<int>, part int").parquet(target)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def ids_crc32(ids: pa.Array) -> np.ndarray:
    """The crc32 of each list as little-endian unsigned 32-bit integers."""
    flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
    at = ids.offsets.to_numpy(zero_copy_only=False).astype(np.int64) * 4
    return np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])), dtype=np.int64, count=len(ids))


def digests(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the files alone."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            crc = ids_crc32(b.column(1))
            n = np.diff(b.column(1).offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(crc), b.column(2)], names=["doc_id", "n_tokens", "ids_crc32", "part"]
            )

        return one

    read = read_tokens(spark, target, ["doc_id", "ids", "part"])
    sums = stored(by_batch(read, make, "doc_id long, n_tokens long, ids_crc32 long, part int"), "token-sums")
    return running_start(sums, ["doc_id", "ids_crc32", "n_tokens"], "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")

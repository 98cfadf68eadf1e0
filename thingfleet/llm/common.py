"""What the operators of this subpackage share: reading, word hashes, fixed-size filters, running sums, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thingfleet.session import scratch

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words, as in [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def prepared(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Bound the Arrow batches that Python tasks hold at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def with_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``row_key``: the same for identical rows of one document, different for different texts under one id."""
    return df.withColumn("row_key", F.xxhash64("doc_id", text))


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWERED)


_ODD, _SALT = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []
#: Bytes hashed at a time; a text is cut between two words.
_AT_ONCE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * _AT_ONCE)
        with np.errstate(over="ignore"):
            _POWERS[:] = [
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, dtype=np.uint64)]))
                for x in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64)))
            ]
    return _POWERS[0], _POWERS[1]


def _between(text: bytes, at: int) -> int:
    """The first place from ``at`` on that is no part of a word."""
    found = re.compile(rb"[\x20\x09-\x0D]").search(text, at)
    return found.start() if found else len(text)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words (between ASCII white space) of each text, in order.

    Words are hashed together as polynomials of their bytes, a megabyte of text at a time.
    """
    pieces: list[tuple[int, bytes]] = []
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at > _AT_ONCE:
            end = _between(t, at + _AT_ONCE)
            pieces.append((k, t[at:end]))
            at = end
        pieces.append((k, t[at:]))
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0
    for piece in [*pieces, None]:
        if held and (piece is None or size + len(piece[1]) > _AT_ONCE):
            joined = np.frombuffer(b" ".join([b"", *(t for _, t in held), b""]), dtype=np.uint8)
            word = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            first, end = edge[::2], edge[1::2]
            power, inverse = _powers(len(joined) + 1)
            sums = np.zeros(len(joined) + 1, dtype=np.uint64)
            np.cumsum((joined + np.uint64(1)) * power[: len(joined)], out=sums[1:])
            h = mixed((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64) * _SALT)
            cuts = np.cumsum([1] + [len(t) + 1 for _, t in held])
            for (k, _), part in zip(held, np.split(h, np.searchsorted(first, cuts[1:-1]))):
                out[k].append(part)
            held, size = [], 0
        if piece is not None:
            held.append(piece)
            size += len(piece[1]) + 1
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]


def text_word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """:func:`word_hashes` of texts with A to Z lower-cased."""
    return word_hashes([utf8(t).lower() for t in texts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring values become unrelated ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for every run of ``k`` neighbouring word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with state made once per task: ``make()`` returns the function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            if b.num_rows and (out := one(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


# Fixed-size filters ---------------------------------------------------------------------------


class Bloom:
    """A Bloom filter of a fixed number of bits, three probes: what it broadcasts never grows."""

    def __init__(self, bits: int = 1 << 24):
        self.mask, self.words = np.uint64(bits - 1), np.zeros(bits // 8, dtype=np.uint8)

    def _at(self, h: np.ndarray) -> list[np.ndarray]:
        h2 = mixed(h)
        return [h & self.mask, (h >> np.uint64(24)) & self.mask, h2 & self.mask]

    def add(self, h: np.ndarray) -> None:
        flags = np.unpackbits(self.words, bitorder="little")
        for at in self._at(h):
            flags[at] = 1
        self.words = np.packbits(flags, bitorder="little")

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at in self._at(h):
            out &= (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom_of(df: DataFrame, column: str, bits: int = 1 << 24) -> Bloom:
    """The filter of a column of longs, made in the tasks; one filter per group of tasks reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for b in batches:
            if b.num_rows:
                own.add(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        filled = np.flatnonzero(own.words)
        if len(filled):
            pages = np.unique(filled >> 12)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pages, pa.int64()), pa.array([own.words[p << 12 : (p + 1) << 12].tobytes() for p in pages], pa.binary())],
                names=["page", "bits"],
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            for p, bits_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(bits_, dtype=np.uint8)
                pages[p] = pages[p] | got if p in pages else got
        if pages:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(pages), pa.int64()), pa.array([v.tobytes() for v in pages.values()], pa.binary())],
                names=["page", "bits"],
            )

    schema = "page long, bits binary"
    pages = df.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(run, schema)
    out = Bloom(bits)
    # one job: the pages of a filter are a fixed number of bytes, however they are dealt
    for row in pages.repartition(8, "page").mapInArrow(joined, schema).collect():
        at = row["page"] << 12
        out.words[at : at + len(row["bits"])] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


# Running sums ---------------------------------------------------------------------------------


def running_start(df: DataFrame, order: list[str], size: str, name: str = "start") -> DataFrame:
    """Add the sum of ``size`` over all rows before each one; ``df`` must lie in parts sorted along ``order``
    and be stored, with the number of its part in ``part`` rising along the order.

    Windows run inside a part; only one total per part meets in one task.
    """
    totals = df.groupBy("part").agg(F.sum(size).alias("_total"))
    before = totals.select(
        "part", (F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")).alias("_before")
    )
    inside = F.sum(size).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return (
        df.withColumn("_inside", inside)
        .join(before, "part")
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_inside", "_before")
    )


# Connected components -------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the smallest node that links reach.

    Alternates large-star and small-star steps until all links are stars; every step is an aggregation and
    a join that Spark may split where one node has very many links.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    # done when every node has one link down, to a node that has none
    while not is_empty(
        e.select("b").join(e.select(F.col("a").alias("b")), "b", "left_semi").union(
            e.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("most")).where("b <> most").select("b")
        )
    ):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        e = stored(small, "edges")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

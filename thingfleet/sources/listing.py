"""Listings kept in order, whose pages read only the blocks they lie in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch

#: Rows of a block; a page touches the blocks it overlaps and no other.
BLOCK = 10_000


@dataclass(frozen=True)
class Listing:
    """A sorted copy of things in files of one block each, and a directory with one row per block.

    Sorting shuffles the things once; after that a page at any offset costs its own blocks.
    """

    spark: SparkSession
    path: str

    @staticmethod
    def build(
        things: DataFrame, sort_by: str = "id", sort_order: str = "asc", block: int = BLOCK, path: str | None = None
    ) -> Listing:
        """Sort ``things`` by ``sort_by``, ties by ``id``, into ``path`` (a fresh shared folder without one).

        Nulls come first in ascending and last in descending order. All columns are kept, under any name. Many
        things of one value lie in several blocks, as their ids differ.
        """
        if sort_order not in ("asc", "desc"):
            raise ValueError("sort_order is asc or desc")
        if block < 1:
            raise ValueError("a block holds at least one row")
        spark = things.sparkSession
        path = path or scratch(spark, "listing")
        key = F.col(sort_by).desc() if sort_order == "desc" else F.col(sort_by).asc()
        whole = F.struct(*(F.col(f"`{c}`") for c in things.columns)).alias("thing")
        # numbers rise within a sorted part and from part to part
        rows = things.orderBy(key, F.col("id").asc()).select(whole, F.monotonically_increasing_id().alias("seq"))
        rows.write.option("maxRecordsPerFile", block).parquet(f"{path}/rows")
        stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        blocks = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min("seq").alias("low"), F.count(F.lit(1)).alias("n")
        )
        upto = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))
        blocks.withColumn("start", upto - F.col("n")).write.parquet(f"{path}/blocks")
        return Listing(spark, path)

    def directory(self) -> DataFrame:
        """``file, low, n, start`` of every block: where it lies, its first number, its rows and the rows before it."""
        return self.spark.read.schema("file string, low long, n long, start long").parquet(f"{self.path}/blocks")

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``at`` and ``thing`` of one page, in order; ``at`` counts from the beginning of the listing.

        What reaches the driver is a row for each block that the page overlaps, at most one per row of the page.
        """
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        overlapping = self.directory().where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
        blocks = sorted((b.start, b.low, b.file) for b in overlapping.collect())
        if not blocks or not limit:
            return rows.where("false").select(F.lit(0).cast("long").alias("at"), "thing")
        # only the first and the last block are read in part; rows of a block are numbered without a gap
        (start, low, _), (last_start, last_low, _) = blocks[0], blocks[-1]
        inside = F.col("seq").between(low + max(0, offset - start), last_low + offset + limit - 1 - last_start)
        found = self.spark.read.schema(rows.schema).parquet(*(file for _, _, file in blocks)).where(inside)
        placed = found.select("thing", "seq", F.col("_metadata.file_path").alias("file")).join(overlapping, "file")
        return placed.select((F.col("start") + F.col("seq") - F.col("low")).alias("at"), "thing").orderBy("at")

    def collection(self, limit: int, offset: int = 0) -> DataFrame:
        """One row for a page: ``id`` (its address), ``total``, ``next`` (null on the last page) and ``members``."""
        address = "/things?offset={}&limit={}&format=collection".format
        members = self.page(limit, offset).agg(F.sort_array(F.collect_list(F.struct("at", "thing"))).alias("m"))
        total = self.directory().agg(F.sum("n")).first()[0] or 0
        following = address(offset + limit, limit) if total > offset + limit else None
        return members.select(
            F.lit(address(offset, limit)).alias("id"),
            F.lit(total).cast("long").alias("total"),
            F.lit(following).cast("string").alias("next"),
            F.transform("m", lambda x: x["thing"]).alias("members"),
        )

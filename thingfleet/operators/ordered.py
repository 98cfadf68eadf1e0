"""Work along an order without ever putting one key, or everything, into one task.

The range of the order column is cut into blocks of one width. A window runs inside each (key, block); what
one block hands to the next is a summary row, and only summary rows are scanned per key. There are at most
``BLOCKS`` times the shuffle partitions of them, whether the numbers are dense or sparse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

BLOCKS = 8


def _blocked(df: DataFrame, order: str, width: int | None) -> DataFrame:
    """Add ``__b``, the number of the block an order value falls into, in whole-number arithmetic."""
    if width is not None:
        return df.withColumn("__b", F.expr(f"`{order}` div {width}L"))
    n = BLOCKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi")).withColumn("__one", F.lit(1))
    # the side that travels is one row
    return (
        df.withColumn("__one", F.lit(1))
        .join(F.broadcast(ends), "__one")
        .withColumn("__b", F.expr(f"(`{order}` - __lo) div ((__hi - __lo) div {n}L + 1L)"))
        .drop("__one", "__lo", "__hi")
    )


def carry_last(
    df: DataFrame, key: str, order: str, value: Column, name: str, block: int | None = None
) -> DataFrame:
    """Add ``name``: the last non-NULL ``value`` on an earlier row of the same key."""
    rows = _blocked(df.withColumn("__v", value), order, block)
    before = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__in", F.last("__v", ignorenulls=True).over(before))

    ends = rows.groupBy(key, "__b").agg(
        F.max(F.when(F.col("__v").isNotNull(), F.struct(F.col(order), F.col("__v")))).alias("__e")
    )
    across = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        key, "__b", F.last("__e.__v", ignorenulls=True).over(across).alias("__c")
    ).where(F.col("__c").isNotNull())
    return (
        inside.join(carried, [key, "__b"], "left")
        .withColumn(name, F.coalesce("__in", "__c"))
        .drop("__v", "__b", "__in", "__c")
    )


def number_rows(df: DataFrame, order: str, name: str, start: int = 0, block: int | None = None) -> DataFrame:
    """Add ``name``: a gapless number along ``order``, beginning at ``start``."""
    rows = _blocked(df, order, block)
    inside = rows.withColumn(
        "__i", F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1
    )
    # one row per block: this is the only global scan
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__c")).select(
        "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s")
    )
    return (
        inside.join(shift, "__b")
        .withColumn(name, (F.col("__i") + F.col("__s") + F.lit(start)).cast("bigint"))
        .drop("__b", "__i", "__s")
    )


def positions(df: DataFrame, by: list[Column], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the place of each row in the order ``by``, whatever the types of its columns.

    Rows are dealt by sampled ranges of the order, and of rows that tie by a number of their own, so neither a far
    value nor a value that many rows share fills one task. Ties are placed in no particular order. The sorted rows
    are written to the shared folder; what is added up along the parts is one row for each.
    """
    tie = df.withColumn("__tie", F.monotonically_increasing_id())
    rows = kept(
        tie.orderBy(*by, "__tie").drop("__tie").withColumn("__m", F.monotonically_increasing_id()), "positions"
    ).withColumn("__part", F.shiftright("__m", 33))
    # numbers rise within a part from the part's own first one, and from part to part
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__c")).select(
        "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s")
    )
    inside = F.col("__m") - F.shiftleft("__part", 33)
    return (
        rows.join(shift, "__part")
        .withColumn(name, (inside + F.col("__s") + F.lit(start)).cast("bigint"))
        .drop("__m", "__part", "__s")
    )

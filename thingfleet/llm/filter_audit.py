"""What every order of a set of filters removes at every step, from interval ends over lexicographic ranks."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, stored

LETTERS = "ABCDE"
SPACE = "[" + "".join(f"\\x{ord(c):02X}" for c in SPACES) + "]+"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D, which look at it alone."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        n < 200,
        100 * distinct < 50 * n,
        100 * capitals > 3 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def _mask(failures: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: how many rows of ``docs`` fail exactly the filters of ``mask`` (bit 0 is A).

    ``part`` is ``lang``; a null one and a null text are the empty string. E fails where a smaller ``doc_id`` has
    the same text (told by 256 bits of hash), which a null ``doc_id`` never has and never is. ``good`` and ``toxic``
    count rows whose ``doc_id`` has a label of quality 1 and of toxic 1, however many labels it has. Other columns
    are not read; a row that is there twice counts twice.

    Texts are read once and never shuffled. Rows travel as an id, a hash and a mask, combined before each shuffle,
    so neither a text that a third of all rows hold nor an id repeated as often meets in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    slim = read.select("doc_id", "part", F.sha2("text", 256).alias("same"), _mask(text_failures(F.col("text"))).alias("own"))
    per_id = slim.groupBy("doc_id", "part", "same", "own").agg(F.count("*").alias("n"))
    said = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    flag = lambda c: F.coalesce(c, F.lit(0))
    told = per_id.join(said, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", "part", "same", "own", "n", flag("good").alias("good"), flag("toxic").alias("toxic")
    )
    # one row per text, part and labels: all rows of it, and those of its smallest id
    groups = told.groupBy("same", "own", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    # at most four rows for every part a text stands in
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    at_first = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("without_id")
    split = groups.withColumn("first", first).select(
        "part", "own", "good", "toxic", "n", at_first.cast("long").alias("unlike")
    )
    copy = F.lit(1 << 4)
    each = split.select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("own").alias("mask"), F.col("unlike").alias("n")),
                F.struct((F.col("own") + copy).alias("mask"), (F.col("n") - F.col("unlike")).alias("n")),
            )
        ).alias("m"),
    )
    return each.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good"), F.sum(F.col("m.n") * F.col("toxic")).alias("toxic")
    )


def lehmer_rank(order: str, letters: str) -> int:
    """The place of an order among all orders of ``letters`` by the alphabet."""
    rank, left = 0, sorted(letters)
    for i, c in enumerate(order):
        rank += left.index(c) * factorial(len(letters) - 1 - i)
        left.remove(c)
    return rank


def removal_intervals(letters: str) -> list[tuple[int, int, int, int]]:
    """``mask, step, start, stop``: over the ranks from ``start`` up to ``stop`` a row of ``mask`` goes at ``step``.

    It goes with the first of its filters. All orders that begin with the same letters have neighbouring ranks,
    so each beginning whose last letter alone is in the mask is one interval.
    """
    k, out = len(letters), []
    for step in range(1, k + 1):
        for begin in permutations(letters, step):
            rest = "".join(c for c in sorted(letters) if c not in begin)
            start = lehmer_rank("".join(begin) + rest, letters)
            free = [letters.index(c) for c in rest]
            last = letters.index(begin[-1])
            for chosen in range(1 << len(free)):
                mask = 1 << last | sum(1 << b for i, b in enumerate(free) if chosen >> i & 1)
                out.append((mask, step, start, start + factorial(k - step)))
    return out


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For every part, order of the filters and step what the step keeps, removes and loses, from ``part, mask, n,
    good, toxic`` (one row per part and mask, as :func:`masks` gives it; parts without rows give nothing).

    Every mask adds its counts at the start of its intervals and takes them away at their ends; summed up along
    the ranks these differences are the counts of each order. The tables here have one row per part, order and
    step at most, however many rows were counted.
    """
    spark = counts.sparkSession
    tables = _tables(spark, letters)
    intervals, orders = F.broadcast(tables[0]), F.broadcast(tables[1])
    what = ("n", "good", "toxic")
    ends = counts.join(intervals, "mask").select(
        "part",
        "step",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("rank"), *(F.col(c) for c in what)),
                F.struct(F.col("stop").alias("rank"), *((-F.col(c)).alias(c) for c in what)),
            )
        ).alias("e"),
    )
    deltas = ends.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*(F.sum(f"e.{c}").alias(c) for c in what))
    # what a filter fails, in all and alone, and each part's rows
    letter = F.explode(F.array(*(F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(letters))))
    failing = (
        counts.select("part", "mask", "n", letter.alias("l"))
        .groupBy("part", F.col("l.letter").alias("letter"))
        .agg(
            F.sum(F.when(F.col("mask").bitwiseAND(F.col("l.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(F.col("mask") == F.col("l.bit"), F.col("n")).otherwise(0)).alias("alone"),
            F.sum("n").alias("rows"),
        )
    )
    grid = failing.join(orders, "letter").select("part", "rank", "step", "filter_order", "letter", "fails", "alone", "rows")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        grid.join(deltas, ["part", "step", "rank"], "left")
        .withColumns({f"sum_{c}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(along) for c in what})
    )
    in_order = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    by_letter = Window.partitionBy("part", "letter")
    return summed.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (F.col("rows") - F.sum("sum_n").over(in_order)).cast("long").alias("kept"),
        F.col("sum_n").cast("long").alias("removed"),
        (F.col("fails") - F.col("sum_n")).cast("long").alias("redundant"),
        F.col("alone").cast("long").alias("unique_fails"),
        F.col("sum_good").cast("long").alias("good_lost"),
        F.col("sum_toxic").cast("long").alias("toxic_lost"),
        F.sum("sum_n").over(by_letter).cast("long").alias("shapley"),
    )


def _tables(spark: SparkSession, letters: str) -> tuple[DataFrame, DataFrame]:
    """The intervals of all masks, and each order with the filter of each of its steps."""
    intervals = spark.createDataFrame(removal_intervals(letters), "mask int, step int, start int, stop int")
    orders = [
        (rank, step + 1, "".join(order), order[step])
        for rank, order in enumerate(permutations(sorted(letters)))
        for step in range(len(letters))
    ]
    return intervals, spark.createDataFrame(orders, "rank int, step int, filter_order string, letter string")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`interactions` of the five filters over all rows of ``docs``; an empty table gives no rows.

    A part is a value of ``lang``. The masks' counts are small (32 rows a part) and are worked out once.
    """
    return interactions(stored(masks(docs, labels), "filter-masks"))

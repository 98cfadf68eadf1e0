"""Group aggregates with the rules of graph queries for unbound values and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(value: Column | None = None, distinct: bool = False) -> Column:
    """Rows, or bound values."""
    if value is None:
        return F.count(F.lit(1))
    return F.count_distinct(value) if distinct else F.count(value)


def _guarded(number: Column, result: Column) -> Column:
    return F.when(F.count_if(number.isNull()) == 0, result)


def total(number: Column) -> Column:
    """Sum; 0 for an empty group, unbound when a member is not a number."""
    return _guarded(number, F.coalesce(F.sum(number), F.lit(0)))


def mean(number: Column) -> Column:
    """Average; 0 for an empty group, unbound when a member is not a number."""
    return _guarded(number, F.coalesce(F.avg(number), F.lit(0)))


def _of_numbers(number: Column, exact: Column, approx: Column) -> Column:
    value, near = number["exact"], number["approx"]
    exact = F.when(F.count_if(value.isNull()) == 0, F.when(F.count(value) == 0, 0).otherwise(exact))
    approx = F.coalesce(exact.cast("double"), approx, F.lit(0.0))
    bound = F.count_if(near.isNull()) == 0
    return F.struct(F.when(bound, exact).alias("exact"), F.when(bound, approx).alias("approx"))


def total_number(number: Column) -> Column:
    """:func:`total` of numbers of any size (``terms.number``), as such a number: exact while a decimal holds
    all members and the sum, else a double."""
    return _of_numbers(number, F.try_sum(number["exact"]), F.sum(number["approx"]))


def mean_number(number: Column) -> Column:
    """:func:`mean` of numbers of any size, as :func:`total_number`."""
    return _of_numbers(number, F.try_avg(number["exact"]), F.avg(number["approx"]))


def least(value: Column) -> Column:
    return F.min(value)


def greatest(value: Column) -> Column:
    return F.max(value)


def sample(value: Column, repeatable: bool = True) -> Column:
    """Some member; the smallest one when the answer must not change between runs."""
    return F.min(value) if repeatable else F.any_value(value, True)


def group_concat(
    rows: DataFrame,
    by: list[str],
    value: str,
    separator: str = " ",
    distinct: bool = False,
    name: str = "joined",
) -> DataFrame:
    """Concatenate the bound values of each group in value order; a group without any gives the empty text.

    With ``distinct`` the values are reduced first; else equal values of a task meet as one with their
    number, so a large group of few values never meets in one task.
    """
    if distinct:
        kept = rows.select(*by, value).distinct()
    else:
        counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
        again = F.flatten(F.collect_list(F.array_repeat(F.col(value), F.col("__n").cast("int"))))
        return counted.groupBy(*by).agg(F.array_join(F.array_sort(F.filter(again, lambda x: x.isNotNull())), separator).alias(name))
    return kept.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_list(value)), separator).alias(name)
    )

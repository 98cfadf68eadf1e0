"""Property paths over edge tables with columns ``s`` and ``o``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def edges(graph, predicate: str) -> DataFrame:
    return graph.match(predicate).select("s", "o")


def seq(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first/second``: one row per way to go, so duplicates stay."""
    mid = second.select(F.col("s").alias("__m"), F.col("o").alias("__o"))
    return first.join(mid, F.col("o") == F.col("__m")).select("s", F.col("__o").alias("o"))


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("o").alias("s"), F.col("s").alias("o"))


def alternative(*paths: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, paths)


def negated(quads: DataFrame, *excluded: str) -> DataFrame:
    """Edges of every predicate but the excluded ones."""
    return quads.where(~F.col("p").isin(*excluded)).select("s", "o")


def _identity(nodes: DataFrame) -> DataFrame:
    return nodes.select("s", F.col("s").alias("o"))


def _ends(path: DataFrame) -> DataFrame:
    return path.select("s").unionByName(path.select(F.col("o").alias("s"))).distinct()


def zero_or_one(path: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``path?``: every node to itself, and along one edge. ``nodes`` default to the ends."""
    here = _ends(path) if nodes is None else nodes.select("s").distinct()
    steps = path if nodes is None else path.join(here, "s", "left_semi").select("s", "o")
    return _identity(here).unionByName(steps).distinct()


def is_functional(path: DataFrame) -> bool:
    """True when no node has two outgoing edges."""
    return path.groupBy("s").count().where("count > 1").limit(1).isEmpty()


def one_or_more(path: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``path+``: pairs joined by at least one edge, each once.

    With ``start`` (column ``s``) only paths from those nodes. Every variant adds only pairs not
    seen before and ends when a round adds none, so cycles are safe and no depth is assumed.

    * start given and each node has at most one successor: jumps double every round, so a chain
      of n edges takes log2(n) rounds and the jump table never outgrows the edges;
    * start given otherwise: breadth first;
    * no start: the closure joins with itself, which doubles the length covered per round.
    """
    step = cut(path.select("s", "o").distinct())
    if start is None:
        return _closure(step)
    first = step.join(start.select("s").distinct(), "s", "left_semi").select("s", "o")
    return _jump(first, step) if is_functional(step) else _walk(first, step)


def _fresh(candidates: DataFrame, seen: list[DataFrame]) -> DataFrame:
    known = reduce(DataFrame.unionByName, seen)
    return cut(candidates.distinct().join(known, ["s", "o"], "left_anti"))


def _jump(first: DataFrame, step: DataFrame) -> DataFrame:
    seen, jump = [cut(first)], step
    while True:
        new = _fresh(seq(reduce(DataFrame.unionByName, seen), jump), seen)
        if new.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(new)
        jump = cut(seq(jump, jump))


def _walk(first: DataFrame, step: DataFrame) -> DataFrame:
    front = cut(first)
    seen = [front]
    while True:
        front = _fresh(seq(front, step), seen)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(front)


def _closure(step: DataFrame) -> DataFrame:
    seen, front = [step], step
    while True:
        known = reduce(DataFrame.unionByName, seen)
        # a new pair of up to twice the length has a half that was new in the last round
        front = _fresh(seq(front, known).unionByName(seq(known, front)), seen)
        if front.isEmpty():
            return known
        seen.append(front)


def zero_or_more(path: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``path*``: as ``path+``, and every node (or start node) to itself."""
    here = _ends(path) if start is None else start.select("s").distinct()
    return _identity(here).unionByName(one_or_more(path, start)).distinct()

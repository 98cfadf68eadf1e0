"""An index of documents by path and value, for searches that are asked again and again.

One pass takes the documents apart; every place and its value become a posting. Postings lie sorted by path,
value and document, so that a search reads the row groups of its own paths, and of a path that most documents
have, those of its values. Documents themselves are read only when asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators.nodes import explode_nodes
from ..session import scratch

#: Steps of a path: a member by name, any item of a list, any one member or item, any number of steps.
ITEM, ANY, DEEP = object(), object(), object()

_POSTINGS = "key long, kind string, text string, number double, id string"
_PATHS = "key long, place string, docs long"


def _escaped(name: str) -> str:
    return re.sub(r"([\\.\[])", r"\\\1", name)


def _place(path: Column) -> Column:
    """A path as one text: ``.name`` for members, ``[]`` for items, whatever their position."""
    def step(x: Column) -> Column:
        name = F.regexp_replace(F.substr(x, F.lit(2)), r"([\\.\[])", r"\\$1")
        return F.when(x.startswith("["), "[]").otherwise(F.concat(F.lit("."), name))

    return F.array_join(F.transform(path, step), "")


@dataclass(frozen=True)
class Test:
    """A place that a document must have, with the condition on its value (a text, a number, true, false, or none).

    ``op`` is ``=``, ``<``, ``<=``, ``>`` or ``>=``; without ``value`` the place is enough, whatever lies there.
    """

    __test__ = False

    steps: tuple
    op: str | None = None
    value: str | int | float | bool | None = None

    def __post_init__(self):
        if self.op not in (None, "=", "<", "<=", ">", ">="):
            raise ValueError(f"unknown comparison {self.op}")
        if (self.op is None) != (self.value is None):
            raise ValueError("a comparison has an operator and a value")
        if not self.steps:
            raise ValueError("a place has at least one step")

    def literal(self) -> str | None:
        """The place as text, None when it holds a wildcard."""
        if ANY in self.steps or DEEP in self.steps:
            return None
        return "".join("[]" if s is ITEM else "." + _escaped(s) for s in self.steps)

    def pattern(self) -> str:
        one = r"(\[\]|\.([^\\.\[]|\\.)*)"
        parts = {ITEM: r"\[\]", ANY: one, DEEP: one + "*"}
        return "(?s)^" + "".join(parts[s] if s in parts else re.escape("." + _escaped(s)) for s in self.steps) + "$"

    def holds(self) -> Column:
        if self.op is None:
            return F.lit(True)
        kind = "boolean" if isinstance(self.value, bool) else "string" if isinstance(self.value, str) else "number"
        column = F.col("number" if kind == "number" else "text")
        value = F.lit(str(self.value).lower() if kind == "boolean" else float(self.value) if kind == "number" else self.value)
        compared = {
            "=": column == value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value,
        }
        return (F.col("kind") == kind) & compared[self.op]


@dataclass(frozen=True)
class PathIndex:
    """Postings and the dictionary of their paths, below ``path``."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(docs: DataFrame, path: str | None = None) -> PathIndex:
        """Index ``docs`` (``id, body``). A null or unreadable body has no place; equal postings are kept once."""
        spark = docs.sparkSession
        path = path or scratch(spark, "path-index")
        nodes = explode_nodes(docs.select("id", F.try_parse_json("body").alias("doc"))).where("size(path) > 0")
        kind = D.kind_of(F.col("node"))
        flat = kind.isin("string", "number", "boolean")
        rows = nodes.select(
            _place(F.col("path")).alias("place"),
            kind.alias("kind"),
            F.when(flat, D.text_of(F.col("node"))).alias("text"),
            F.when(kind == "number", F.try_variant_get("node", "$", "double")).alias("number"),
            "id",
        )
        # the place is needed once per path: it travels to the dictionary, the postings keep its hash
        keyed = rows.withColumn("key", F.xxhash64("place"))
        postings = keyed.select("key", "kind", "text", "number", "id", "place").distinct()
        postings.orderBy("key", "text", "number", "id").write.parquet(f"{path}/postings")
        places = spark.read.schema(_POSTINGS + ", place string").parquet(f"{path}/postings")
        counted = places.groupBy("key", "place").agg(F.approx_count_distinct("id").alias("docs"))
        counted.orderBy("place").write.parquet(f"{path}/paths")
        return PathIndex(spark, path)

    def paths(self) -> DataFrame:
        """``key, place, docs``: every path, and about how many documents have it."""
        return self.spark.read.schema(_PATHS).parquet(f"{self.path}/paths")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS + ", place string").parquet(f"{self.path}/postings")

    def ids(self, test: Test) -> DataFrame:
        """``id`` of the documents that pass one test, each once."""
        rows, place = self.postings(), test.literal()
        if place is None:
            keys = self.paths().where(F.col("place").rlike(test.pattern())).select("key", "place")
            rows = rows.join(keys, ["key", "place"], "left_semi")
        else:
            # the hash prunes row groups, the place decides
            rows = rows.where(F.col("key") == F.xxhash64(F.lit(place))).where(F.col("place") == place)
        return rows.where(test.holds()).select("id").distinct()

    def search(self, *tests: Test) -> DataFrame:
        """``id`` of the documents that pass every test; the lists are intersected by one aggregation.

        A hot list combines before its shuffle, as every id is there once per test.
        """
        if not tests:
            raise ValueError("a search has at least one test")
        listed = reduce(
            DataFrame.unionByName, [self.ids(t).withColumn("bit", F.lit(1 << i).cast("long")) for i, t in enumerate(tests)]
        )
        return listed.groupBy("id").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == (1 << len(tests)) - 1).select("id")

    def documents(self, docs: DataFrame, *tests: Test) -> DataFrame:
        """The rows of ``docs`` that pass every test."""
        return docs.join(self.search(*tests), "id", "left_semi")

"""Graphs that answer triple patterns: a quads table, or relational tables seen as quads.

Both give the same rows. A mapped graph reads only the columns a pattern needs, so a pattern
with a constant predicate is a plain column scan and never builds the other quads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import QUAD_COLS, QUAD_KEY
from ..session import spread
from ..vocab import RDF_TYPE, XSD


class QuadTable:
    """A materialised quads table, best stored partitioned by ``p``."""

    def __init__(self, quads: DataFrame, single_valued: tuple[str, ...] = ()):
        self._quads = quads
        self.single_valued = frozenset(single_valued)

    def quads(self) -> DataFrame:
        return self._quads

    def match(self, predicate: str | None) -> DataFrame:
        if predicate is None:
            return self._quads
        return self._quads.where(F.col("p") == predicate)

    def star(self, predicates: list[str], any_graph: bool = False) -> DataFrame | None:
        """All objects of single-valued predicates per graph and subject, in one aggregation.

        None with ``any_graph``: a subject may have its parts, or several values, in different graphs.
        Returns ``g, s, v0, v1, ...`` where ``vi`` is ``struct<o, o_kind, o_dt, o_lang, o_num,
        o_ts>``; None when the predicates are not known to be single-valued.
        """
        if any_graph or not set(predicates) <= self.single_valued:
            return None
        value = F.struct(*[F.col(c) for c in QUAD_COLS[3:]])
        picks = [
            F.max(F.when(F.col("p") == p, value)).alias(f"v{i}") for i, p in enumerate(predicates)
        ]
        wide = self._quads.where(F.col("p").isin(predicates)).groupBy("g", "s").agg(*picks)
        return wide.where(reduce(Column.__and__, [F.col(f"v{i}").isNotNull() for i in range(len(picks))]))


@dataclass(frozen=True)
class Prop:
    """How a column becomes the object of a predicate."""

    column: Column
    kind: str = "literal"
    dt: str | None = XSD + "string"
    lang: Column | None = None
    num: Column | None = None
    ts: Column | None = None

    def value(self) -> Column:
        nothing = F.lit(None)
        return F.struct(
            self.column.cast("string").alias("o"),
            F.lit(self.kind).alias("o_kind"),
            F.lit(self.dt if self.kind == "literal" else None).cast("string").alias("o_dt"),
            (self.lang if self.lang is not None else nothing).cast("string").alias("o_lang"),
            (self.num if self.num is not None else nothing).cast("double").alias("o_num"),
            (self.ts if self.ts is not None else nothing).cast("timestamp").alias("o_ts"),
        )


@dataclass(frozen=True)
class Entity:
    """A table whose rows are subjects. Different entities have different subjects."""

    load: Callable[[], DataFrame]
    graph: Column
    subject: Column
    props: dict[str, Prop] = field(default_factory=dict)

    @cached_property
    def table(self) -> DataFrame:
        """The table, opened when a pattern first needs it."""
        return self.load()


class MappedGraph:
    """Relational tables seen as quads through one :class:`Entity` per table."""

    def __init__(self, spark: SparkSession, entities: list[Entity]):
        self._spark = spark
        self._entities = entities

    def _rows(self, entity: Entity, predicates: list[str]) -> DataFrame:
        triples = [
            F.struct(F.lit(p).alias("p"), entity.props[p].value().alias("v")) for p in predicates
        ]
        if len(triples) == 1:
            out = entity.table.select(
                entity.graph.alias("g"), entity.subject.alias("s"), triples[0].alias("t")
            )
        else:
            out = entity.table.select(
                entity.graph.alias("g"),
                entity.subject.alias("s"),
                F.explode(F.array(*triples)).alias("t"),
            )
        return out.select("g", "s", "t.p", "t.v.*").where("o is not null")

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            from ..schema import QUADS

            return self._spark.createDataFrame([], QUADS)
        return reduce(DataFrame.unionByName, parts)

    def quads(self) -> DataFrame:
        return self._union([self._rows(e, list(e.props)) for e in self._entities])

    def match(self, predicate: str | None) -> DataFrame:
        if predicate is None:
            return self.quads()
        return self._union([self._rows(e, [predicate]) for e in self._entities if predicate in e.props])

    def star(self, predicates: list[str], any_graph: bool = False) -> DataFrame | None:
        """One projection per table that has all the predicates: no join, no shuffle.

        A row is the only one about its subject, so all its parts lie in one graph.
        """
        able = [e for e in self._entities if set(predicates) <= set(e.props)]
        if not able:
            return None
        parts = []
        for e in able:
            values = [e.props[p].value().alias(f"v{i}") for i, p in enumerate(predicates)]
            wide = e.table.select(e.graph.alias("g"), e.subject.alias("s"), *values)
            parts.append(
                wide.where(
                    reduce(
                        Column.__and__, [F.col(f"v{i}.o").isNotNull() for i in range(len(values))]
                    )
                )
            )
        return reduce(DataFrame.unionByName, parts)


def dedup(quads: DataFrame) -> DataFrame:
    """Set semantics: each quad once."""
    return quads.dropDuplicates(QUAD_KEY)


def write_quads(quads: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Write quads partitioned by predicate; a predicate is spread over as many tasks as its rows need."""
    sizes = quads.groupBy("p").agg(F.ceil(F.count("*") / F.lit(rows_per_file)).alias("__chunks"))
    chunk = F.pmod(F.xxhash64("g", "s"), F.col("__chunks"))
    (
        # one row per predicate, so the sizes are a small side, which Spark sees by itself
        quads.join(sizes, "p")
        .repartition("p", chunk)
        .drop("__chunks")
        .sortWithinPartitions("p", "s")
        .write.partitionBy("p")
        .mode(mode)
        .parquet(path)
    )


def stored(quads: DataFrame) -> DataFrame:
    """The quads as a table in the shared folder, for work that reads them many times.

    Rows stay in the task that made them; sorted by predicate, a reader skips the row groups of
    other predicates.
    """
    from ..session import scratch

    spark = quads.sparkSession
    path = scratch(spark, "quads")
    quads.sortWithinPartitions("p", "s").write.parquet(path)
    return spark.read.schema(quads.schema).parquet(path)


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    from ..schema import QUADS

    return spark.read.schema(QUADS).parquet(path).select(*QUAD_COLS)


# ---------------------------------------------------------------- the business tables as a graph

COL = "urn:col:"
PART_OF = "urn:rel:partOf"
NEXT = "urn:rel:next"


def _num(name: str, dt: str = "double") -> Prop:
    return Prop(F.col(name), dt=XSD + dt, num=F.col(name))


def _int(name: str) -> Prop:
    return _num(name, "integer")


def _str(name: str) -> Prop:
    return Prop(F.col(name))


def _ref(table: str, name: str) -> Prop:
    return Prop(F.concat(F.lit(f"urn:{table}:"), F.col(name)), kind="iri")


def _ts(name: str) -> Prop:
    return Prop(F.col(name), dt=XSD + "dateTime", ts=F.col(name))


def business_graph(spark: SparkSession, sf_dir: str, even: bool = False) -> MappedGraph:
    """The tables of ``sf_dir`` as one graph per table.

    ``even`` deals their rows into parts of bounded size, for work that holds what a task makes of its rows.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def entity(name: str, key: str, props: dict[str, Prop], subject: Column | None = None) -> Entity:
        named = {COL + k if ":" not in k else k: v for k, v in props.items()}
        named[RDF_TYPE] = Prop(F.lit(f"urn:class:{name}"), kind="iri")
        return Entity(
            lambda: spread(read(name)) if even else read(name),
            F.lit(f"urn:graph:{name}"),
            F.concat(F.lit(f"urn:{name}:"), F.col(key)) if subject is None else subject,
            named,
        )

    turn = lambda n: F.concat(F.lit("urn:turn:"), F.col("conv_id"), F.lit(":"), n)
    return MappedGraph(
        spark,
        [
            entity("region", "r_regionkey", {"r_name": _str("r_name")}),
            entity(
                "nation",
                "n_nationkey",
                {
                    "n_name": _str("n_name"),
                    "n_region": _ref("region", "n_regionkey"),
                    PART_OF: _ref("region", "n_regionkey"),
                },
            ),
            entity(
                "customer",
                "c_custkey",
                {
                    "c_name": _str("c_name"),
                    "c_nation": _ref("nation", "c_nationkey"),
                    "c_acctbal": _num("c_acctbal"),
                    "c_mktsegment": _str("c_mktsegment"),
                    PART_OF: _ref("nation", "c_nationkey"),
                },
            ),
            entity(
                "supplier",
                "s_suppkey",
                {
                    "s_name": _str("s_name"),
                    "s_nation": _ref("nation", "s_nationkey"),
                    "s_acctbal": _num("s_acctbal"),
                    PART_OF: _ref("nation", "s_nationkey"),
                },
            ),
            entity(
                "part",
                "p_partkey",
                {
                    "p_name": _str("p_name"),
                    "p_brand": _str("p_brand"),
                    "p_type": _str("p_type"),
                    "p_size": _int("p_size"),
                    "p_retailprice": _num("p_retailprice"),
                },
            ),
            entity(
                "orders",
                "o_orderkey",
                {
                    "o_customer": _ref("customer", "o_custkey"),
                    "o_orderstatus": _str("o_orderstatus"),
                    "o_totalprice": _num("o_totalprice"),
                    "o_orderdate": _ts("o_orderdate"),
                    "o_orderpriority": _str("o_orderpriority"),
                    PART_OF: _ref("customer", "o_custkey"),
                },
            ),
            entity(
                "documents",
                "doc_id",
                {
                    "text": Prop(F.col("text"), dt=None, lang=F.col("lang")),
                    "lang": _str("lang"),
                    "source": _str("source"),
                    "n_chars": _int("n_chars"),
                },
            ),
            entity(
                "labels",
                "doc_id",
                {
                    "about": _ref("documents", "doc_id"),
                    "quality": _int("quality"),
                    "toxic": _int("toxic"),
                },
            ),
            entity(
                "pages",
                "page_id",
                {"url": Prop(F.col("url"), dt=XSD + "anyURI")},
            ),
            entity(
                "conversations",
                "conv_id",
                {"role": _str("role"), "conv": _int("conv_id"), "turn": _int("turn")},
                subject=turn(F.col("turn")),
            ),
        ],
    )


def conversation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s next o`` from each turn to the one after it, where there is one."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    name = lambda shift: F.concat(
        F.lit("urn:turn:"), F.col("conv_id"), F.lit(":"), F.col("turn") + shift
    )
    return turns.join(before, ["conv_id", "turn"], "left_semi").select(
        name(0).alias("s"), name(1).alias("o")
    )

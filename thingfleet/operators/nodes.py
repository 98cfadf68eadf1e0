"""Documents as rows: the node table, and documents put back together from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D


FAST_LEVELS = 7

# The step to a child made by :func:`children`: ``.key`` or ``[i]``.
STEP = "if(__k IS NOT NULL, concat('.', __k), concat('[', __p, ']'))"


def children(rows: DataFrame) -> DataFrame:
    """Every row as it is (``own``), and one row per child of each ``open`` row's ``node``.

    A child row has its position ``__p`` or key ``__k`` and its value ``__v`` beside the columns of its
    parent but for ``node``, which is NULL there: children don't carry copies of what is around them. Rows without
    a node are dropped. Plans of many levels are written as SQL text, which keeps building them cheap.
    """
    keep = [f"`{c}`" for c in rows.columns if c != "node"]
    rows = rows.selectExpr(*keep, "node", "explode(if(open, array(true, false), array(true))) AS own")
    rows = rows.selectExpr(*keep, "own", "if(own, node, NULL) AS node", "if(own, NULL, node) AS __in")
    below = rows.sparkSession.tvf.variant_explode_outer(F.col("__in").outer())
    # an own row has no children, a row for children is dropped where there are none
    return rows.lateralJoin(below.toDF("__p", "__k", "__v")).where("if(own, node, __v) IS NOT NULL").drop("__in")


def explode_nodes(docs: DataFrame, doc: str = "doc", levels: int = FAST_LEVELS) -> DataFrame:
    """One row per node of each document in column ``doc``: the other columns, ``path``, ``ord``
    and ``node``.

    One pass over the documents: each of the first ``levels`` levels is a generator that keeps a
    node and adds its children. What nests deeper is walked inside its row, so any depth is
    complete; ``levels`` only decides where the faster way ends.
    """
    keep = [c for c in docs.columns if c != doc]
    # no filter on the documents here: it would work them out once more; the first level drops those that are NULL
    rows = docs.select(
        *keep,
        F.array().cast("array<string>").alias("path"),
        F.array().cast(D.ORD).alias("ord"),
        F.col(doc).alias("node"),
        F.lit(True).alias("open"),
    )
    for _ in range(levels):
        rank = "named_struct('pos', if(__k IS NULL, int(__p), -1), 'key', coalesce(__k, ''))"
        rows = children(rows).selectExpr(
            *[f"`{c}`" for c in keep],
            f"if(own, path, array_append(path, {STEP})) AS path",
            f"if(own, ord, array_append(ord, {rank})) AS ord",
            "if(own, node, __v) AS node",
            "NOT own AS open",
        )
    rest = D.walk(F.col("node"), D.nesting_depth(F.to_json("node")))
    wide = rows.withColumn("__n", F.explode_outer(F.when(F.col("open"), rest)))
    pick = lambda old, new: F.when(F.col("open"), new).otherwise(F.col(old)).alias(old)
    return wide.select(
        *keep,
        pick("path", F.concat("path", "__n.path")),
        pick("ord", F.concat("ord", "__n.ord")),
        pick("node", F.col("__n.node")),
    )


def flatten(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """The node table of the documents in column ``doc``, keyed by ``id``. Nothing shuffles."""
    nodes = explode_nodes(docs.select("id", doc), doc).withColumn(
        "shape", F.schema_of_variant("node")
    )
    last = D.at("ord", -1)
    depth = F.size("path")
    out = nodes.select(
        "id",
        "path",
        depth.alias("depth"),
        F.when(depth > 0, F.slice("path", 1, F.greatest(depth - 1, F.lit(0)))).alias("parent"),
        F.when((depth > 0) & (last["pos"] < 0), last["key"]).alias("key"),
        F.when((depth > 0) & (last["pos"] >= 0), last["pos"]).alias("pos"),
        D.kind_of_shape(F.col("shape")).alias("kind"),
        "node",
        "ord",
    )
    return out.select(
        "id",
        "path",
        "depth",
        "parent",
        "key",
        "pos",
        "kind",
        F.when(F.col("kind") == "string", F.try_variant_get("node", "$", "string")).alias("v_str"),
        F.when(F.col("kind") == "number", F.try_variant_get("node", "$", "double")).alias("v_num"),
        F.when(F.col("kind") == "boolean", F.try_variant_get("node", "$", "boolean")).alias("v_bool"),
        F.when(~F.col("kind").isin("object", "array"), F.to_json("node")).alias("leaf"),
        "ord",
    )


def path_text(path="path"):
    """A node's path as readable text, ``$`` for the root."""
    return F.concat(F.lit("$"), F.array_join(path, ""))


def assemble_nodes(nodes: DataFrame) -> DataFrame:
    """JSON text per ``id`` from node rows; a group is one document and holds only its nodes."""
    parts = F.collect_list(F.struct("ord", "kind", "leaf"))
    return nodes.groupBy("id").agg(parts.alias("__n")).select(
        "id", D.print_nodes(F.col("__n")).alias("body")
    )

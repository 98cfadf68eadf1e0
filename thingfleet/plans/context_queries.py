"""Queries over members that documents explain by their own context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators.graph_diff import graph_diff
from ..operators.triples import assemble, own_contexts, triplify
from ..sources.fleet import ACCOUNT, PLACE, extended_documents
from ..sources.graphs import dedup, stored
from ..schema import QUAD_COLS
from ..vocab import RDF_TYPE, TD, XSD
from .registry import query


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return extended_documents(spark, sf).select("id", F.parse_json("body").alias("doc"))


_BASE = f"""
  SELECT c_custkey AS k, 'urn:account:' || c_custkey AS s, c_name, c_mktsegment, c_nationkey,
    CAST(c_acctbal AS DECIMAL(18,2)) AS balance,
    '{PLACE}' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'old/' END AS pre FROM customer"""


@query(f"""
WITH c AS ({_BASE}), q AS (
  SELECT k, s, '{ACCOUNT}balance' AS p, 'number' AS kind, CAST(CAST(balance AS DOUBLE) AS VARCHAR) AS o,
    CAST(NULL AS VARCHAR) AS o_dt FROM c
  UNION ALL SELECT k, s, '{ACCOUNT}open', 'literal', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, '{XSD}boolean' FROM c
  UNION ALL SELECT k, s, '{ACCOUNT}tier', 'literal', c_mktsegment, '{XSD}string' FROM c
  UNION ALL SELECT k, s, '{ACCOUNT}owner', 'iri', '{ACCOUNT}person/' || k, NULL FROM c
  UNION ALL SELECT k, s, '{ACCOUNT}since', 'literal', '2024-01-01', '{XSD}date' FROM c
  UNION ALL SELECT k, s, '{ACCOUNT}tags', 'literal', 'a', '{XSD}string' FROM c
  UNION ALL SELECT k, s, '{ACCOUNT}tags', 'literal', CAST(k % 7 AS VARCHAR), '{XSD}string' FROM c
  UNION ALL SELECT k, s, pre || 'place', 'bnode', 'nested', NULL FROM c WHERE k % 5 <> 0
  UNION ALL SELECT k, 'nested', pre || 'nation', 'number', CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR), NULL FROM c WHERE k % 5 <> 0
  UNION ALL SELECT k, 'nested', '{RDF_TYPE}', 'iri', pre || 'Place', NULL FROM c WHERE k % 5 <> 0
  UNION ALL SELECT k, s, '{TD}title', 'literal', c_name, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' FROM c)
SELECT 'http://example.com/graph/urn:account:' || k AS g, s, p, kind, o, o_dt FROM q
""")
def own_term_quads(spark: SparkSession, sf: str) -> DataFrame:
    """Every quad of documents with two vocabularies of their own; numbers by value, nested nodes by a word."""
    q = dedup(triplify(_documents(spark, sf)))
    number = F.col("o_num").isNotNull()
    nested = lambda c: F.when(F.col(c).startswith("_:"), "nested").otherwise(F.col(c)).alias(c)
    return q.select(
        "g",
        nested("s"),
        "p",
        F.when(number, "number").otherwise(F.col("o_kind")).alias("kind"),
        F.when(number, F.col("o_num").cast("string")).otherwise(nested("o")).alias("o"),
        F.when(~number, F.col("o_dt")).alias("o_dt"),
    )


@query(f"""
WITH c AS ({_BASE})
SELECT s AS id, c_name AS title, CAST(balance AS DOUBLE) AS balance, k % 2 = 0 AS open, c_mktsegment AS tier,
  '{ACCOUNT}person/' || k AS owner, '2024-01-01' AS since,
  CASE WHEN k % 5 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS nation, CASE WHEN k % 5 <> 0 THEN 'at:Place' END AS place,
  CAST(k % 7 AS VARCHAR) || ',a' AS tags,
  CASE WHEN k % 5 = 0 THEN '@context,acc:balance,acc:open,acc:tags,id,owner,since,tier,title'
    ELSE '@context,acc:balance,acc:open,acc:tags,at:place,id,owner,since,tier,title' END AS members
FROM c
""")
def own_term_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents from documents to quads and back: own members under their own names, unknown ones gone."""
    docs = _documents(spark, sf)
    back, _ = assemble(stored(dedup(triplify(docs))), own_contexts(docs))
    m = back.select("id", D.fields(F.parse_json("body")).alias("m"))
    get = lambda key: F.try_element_at("m", F.lit(key))
    text = lambda key: D.text_of(get(key))
    tags = F.array_sort(F.try_variant_get(get("acc:tags"), "$", "array<string>"))
    return m.select(
        "id",
        text("title").alias("title"),
        F.try_variant_get(get("acc:balance"), "$", "double").alias("balance"),
        F.try_variant_get(get("acc:open"), "$", "boolean").alias("open"),
        text("tier").alias("tier"),
        text("owner").alias("owner"),
        text("since").alias("since"),
        F.try_variant_get(get("at:place"), "$['at:nation']", "bigint").alias("nation"),
        F.try_variant_get(get("at:place"), "$['@type'][0]", "string").alias("place"),
        F.array_join(tags, ",").alias("tags"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("members"),
    )


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS no, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
c AS (SELECT 'g:' || k AS g, q FROM l WHERE no = 1 AND k % 4 = 0)
SELECT g, 'removed' AS change, 'urn:p:quantity' AS p, CAST(q AS VARCHAR) AS o, 'line' AS node FROM c
UNION ALL SELECT g, 'added', 'urn:p:quantity', CAST(q + 1000 AS VARCHAR), 'line' FROM c
""")
def graph_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as graphs with a blank node per line, loaded twice under other names: the lines changed between."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    g, quantity = F.concat(F.lit("g:"), "l_orderkey"), F.col("l_quantity").cast("bigint")
    changed = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 4 == 0), quantity + 1000).otherwise(quantity)

    def load(node: Column, amount: Column) -> DataFrame:
        node = F.concat(F.lit("_:"), node)
        root = F.concat(F.lit("urn:order:"), "l_orderkey")
        triple = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(f"urn:p:{p}").alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
        quads = lines.select(
            g.alias("g"),
            F.explode(F.array(
                triple(root, "line", node, "bnode"),
                triple(node, "part", F.col("l_partkey").cast("string"), "literal"),
                triple(node, "quantity", amount.cast("string"), "literal"),
            )).alias("t"),
        ).select("g", "t.*")
        none = lambda t: F.lit(None).cast(t)
        return quads.withColumns({"o_dt": none("string"), "o_lang": none("string"), "o_num": none("double"), "o_ts": none("timestamp")}).select(*QUAD_COLS)

    old = load(F.concat_ws("-", "l_orderkey", "l_linenumber"), quantity)
    new = load(F.sha1(F.concat_ws("-", "l_linenumber", "l_orderkey")), changed)
    found = graph_diff(old, new, ["urn:p:part"])
    return found.select("g", "change", "p", "o", F.when(F.col("s").startswith("_:"), "line").otherwise("order").alias("node"))

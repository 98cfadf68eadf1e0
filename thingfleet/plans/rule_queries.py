"""Validation queries: single kinds of rules over the business graph, the catalogue over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate as V
from ..operators.triples import triplify
from ..session import scratch
from ..sources import rules as R
from ..sources.fleet import customer_documents
from ..sources.graphs import COL, business_graph, dedup, stored
from ..functions import documents as D
from ..vocab import LANG_STRING, RDF_TYPE, TD, WOTSEC
from .registry import query

_REPORT = ["focus_node", "shape", "path", "constraint", "value"]


def _graph(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    quads = business_graph(spark, sf).quads()
    return quads.where(F.col("g").isin([f"urn:graph:{n}" for n in names]))


def _shape(table: str, *properties: R.Property) -> dict:
    return {table.capitalize(): (f"urn:class:{table}", list(properties))}


def _report(quads: DataFrame, rules: list[R.Rule], **how) -> DataFrame:
    return V.validate(quads, rules, **how).select(*_REPORT)


@query("""
SELECT 'urn:customer:' || c_custkey AS focus_node, 'Customer' AS shape, 'urn:rel:hasOrder' AS path, 'minCount' AS "constraint", CAST(NULL AS VARCHAR) AS value
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
SELECT 'urn:customer:' || o_custkey, 'Customer', 'urn:rel:hasOrder', 'maxCount', NULL FROM orders
WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) > 4
""")
def validate_min_max(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer must have one to four open orders; customers without any are found as well."""
    g = business_graph(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'P'")
    none = F.lit(None).cast("string")
    has = orders.select(
        F.lit("urn:graph:customer").alias("g"),
        F.concat(F.lit("urn:customer:"), "o_custkey").alias("s"),
        F.lit("urn:rel:hasOrder").alias("p"),
        F.concat(F.lit("urn:orders:"), "o_orderkey").alias("o"),
        F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"),
        none.cast("double").alias("o_num"), none.cast("timestamp").alias("o_ts"),
    )
    types = g.match(RDF_TYPE).where("g = 'urn:graph:customer'")
    prop = R.Property(("urn:rel:hasOrder",), "any", least=1, most=4)
    return _report(types.unionByName(has), R.expand(_shape("customer", prop)))


@query(f"""
SELECT 'urn:pages:' || page_id AS focus_node, 'Pages' AS shape, 'urn:col:url' AS path, 'datatype' AS "constraint", url AS value
FROM pages WHERE regexp_matches(url, '[\\s<>"{{}}|\\\\^`]')
UNION ALL
SELECT 'urn:documents:' || doc_id, 'Documents', 'urn:col:n_chars', 'datatype', CAST(n_chars AS VARCHAR) FROM documents
""")
def validate_datatype(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses must be well-formed; document lengths are asked to be strings, which none is."""
    shapes = {
        **_shape("pages", R.Property((COL + "url",), "uri")),
        **_shape("documents", R.Property((COL + "n_chars",), "loose")),
    }
    return _report(_graph(spark, sf, "pages", "documents"), R.expand(shapes))


@query("""
SELECT 'urn:customer:' || c_custkey AS focus_node, 'Customer' AS shape, 'urn:col:c_mktsegment' AS path, 'nodeKind' AS "constraint",
  c_mktsegment AS value FROM customer
""")
def validate_nodekind(spark: SparkSession, sf: str) -> DataFrame:
    """Nations must be addresses, which they are; segments are asked to be, which none is."""
    shape = _shape(
        "customer", R.Property((COL + "c_nation",), "iri"), R.Property((COL + "c_mktsegment",), "iri")
    )
    return _report(_graph(spark, sf, "customer"), R.expand(shape))


@query("""
SELECT 'urn:turn:' || conv_id || ':' || turn AS focus_node, 'Conversations' AS shape, 'urn:col:role' AS path, 'in' AS "constraint",
  role AS value FROM conversations WHERE role NOT IN ('user', 'system')
""")
def validate_in(spark: SparkSession, sf: str) -> DataFrame:
    prop = R.Property((COL + "role",), "word", among=("user", "system"))
    return _report(dedup(_graph(spark, sf, "conversations")), R.expand(_shape("conversations", prop)))


@query("""
SELECT 'urn:orders:' || o_orderkey AS focus_node, 'Orders' AS shape, 'urn:col:o_customer' AS path, 'node' AS "constraint",
  'urn:customer:' || o_custkey AS value
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
UNION ALL
SELECT 'urn:customer:' || c_custkey, 'Customer', 'urn:col:c_mktsegment', 'in', c_mktsegment
FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
""")
def validate_node(spark: SparkSession, sf: str) -> DataFrame:
    """An order is valid only with a valid customer. Both tables are read as one graph."""
    among = ("BUILDING", "MACHINERY", "HOUSEHOLD")
    shapes = {
        **_shape("customer", R.Property((COL + "c_mktsegment",), "word", among=among)),
        **_shape("orders", R.Property((COL + "o_customer",), "node", node="Customer")),
    }
    quads = _graph(spark, sf, "customer", "orders").withColumn("g", F.lit("urn:graph:trade"))
    return _report(quads, R.expand(shapes))


@query("""
SELECT 'urn:source:' || source AS focus_node, 'Source' AS shape, 'urn:rel:sample' AS path, 'uniqueLang' AS "constraint",
  lang AS value FROM documents GROUP BY source, lang HAVING count(DISTINCT md5(text)) > 1
""")
def validate_unique_lang(spark: SparkSession, sf: str) -> DataFrame:
    """A source may have one text per language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = F.lit(None).cast("string")
    row = lambda p, o, kind, tag: (
        F.lit("urn:graph:source").alias("g"), F.concat(F.lit("urn:source:"), "source").alias("s"),
        F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_dt"), tag.alias("o_lang"),
        none.cast("double").alias("o_num"), none.cast("timestamp").alias("o_ts"),
    )
    texts = docs.select(*row("urn:rel:sample", F.md5("text"), "literal", F.col("lang")))
    types = docs.select(*row(RDF_TYPE, F.lit("urn:class:source"), "iri", none))
    prop = R.Property(("urn:rel:sample",), "any", unique_lang=True)
    return _report(dedup(texts.unionByName(types)), R.expand(_shape("source", prop)))


@query("""
SELECT 'urn:orders:' || o_orderkey AS focus_node, 'Orders' AS shape, 'urn:col:o_orderstatus|urn:col:o_orderpriority' AS path, 'in' AS "constraint",
  value FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders)
WHERE value NOT IN ('F', 'O', '1-URGENT', '2-HIGH', '5-LOW')
""")
def validate_alt_path(spark: SparkSession, sf: str) -> DataFrame:
    """One rule for the values of two predicates."""
    prop = R.Property(
        (COL + "o_orderstatus", COL + "o_orderpriority"), "word",
        among=("F", "O", "1-URGENT", "2-HIGH", "5-LOW"),
    )
    return _report(_graph(spark, sf, "orders"), R.expand(_shape("orders", prop)))


# ---------------------------------------------------------------- the catalogue over documents


def _upgraded(spark: SparkSession, sf: str) -> DataFrame:
    docs = customer_documents(spark, sf).withColumn("m", D.fields(F.try_parse_json("body")))
    stored = D.bind(D.upgrade(F.col("m")), D.decorate_types)
    return docs.select("k", "id", F.to_variant_object(stored).alias("doc"))


def _quads(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(triplify(_upgraded(spark, sf)))


_FAULTS = f"""
  SELECT c_custkey AS k, '{TD}title' AS path, 'minCount' AS c FROM customer WHERE c_custkey % 50 = 7
  UNION ALL SELECT c_custkey, 'http://purl.org/dc/terms/created', 'datatype' FROM customer WHERE c_custkey % 11 = 4
  UNION ALL SELECT c_custkey, '{TD}hasPropertyAffordance|{TD}hasActionAffordance|{TD}hasEventAffordance', 'node'
    FROM customer WHERE c_custkey % 10 = 3
"""


@query(f"""
SELECT 'urn:customer:' || k AS focus_node, 'Thing' AS shape, path, c AS "constraint" FROM ({_FAULTS})
""")
def validate_report(spark: SparkSession, sf: str) -> DataFrame:
    found = V.validate(stored(_quads(spark, sf)), R.catalogue())
    return found.select("focus_node", "shape", "path", "constraint")


@query(f"""
SELECT 'http://example.com/graph/urn:customer:' || c.c_custkey AS g, count(f.k) = 0 AS conforms, count(f.k) AS n
FROM customer c LEFT JOIN ({_FAULTS}) f ON f.k = c.c_custkey GROUP BY c.c_custkey
""")
def conform_verdict(spark: SparkSession, sf: str) -> DataFrame:
    quads = stored(_quads(spark, sf))
    graphs = customer_documents(spark, sf).select(F.concat(F.lit("http://example.com/graph/"), "id").alias("g"))
    return V.verdict(graphs, V.validate(quads, R.catalogue()))


@query("""
SELECT 'urn:customer:' || c_custkey AS id, 'application/json' AS content_type, 'balance' AS part FROM customer
UNION ALL SELECT 'urn:customer:' || c_custkey, 'application/json', 'segment' FROM customer WHERE c_custkey % 10 <> 3
""")
def apply_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Forms with the content type they have when they name none."""
    quads = _quads(spark, sf)
    wanted = {"target": "https://www.w3.org/2019/wot/hypermedia#hasTarget", "content_type": "https://www.w3.org/2019/wot/hypermedia#forContentType"}
    wide = quads.where(F.col("p").isin(*wanted.values())).groupBy("g", "s").agg(
        *[F.max(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in wanted.items()]
    )
    default = R.defaults()[("Form", wanted["content_type"])]
    filled = V.apply_defaults(wide, {"content_type": default})
    return filled.select(
        F.replace("g", F.lit("http://example.com/graph/"), F.lit("")).alias("id"),
        "content_type",
        F.substring_index("target", "/", -1).alias("part"),
    )


@query("""
SELECT 'urn:customer:' || c_custkey AS id, 'authorizationRequired' AS "constraint", 'code' AS value
FROM customer WHERE c_custkey % 6 = 5 AND c_custkey % 4 <> 0
""")
def validate_oauth_flow(spark: SparkSession, sf: str) -> DataFrame:
    found = V.check_oauth(_quads(spark, sf), WOTSEC)
    return found.select(
        F.replace("g", F.lit("http://example.com/graph/"), F.lit("")).alias("id"), "constraint", "value"
    )


@query(f"""
SELECT 'urn:customer:' || c_custkey AS id, 'operationKind' AS "constraint", '{TD}invokeAction' AS value
FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 10 <> 3
""")
def validate_op_kind(spark: SparkSession, sf: str) -> DataFrame:
    found = V.check_operations(_quads(spark, sf), TD)
    return found.select(
        F.replace("g", F.lit("http://example.com/graph/"), F.lit("")).alias("id"), "constraint", "value"
    )


@query("""
SELECT 'urn:customer:' || c_custkey AS id, 'contextRequired' AS "constraint" FROM customer
WHERE c_custkey % 4 <> 2
""")
def validate_context(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming documents that do not name the current context themselves."""
    docs = customer_documents(spark, sf).withColumn("m", D.fields(F.try_parse_json("body")))
    return V.check_context(docs, "https://www.w3.org/2022/wot/td/v1.1")


@query("""
SELECT 'urn:documents:' || doc_id AS focus_node, lang AS value FROM documents
WHERE NOT regexp_matches(lang, '^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$') OR source LIKE 'src1%'
""")
def validate_language_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose tag is no language tag; those of one source get an underscore in theirs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tag = F.when(F.col("source").startswith("src1"), F.concat("lang", F.lit("_"))).otherwise(F.col("lang"))
    quads = docs.select(
        F.lit("urn:graph:documents").alias("g"), F.concat(F.lit("urn:documents:"), "doc_id").alias("s"),
        F.lit(COL + "text").alias("p"), F.lit("").alias("o"), F.lit("literal").alias("o_kind"),
        F.lit(LANG_STRING).alias("o_dt"), tag.alias("o_lang"),
    )
    return V.check_language_tags(quads).select(
        "focus_node", F.replace("value", F.lit("_"), F.lit("")).alias("value")
    )


@query(f"""
SELECT 'urn:customer:' || k AS focus_node, path, c AS "constraint" FROM ({_FAULTS}) WHERE c <> 'node'
""")
def rules_as_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rules written to a table and read back, of the things alone."""
    home = scratch(spark, "rules")
    R.as_table(spark, [r for r in R.catalogue() if r.shape == "Thing" and r.kind != "node"]).write.parquet(home)
    return V.validate(stored(_quads(spark, sf)), R.load(spark, home)).select("focus_node", "path", "constraint")

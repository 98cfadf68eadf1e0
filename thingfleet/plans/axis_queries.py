"""Queries over documents in XML form: steps along axes with positions, and the text itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axes as X
from ..session import kept_by, parts_of
from ..sources.fleet import customer_documents
from .registry import query


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    """The element table of the customers' documents, written once for all steps."""
    docs = customer_documents(spark, sf).select("id", F.parse_json("body").alias("doc"))
    parts = parts_of(docs)
    return kept_by(X.elements(docs, parts=parts), "elements", "id", parts)


@query("""
WITH c AS (SELECT c_custkey AS k, 'urn:customer:' || c_custkey AS id, c_mktsegment AS said FROM customer)
SELECT id, 'item' AS part, 'enum' AS name, said AS value FROM c
UNION ALL SELECT id, 'next item', 'enum', 'OTHER' FROM c
UNION ALL SELECT id, 'parent', 'forms', NULL FROM c WHERE k % 10 <> 3
UNION ALL SELECT id, 'ancestor', 'segment', NULL FROM c WHERE k % 10 <> 3
UNION ALL SELECT id, 'third before',
  CASE WHEN k % 2 = 0 THEN 'hasSecurityConfiguration' ELSE 'description' END,
  CASE WHEN k % 2 = 1 THEN said || ' account' WHEN k % 5 = 0 THEN 'missing_sc' ELSE 'basic_sc' END FROM c
UNION ALL SELECT id, 'second inside', 'href', 'https://x.example/' || k || '/segment' FROM c WHERE k % 10 <> 3
""")
def xpath_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Parent, ancestor, sibling and descendant steps with positions, every hit of every document."""
    table = _elements(spark, sf)
    enum = X.path(table, ("descendant", "enum"))
    first = X.path(table, ("child", "properties"), ("child", "segment"), ("child", "enum", None, 1))
    ops = X.path(table, ("descendant", "op"))
    properties = X.path(table, ("child", "properties"))
    parts = {
        "item": first,
        "next item": X.step(first, table, "following-sibling", "enum", position=1),
        "parent": X.step(ops, table, "parent"),
        "ancestor": X.step(X.step(enum, table, "following", "op"), table, "ancestor", "segment"),
        "third before": X.step(properties, table, "preceding-sibling", position=3),
        "second inside": X.step(properties, table, "descendant", "href", position=2),
    }
    found = [df.select("id", F.lit(part).alias("part"), "name", "value") for part, df in parts.items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query("""
SELECT 'urn:customer:' || c_custkey AS id, c_mktsegment AS segment, 'urn:customer:' || c_custkey AS said,
  CAST(CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 2 END AS BIGINT) AS forms FROM customer
""")
def xml_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The XML text of every document, read back by the functions for XML columns."""
    return X.to_xml(_elements(spark, sf)).select(
        "id",
        F.xpath_string("xml", F.lit("/ObjectNode/properties/segment/enum[1]")).alias("segment"),
        F.xpath_string("xml", F.lit("/ObjectNode/id")).alias("said"),
        F.xpath_double("xml", F.lit("count(/ObjectNode/properties/*/forms)")).cast("bigint").alias("forms"),
    )

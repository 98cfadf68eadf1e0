"""The physical shape of plans that matter at scale."""

import pytest
from conftest import docs_df, lamp
from pyspark.sql import functions as F

from thingfleet.functions import documents as D
from thingfleet.operators.nodes import explode_nodes, flatten, path_text
from thingfleet.operators.triples import triplify
from thingfleet.plans.catalogue import QUERIES
from thingfleet.sources.graphs import dedup

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_star_reads_only_its_columns_and_joins_nothing(spark):
    text = plan(QUERIES["bgp_star_fused"](spark, SF))
    assert "Join" not in text and "Exchange" not in text
    assert "c_nationkey" not in text.split("ReadSchema")[1]


def test_constants_are_pushed_to_the_scan(spark):
    text = plan(QUERIES["graph_constant"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(o_total" in text


@pytest.mark.parametrize("name", ["compat_join", "minus_unbound", "bgp_cross", "theta_join", "values_undef"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_document_work_does_not_shuffle(spark):
    docs = docs_df(spark, lamp(id="urn:a"))
    for df in (flatten(docs), triplify(docs)):
        assert "Exchange hash" not in plan(df) and "SinglePartition" not in plan(df)
    hit = docs.where(D.Path().deep("href").found(F.col("doc")))
    assert "Exchange" not in plan(hit)


def test_depth_beyond_the_fast_levels_is_complete(spark):
    deep = {"id": "urn:deep", "x": [1]}
    for i in range(30):
        deep = {"id": "urn:deep", "x": [deep, i]}
    docs = docs_df(spark, deep)
    few = explode_nodes(docs.select("id", "doc"), levels=2).select(path_text().alias("p"))
    many = explode_nodes(docs.select("id", "doc"), levels=70).select(path_text().alias("p"))
    assert {r.p for r in few.collect()} == {r.p for r in many.collect()}
    schema = {"type": "integer"}
    for _ in range(12):
        schema = {"type": "object", "properties": {"p": schema}}
    quads = dedup(triplify(docs_df(spark, lamp(id="urn:s", schemaDefinitions={"d": schema}))))
    assert quads.where("p like '%json-schema#properties'").count() == 12
    assert quads.where("o like '%IntegerSchema'").count() == 1
    linked = quads.where("o_kind = 'bnode'").select(F.col("o").alias("s")).distinct()
    assert quads.where("s like '_:%'").select("s").distinct().join(linked, "s", "left_anti").count() == 0

"""Sharing out the rows of an input."""

from pyspark.sql import functions as F

from thingfleet.functions import contexts as C
from thingfleet.session import spread


def test_parts_grow_with_the_rows(spark):
    few = spark.range(0, 1000, 1, 1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(few, rows=10).rdd.getNumPartitions() == 100
    assert spread(spark.range(0, 1000, 1, 200), rows=10).rdd.getNumPartitions() == 200
    assert spread(few, rows=10).agg(F.sum("id")).first()[0] == 499500


def test_filters_stay_behind_the_shuffle(spark, tmp_path):
    spark.range(100).selectExpr("id", "concat('{\"k\":', id, '}') AS body").write.parquet(f"{tmp_path}/t")
    rows = spread(spark.read.parquet(f"{tmp_path}/t").coalesce(1), rows=10).withColumn("doc", F.parse_json("body"))
    found = rows.where(F.try_variant_get("doc", "$.k", "bigint") > 97)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "try_variant_get" not in below and "parse_json" not in below
    assert sorted(r.id for r in found.collect()) == [98, 99]


def test_own_terms_are_worked_out_once(spark):
    # many terms that build on each other: work of a power of their number would not end
    names = ",".join(f'"t{i}":"p:{i}"' for i in range(300))
    doc = '{"@context":[{"p":"q:p/","q":"https://q.example/","t0":"p:old"},{' + names + '},{"t1":null}]}'
    got = spark.createDataFrame([(doc,)], "body string").select(C.own_terms(F.parse_json("body")).alias("t")).first().t
    assert len(got) == 301 and "t1" not in got
    assert got["t0"].iri == "https://q.example/p/0" and got["t299"].iri == "https://q.example/p/299"


def test_even_graphs_deal_the_rows_of_their_tables(spark):
    from thingfleet.sources.graphs import business_graph

    sf = "/root/testdata/sf0.001"
    tables = {e.subject._jc.toString(): e.table for e in business_graph(spark, sf, even=True)._entities}
    assert min(t.rdd.getNumPartitions() for t in tables.values()) >= spark.sparkContext.defaultParallelism


def test_rules_of_a_table_read_the_quads_from_storage(spark):
    from thingfleet.plans.catalogue import QUERIES

    found = QUERIES["rules_as_table"](spark, "/root/testdata/sf0.001")
    assert "variant_explode" not in found._jdf.queryExecution().optimizedPlan().toString()

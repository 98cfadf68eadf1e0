"""Queries over the business tables seen as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.term_order import sort_key
from ..operators import aggregates as agg
from ..operators import algebra as al
from ..operators import property_paths as pp
from ..operators.ordered import positions
from ..sources.graphs import COL, PART_OF, QuadTable, business_graph, conversation_links, dedup
from ..vocab import RDF_TYPE, XSD
from .patterns import bgp, lang, num, time, triple
from .registry import query


def _t(s: str, column: str, o) -> object:
    return triple(s, column if ":" in column else COL + column, o)


@query("""
SELECT n.n_name AS nation, r.r_name AS region, count(*) AS customers
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2
""")
def bgp_region_count(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    customers = bgp(g, [_t("?c", "c_nation", "?n")])
    # the customers are counted per nation before anything is joined to them
    counted = customers.groupBy("n").agg(agg.count().alias("customers"))
    named = bgp(
        g,
        [_t("?n", "n_name", "?nation"), _t("?n", "n_region", "?r"), _t("?r", "r_name", "?region")],
    )
    return (
        al.join(counted, named)
        .groupBy("nation", "region")
        .agg(F.sum("customers").alias("customers"))
        .orderBy("region", "nation")
    )


@query("""
SELECT 'urn:customer:' || c_custkey AS customer, c_name AS name, c_acctbal AS balance,
  c_mktsegment AS segment FROM customer
""")
def bgp_star_fused(spark: SparkSession, sf: str) -> DataFrame:
    return bgp(
        business_graph(spark, sf),
        [
            _t("?customer", "c_name", "?name"),
            _t("?customer", "c_acctbal", num("?balance")),
            _t("?customer", "c_mktsegment", "?segment"),
        ],
        g="?g",
    ).select("customer", "name", "balance", "segment")


@query("""
SELECT o.o_orderpriority AS priority, c.c_mktsegment AS segment, count(*) AS orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
""")
def bgp_two_stars(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [
            _t("?o", "o_customer", "?c"),
            _t("?o", "o_orderpriority", "?priority"),
            _t("?c", "c_mktsegment", "?segment"),
        ],
    )
    return rows.groupBy("priority", "segment").agg(agg.count().alias("orders"))


@query("""
SELECT c.c_mktsegment AS segment, r.r_name AS region, count(*) AS pairs
FROM customer c CROSS JOIN region r GROUP BY 1, 2
""")
def bgp_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Two patterns without a common variable: each side is counted by its group before they are multiplied."""
    g = business_graph(spark, sf)
    customers = bgp(g, [_t("?c", "c_mktsegment", "?segment")]).groupBy("segment").agg(agg.count().alias("n"))
    regions = bgp(g, [_t("?r", "r_name", "?region")]).groupBy("region").agg(agg.count().alias("m"))
    return al.product(customers, regions).select("segment", "region", (F.col("n") * F.col("m")).alias("pairs"))


@query("""
SELECT 'urn:graph:customer' AS g, 'urn:customer:' || c_custkey AS s, c_name AS name FROM customer
""")
def graph_var(spark: SparkSession, sf: str) -> DataFrame:
    return bgp(business_graph(spark, sf), [_t("?s", "c_name", "?name")], g="?g").select("g", "s", "name")


@query("""
SELECT g, p, count(*) AS n FROM (
  SELECT 'urn:graph:nation' AS g, unnest(['urn:col:n_name', 'urn:col:n_region', 'urn:rel:partOf',
    'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM nation
  UNION ALL
  SELECT 'urn:graph:orders', unnest(['urn:col:o_customer', 'urn:col:o_orderstatus',
    'urn:col:o_totalprice', 'urn:col:o_orderdate', 'urn:col:o_orderpriority', 'urn:rel:partOf',
    'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) FROM orders)
GROUP BY 1, 2
""")
def graph_scan(spark: SparkSession, sf: str) -> DataFrame:
    quads = bgp(business_graph(spark, sf), [triple("?s", "?p", "?o")], g="?g")
    chosen = quads.where(F.col("g").isin("urn:graph:nation", "urn:graph:orders"))
    return chosen.groupBy("g", "p").agg(agg.count().alias("n"))


@query("""
SELECT 'urn:orders:' || o_orderkey AS o, o_orderstatus AS status FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000
""")
def graph_constant(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?o", "o_orderstatus", "?status"), _t("?o", "o_totalprice", num("?price"))],
        g="urn:graph:orders",
    )
    return rows.where("status = 'F' and price > 100000").select("o", "status")


@query("""
SELECT 'urn:documents:' || d.doc_id AS d, d.source AS source, CAST(l.quality AS DOUBLE) AS quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def optional_label(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    docs = bgp(g, [_t("?d", "source", "?source")])
    labels = bgp(g, [_t("?l", "about", "?d"), _t("?l", "quality", num("?quality"))])
    return al.optional(docs, labels.drop("l"), None, [], []).select("d", "source", "quality")


@query("""
SELECT 'urn:documents:' || d.doc_id AS d, CAST(d.n_chars AS DOUBLE) AS n_chars,
  CAST(l.toxic AS DOUBLE) AS toxic
FROM documents d LEFT JOIN labels l
  ON l.doc_id = d.doc_id AND l.quality = 1 AND d.n_chars > 500
""")
def optional_filter_inside(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    docs = bgp(g, [_t("?d", "n_chars", num("?n_chars"))])
    labels = bgp(
        g,
        [
            _t("?l", "about", "?d"),
            _t("?l", "quality", num("?quality")),
            _t("?l", "toxic", num("?toxic")),
        ],
    ).drop("l")
    out = al.optional(docs, labels, (F.col("quality") == 1) & (F.col("n_chars") > 500), [], [])
    return out.select("d", "n_chars", "toxic")


@query("""
WITH a AS (SELECT d.doc_id AS d, CAST(l.quality AS DOUBLE) AS q FROM documents d
             LEFT JOIN labels l ON l.doc_id = d.doc_id),
     b AS (SELECT doc_id AS d, CASE WHEN toxic = 0 THEN CAST(1 - quality AS DOUBLE) END AS q, toxic FROM labels)
SELECT 'urn:documents:' || a.d AS d, coalesce(a.q, b.q) AS q, CAST(b.toxic AS DOUBLE) AS toxic
FROM a JOIN b ON a.d = b.d AND (a.q = b.q OR a.q IS NULL OR b.q IS NULL)
""")
def compat_join(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    docs = bgp(g, [_t("?d", "source", "?source")]).select("d")
    labels = bgp(
        g,
        [
            _t("?l", "about", "?d"),
            _t("?l", "quality", num("?q")),
            _t("?l", "toxic", num("?toxic")),
        ],
    )
    a = al.optional(docs, labels.select("d", "q"), None, [], [])
    b = labels.select("d", F.when(F.col("toxic") == 0, 1 - F.col("q")).alias("q"), "toxic")
    return al.compat_join(a, b, left_unbound=["q"], right_unbound=["q"]).select("d", "q", "toxic")


@query("""
SELECT c_name AS name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 60 * c.c_acctbal)
""")
def exists_order(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    customers = bgp(g, [_t("?c", "c_name", "?name"), _t("?c", "c_acctbal", num("?balance"))])
    orders = bgp(g, [_t("?o", "o_customer", "?c"), _t("?o", "o_totalprice", num("?price"))])
    return al.exists(customers, orders, F.col("price") > 60 * F.col("balance"), [], []).select("name")


@query("""
SELECT c_name AS name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW')
""")
def not_exists_order(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    customers = bgp(g, [_t("?c", "c_name", "?name")])
    low = [_t("?o", "o_customer", "?c"), _t("?o", "o_orderpriority", "5-LOW")]
    orders = bgp(g, low).select("c")
    return al.not_exists(customers, orders, None, [], []).select("name")


@query("""
SELECT c_name AS name FROM customer c WHERE c_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
""")
def minus_shared(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    customers = bgp(g, [_t("?c", "c_name", "?name")])
    orders = bgp(g, [_t("?o", "o_customer", "?c"), _t("?o", "o_orderstatus", "O")]).select("c")
    return al.minus(customers, orders, left_unbound=[], right_unbound=[]).select("name")


@query("SELECT c_name AS name FROM customer")
def minus_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    orders = bgp(g, [_t("?o", "o_orderstatus", "?status")])
    return al.minus(bgp(g, [_t("?c", "c_name", "?name")]).select("name"), orders)


@query("""
WITH a AS (SELECT d.doc_id AS d, l.quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
     b AS (SELECT doc_id AS d, CASE WHEN toxic = 0 THEN quality END AS q FROM labels)
SELECT 'urn:documents:' || a.d AS d, CAST(a.q AS DOUBLE) AS q FROM a
WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.d = b.d AND (a.q = b.q OR a.q IS NULL OR b.q IS NULL))
""")
def minus_unbound(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    docs = bgp(g, [_t("?d", "source", "?source")]).select("d")
    labels = bgp(
        g,
        [
            _t("?l", "about", "?d"),
            _t("?l", "quality", num("?q")),
            _t("?l", "toxic", num("?toxic")),
        ],
    )
    a = al.optional(docs, labels.select("d", "q"), None, [], [])
    b = labels.select("d", F.when(F.col("toxic") == 0, F.col("q")).alias("q"))
    return al.minus(a, b, left_unbound=["q"], right_unbound=["q"]).select("d", "q")


@query("""
SELECT c.c_name AS name, v.label AS label FROM customer c
JOIN (VALUES ('BUILDING', 'houses'), ('MACHINERY', 'machines')) v(segment, label)
  ON c.c_mktsegment = v.segment
""")
def values_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?c", "c_name", "?name"), _t("?c", "c_mktsegment", "?segment")],
    )
    inline = [("BUILDING", "houses"), ("MACHINERY", "machines")]
    return al.values(rows, ["segment", "label"], inline, []).select("name", "label")


@query("""
SELECT c_name AS name, c_mktsegment AS segment FROM customer
WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3
  UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3
""")
def values_undef(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [
            _t("?c", "c_name", "?name"),
            _t("?c", "c_mktsegment", "?segment"),
            _t("?c", "c_nation", "?nation"),
        ],
    )
    inline = [("BUILDING", None), (None, "urn:nation:3")]
    return al.values(rows, ["segment", "nation"], inline, []).select("name", "segment")


@query("""
SELECT 'urn:orders:' || o.o_orderkey AS o, 'urn:customer:' || c.c_custkey AS c
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice < 20 * c.c_acctbal
""")
def theta_join(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    orders = bgp(g, [_t("?o", "o_customer", "?c"), _t("?o", "o_totalprice", num("?price"))])
    customers = bgp(g, [_t("?c", "c_acctbal", num("?balance"))])
    return al.theta(orders, customers, F.col("price") < 20 * F.col("balance")).select("o", "c")


@query("""
SELECT 'urn:orders:' || o_orderkey AS s, 'urn:nation:' || c_nationkey AS o
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def path_seq(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    return pp.seq(pp.edges(g, COL + "o_customer"), pp.edges(g, COL + "c_nation"))


@query("SELECT 'urn:customer:' || o_custkey AS s, 'urn:orders:' || o_orderkey AS o FROM orders")
def path_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return pp.inverse(pp.edges(business_graph(spark, sf), COL + "o_customer"))


@query("""
SELECT 'urn:customer:' || c_custkey AS s, 'urn:nation:' || c_nationkey AS o FROM customer
UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier
""")
def path_alt(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    return pp.alternative(pp.edges(g, COL + "c_nation"), pp.edges(g, COL + "s_nation"))


@query("""
SELECT 'urn:customer:' || c_custkey AS s, unnest([c_mktsegment, 'urn:nation:' || c_nationkey]) AS o
FROM customer
""")
def path_negated(spark: SparkSession, sf: str) -> DataFrame:
    quads = business_graph(spark, sf).quads().where("g = 'urn:graph:customer'")
    return pp.negated(quads, COL + "c_name", COL + "c_acctbal", PART_OF, RDF_TYPE)


@query("""
SELECT 'urn:turn:' || a.conv_id || ':' || a.turn AS s, 'urn:turn:' || b.conv_id || ':' || b.turn AS o
FROM (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1) a
JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn > a.turn
""")
def path_plus(spark: SparkSession, sf: str) -> DataFrame:
    """From the first turn of each conversation to every later one."""
    links = conversation_links(spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    start = first.select(
        F.concat(F.lit("urn:turn:"), "conv_id", F.lit(":"), "turn").alias("s")
    )
    return pp.one_or_more(links, start)


@query("""
WITH t AS (SELECT 'urn:orders:' || o_orderkey AS s, 'urn:customer:' || o_custkey AS c,
    'urn:nation:' || n_nationkey AS n, 'urn:region:' || n_regionkey AS r
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT s, unnest([s, c, n, r]) AS o FROM t
""")
def path_star(spark: SparkSession, sf: str) -> DataFrame:
    """From each order to itself and all it is part of."""
    g = business_graph(spark, sf)
    start = bgp(g, [_t("?s", RDF_TYPE, "urn:class:orders")])
    return pp.zero_or_more(pp.edges(g, PART_OF), start)


@query("""
WITH e AS (SELECT 'urn:orders:' || o_orderkey AS s, 'urn:customer:' || o_custkey AS o FROM orders
  UNION SELECT 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey FROM customer
  UNION SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier
  UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation),
e2 AS (SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s), e3 AS (SELECT a.s, b.o FROM e2 a JOIN e b ON a.o = b.s)
SELECT s, o FROM e UNION SELECT s, o FROM e2 UNION SELECT s, o FROM e3
""")
def path_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that is part of something, however indirectly; both ends open."""
    return pp.one_or_more(pp.edges(business_graph(spark, sf), PART_OF))


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT 'urn:turn:' || a.conv_id || ':' || a.turn AS s, 'urn:turn:' || b.conv_id || ':' || b.turn AS o
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn IN (a.turn, a.turn + 1)
""")
def path_opt(spark: SparkSession, sf: str) -> DataFrame:
    turns = bgp(business_graph(spark, sf), [_t("?s", RDF_TYPE, "urn:class:conversations")])
    return pp.zero_or_one(conversation_links(spark, sf), turns)


@query("""
SELECT t.o AS o, t.price AS price, c.c_name AS name FROM
  (SELECT 'urn:orders:' || o_orderkey AS o, o_totalprice AS price, o_custkey FROM orders
   ORDER BY o_totalprice DESC, 'urn:orders:' || o_orderkey LIMIT 25) t
JOIN customer c ON t.o_custkey = c.c_custkey
""")
def subquery_topk(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    orders = bgp(g, [_t("?o", "o_customer", "?c"), _t("?o", "o_totalprice", num("?price"))])
    top = al.slice_solutions(orders.orderBy(F.desc("price"), "o"), 25)
    return al.join(top, bgp(g, [_t("?c", "c_name", "?name")])).select("o", "price", "name")


@query("""
SELECT c.c_name AS name, e.event_id AS event FROM customer c JOIN events e ON e.user_id = c.c_custkey
""")
def federate_join(spark: SparkSession, sf: str) -> DataFrame:
    local = bgp(business_graph(spark, sf), [_t("?c", "c_name", "?name")])
    remote = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("urn:customer:"), "user_id").alias("c"), F.col("event_id").alias("event")
    )
    return al.federate(local, remote).select("name", "event")


@query("""
SELECT c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier
""")
def union_vars(spark: SparkSession, sf: str) -> DataFrame:
    g = business_graph(spark, sf)
    a = bgp(g, [_t("?c", "c_name", "?name"), _t("?c", "c_mktsegment", "?segment")])
    b = bgp(g, [_t("?c", "s_name", "?name"), _t("?c", "s_acctbal", num("?balance"))])
    return al.union(a, b).select("name", "segment", "balance")


@query("""
SELECT DISTINCT s, p, o, o_kind FROM (
  SELECT 'urn:customer:' || o_custkey AS s, 'urn:rel:hasStatus' AS p, o_orderstatus AS o, 'literal' AS o_kind FROM orders
  UNION ALL SELECT 'urn:orders:' || o_orderkey, 'urn:rel:placedBy', 'urn:customer:' || o_custkey, 'iri' FROM orders)
""")
def construct_triples(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?o", "o_customer", "?c"), _t("?o", "o_orderstatus", "?status")],
    )
    template = [
        (F.col("c"), F.lit("urn:rel:hasStatus"), F.col("status"), "literal"),
        (F.col("o"), F.lit("urn:rel:placedBy"), F.col("c"), "iri"),
    ]
    return al.construct(rows, template)


@query("""
WITH d AS (SELECT c.* FROM customer c WHERE EXISTS (SELECT 1 FROM orders o
    WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT'))
SELECT 'urn:customer:' || c_custkey AS s, unnest(['urn:col:c_name', 'urn:col:c_nation', 'urn:col:c_mktsegment']) AS p,
  unnest([c_name, 'urn:nation:' || c_nationkey, c_mktsegment]) AS o FROM d
""")
def describe_cbd(spark: SparkSession, sf: str) -> DataFrame:
    """Everything about the customers with an urgent order, but for numbers and links."""
    g = business_graph(spark, sf)
    urgent = bgp(g, [_t("?o", "o_customer", "?s"), _t("?o", "o_orderpriority", "1-URGENT")])
    about = al.describe(g.quads().where("g = 'urn:graph:customer'"), urgent)
    return about.where(
        ~F.col("p").isin(PART_OF, RDF_TYPE) & F.col("o_num").isNull()
    ).select("s", "p", "o")


@query("SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'P'")
def ask_any(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?o", "o_totalprice", num("?price")), _t("?o", "o_orderstatus", "P")],
    )
    return al.ask_rows(rows.where("price > 200000"))


@query("""
SELECT o_orderpriority AS priority, count(*) AS orders,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
  round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most
FROM orders GROUP BY 1 HAVING count(*) > 10
""")
def agg_group_having(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?o", "o_orderpriority", "?priority"), _t("?o", "o_totalprice", num("?price"))],
    )
    exact = F.col("price").cast("decimal(18,2)")
    return (
        rows.groupBy("priority")
        .agg(
            agg.count().alias("orders"),
            agg.total(exact).cast("double").alias("total"),
            F.round(agg.mean(F.col("price")), 4).alias("mean"),
            agg.least(F.col("price")).alias("least"),
            agg.greatest(F.col("price")).alias("most"),
        )
        .where("orders > 10")
    )


@query("""
SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS nations, count(*) AS customers
FROM customer GROUP BY 1
""")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?c", "c_mktsegment", "?segment"), _t("?c", "c_nation", "?nation")],
    )
    return rows.groupBy("segment").agg(
        agg.count(F.col("nation"), distinct=True).alias("nations"), agg.count().alias("customers")
    )


@query("SELECT c_mktsegment AS segment, min(c_name) AS someone FROM customer GROUP BY 1")
def agg_sample_min(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf), [_t("?c", "c_mktsegment", "?segment"), _t("?c", "c_name", "?name")]
    )
    return rows.groupBy("segment").agg(agg.sample(F.col("name")).alias("someone"))


@query("""
SELECT 'urn:nation:' || c_nationkey AS nation, string_agg(segment, ' ' ORDER BY segment) AS segments
FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS segment FROM customer) GROUP BY 1
""")
def agg_group_concat(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf), [_t("?c", "c_nation", "?nation"), _t("?c", "c_mktsegment", "?segment")]
    )
    return agg.group_concat(rows, ["nation"], "segment", " ", distinct=True, name="segments")


@query("""
SELECT event_type AS kind,
  CASE WHEN count(*) FILTER (WHERE bad) = 0
    THEN CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS DOUBLE) END AS total
FROM (SELECT event_type, value, event_type = 'error' AND value > 100 AS bad FROM events) GROUP BY 1
""")
def agg_sum_error(spark: SparkSession, sf: str) -> DataFrame:
    """A group with a member that is no number has no sum."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = F.when(
        (F.col("event_type") == "error") & (F.col("value") > 100), F.lit("much")
    ).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    number = T.number(F.col("amount"))
    return (
        events.select(F.col("event_type").alias("kind"), text.alias("amount"))
        .groupBy("kind")
        .agg(agg.total_number(number)["approx"].alias("total"))
    )


@query("SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
def distinct_terms(spark: SparkSession, sf: str) -> DataFrame:
    return bgp(
        business_graph(spark, sf), [_t("?p", "p_brand", "?brand"), _t("?p", "p_type", "?type")]
    ).select("brand", "type").distinct()


@query("""
SELECT 'urn:part:' || p_partkey AS p, p_name AS name, p_retailprice AS price FROM part
ORDER BY p_retailprice DESC, 'urn:part:' || p_partkey LIMIT 30 OFFSET 10
""")
def orderby_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?p", "p_name", "?name"), _t("?p", "p_retailprice", num("?price"))],
    )
    ordered = al.order_solutions(rows, F.desc("price"), F.col("p"))
    return al.slice_solutions(ordered, 30, 10).select("p", "name", "price")


@query("""
WITH t AS (
  SELECT o_orderkey AS k, o_orderkey % 9 AS kind, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate AS day,
    o_orderpriority AS said FROM orders
), v AS (
  SELECT k,
    CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5
      WHEN 7 THEN 6 ELSE 7 END AS grade,
    CASE kind WHEN 3 THEN price * CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END WHEN 4 THEN CAST(k AS DECIMAL(18,2)) * 100 END AS number,
    CASE kind WHEN 1 THEN 'b' || k WHEN 2 THEN 'urn:order:' || k WHEN 5 THEN said WHEN 7 THEN said
      WHEN 8 THEN CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END END AS text,
    CASE WHEN kind = 6 THEN CASE WHEN k % 2 = 0 THEN day ELSE day - INTERVAL 2 HOUR END END AS moment,
    CASE WHEN kind = 7 THEN CASE WHEN k % 4 = 0 THEN 'de' ELSE 'en' END END AS tag
  FROM t
)
SELECT k, row_number() OVER (ORDER BY grade, number, text, moment, tag, k) AS up,
  row_number() OVER (ORDER BY grade DESC, number DESC, text DESC, moment DESC, tag DESC, k) AS down FROM v
""")
def orderby_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Places of solutions by a variable that holds terms of all kinds, upwards and downwards."""
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 9
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    term = (
        F.when(kind == 0, T.make_iri(F.lit(None)))
        .when(kind == 1, T.make_bnode(F.concat(F.lit("b"), k)))
        .when(kind == 2, T.make_iri(F.concat(F.lit("urn:order:"), k)))
        .when(kind == 3, T.typed_literal(F.concat(F.when(k % 2 == 0, "-").otherwise("00"), price, F.lit("0")), XSD + "decimal"))
        .when(kind == 4, T.typed_literal(F.concat(k, F.lit("e2")), XSD + "double"))
        .when(kind == 5, T.typed_literal(F.col("o_orderpriority"), XSD + "string"))
        .when(kind == 6, T.typed_literal(F.concat(day, F.when(k % 2 == 0, ".0Z").otherwise("+02:00")), XSD + "dateTime"))
        .when(kind == 7, T.lang_literal(F.col("o_orderpriority"), F.when(k % 4 == 0, "DE").otherwise("en")))
        .otherwise(T.typed_literal(F.when(k % 2 == 0, "true").otherwise("0"), XSD + "boolean"))
    )
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("k"), term.alias("t"))
    keyed = rows.select("k", sort_key(*(F.col(f"t.{c}") for c in ("o", "o_kind", "o_dt", "o_lang"))).alias("key"))
    up = positions(keyed, [F.col("key"), F.col("k")], "up", 1)
    return positions(up, [F.col("key").desc(), F.col("k")], "down", 1).select("k", "up", "down")


@query("""
SELECT o_custkey AS c, count(*) AS orders, year(min(o_orderdate)) AS since
FROM orders GROUP BY 1
""")
def agg_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?o", "o_customer", "?customer"), _t("?o", "o_orderdate", time("?d"))],
    )
    return (
        rows.groupBy("customer")
        .agg(agg.count().alias("orders"), F.year(agg.least(F.col("d"))).cast("bigint").alias("since"))
        .select(T.str_after(F.col("customer"), "urn:customer:").cast("bigint").alias("c"), "orders", "since")
    )


@query("""
SELECT 'urn:documents:' || doc_id AS d, length(text) AS strlen, upper(source) AS ucase,
  lower(lang) AS lcase, substring(text, 3, 7) AS substr,
  CASE WHEN position(' ' IN text) > 0 THEN substring(text, 1, position(' ' IN text) - 1) ELSE '' END AS before_space,
  CASE WHEN position('. ' IN text) > 0 THEN md5(substring(text, position('. ' IN text) + 2)) ELSE md5('') END AS after_stop,
  starts_with(text, 'A') AS starts, ends_with(text, '.') AS ends, contains(text, 'the') AS has,
  regexp_matches(text, 'https?://') AS has_link, concat(lang, '/', source) AS joined,
  md5(replace(text, 'e', 'E')) AS replaced
FROM documents
""")
def fn_strings(spark: SparkSession, sf: str) -> DataFrame:
    docs = bgp(
        business_graph(spark, sf),
        [_t("?d", "text", "?text"), _t("?d", "source", "?source"), _t("?d", "lang", "?lang")],
    )
    text = F.col("text")
    return docs.select(
        "d",
        F.length(text).cast("bigint").alias("strlen"),
        F.upper("source").alias("ucase"),
        F.lower("lang").alias("lcase"),
        T.substr(text, 3, 7).alias("substr"),
        T.str_before(text, " ").alias("before_space"),
        F.md5(T.str_after(text, ". ")).alias("after_stop"),
        text.startswith("A").alias("starts"),
        text.endswith(".").alias("ends"),
        text.contains("the").alias("has"),
        T.regex(text, "https?://").alias("has_link"),
        F.concat("lang", F.lit("/"), "source").alias("joined"),
        F.md5(T.replace(text, "e", "E")).alias("replaced"),
    )


@query("""
SELECT p_partkey AS p, abs(p_retailprice - 1000) AS distance, CAST(ceil(p_retailprice) AS BIGINT) AS up,
  CAST(floor(p_retailprice) AS BIGINT) AS down, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS nearest,
  CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class,
  p_size IN (1, 2, 3) AS tiny, p_size NOT IN (1, 2, 3) AS not_tiny
FROM part
""")
def fn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(
        business_graph(spark, sf),
        [_t("?p", "p_retailprice", num("?price")), _t("?p", "p_size", num("?size"))],
    )
    price, size = F.col("price"), F.col("size")
    return rows.select(
        T.str_after(F.col("p"), "urn:part:").cast("bigint").alias("p"),
        F.abs(price - 1000).alias("distance"),
        F.ceil(price).cast("bigint").alias("up"),
        F.floor(price).cast("bigint").alias("down"),
        T.round_half_up(price).cast("bigint").alias("nearest"),
        F.when(size > 25, "large").otherwise("small").alias("size_class"),
        size.isin(1, 2, 3).alias("tiny"),
        (~size.isin(1, 2, 3)).alias("not_tiny"),
    )


@query("""
SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
  hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS age, 'Z' AS tz, 0 AS offset_minutes
FROM orders
""")
def fn_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(business_graph(spark, sf), [_t("?o", "o_orderdate", time("?t"))])
    t = F.col("t")
    lexical = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    whole = lambda c, name: c.cast("bigint").alias(name)
    return rows.select(
        whole(T.str_after(F.col("o"), "urn:orders:"), "o"),
        whole(F.year(t), "y"),
        whole(F.month(t), "m"),
        whole(F.day(t), "d"),
        whole(F.hour(t), "h"),
        whole(F.minute(t), "mi"),
        whole(F.second(t), "s"),
        whole(F.date_diff(t.cast("date"), F.lit("1992-01-01").cast("date")), "age"),
        T.tz(lexical).alias("tz"),
        T.timezone_minutes(lexical).alias("offset_minutes"),
    )


@query("SELECT page_id AS p, md5(url) AS m, sha1(url) AS s1, sha256(url) AS s2 FROM pages")
def fn_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(business_graph(spark, sf), [_t("?p", "url", "?url")])
    d = lambda name: T.digest(F.col("url"), name)
    return rows.select(
        T.str_after(F.col("p"), "urn:pages:").cast("bigint").alias("p"),
        d("md5").alias("m"),
        d("sha1").alias("s1"),
        d("sha256").alias("s2"),
    )


@query("SELECT page_id AS p, url_encode(url) AS encoded FROM pages")
def fn_uri(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(business_graph(spark, sf), [_t("?p", "url", "?url")])
    return rows.select(
        T.str_after(F.col("p"), "urn:pages:").cast("bigint").alias("p"),
        T.encode_for_uri(F.col("url")).alias("encoded"),
    )


@query("""
SELECT p, kind, tag, dt, is_num, count(*) AS n FROM (
  SELECT 'urn:col:text' AS p, 'literal' AS kind, lang AS tag,
    'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS dt, false AS is_num FROM documents
  UNION ALL SELECT 'urn:col:n_chars', 'literal', '', 'http://www.w3.org/2001/XMLSchema#integer', true FROM documents
  UNION ALL SELECT 'urn:col:source', 'literal', '', 'http://www.w3.org/2001/XMLSchema#string', false FROM documents
  UNION ALL SELECT 'urn:col:lang', 'literal', '', 'http://www.w3.org/2001/XMLSchema#string', false FROM documents
  UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'iri', '', NULL, false FROM documents)
GROUP BY ALL
""")
def fn_terms(spark: SparkSession, sf: str) -> DataFrame:
    quads = business_graph(spark, sf).quads().where("g = 'urn:graph:documents'")
    kind = F.when(T.is_iri(F.col("o_kind")), "iri").when(T.is_literal(F.col("o_kind")), "literal")
    dt = F.when(T.is_literal(F.col("o_kind")), T.datatype(F.col("o_dt"), F.col("o_lang")))
    return quads.groupBy(
        "p",
        kind.alias("kind"),
        T.lang(F.col("o_lang")).alias("tag"),
        dt.alias("dt"),
        T.is_numeric(F.col("o_num")).alias("is_num"),
    ).agg(agg.count().alias("n"))


@query("""
SELECT 'urn:documents:' || doc_id AS d, lang AS tag FROM documents WHERE lang IN ('en', 'de')
""")
def fn_lang_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(business_graph(spark, sf), [_t("?d", "text", lang("?tag"))])
    return rows.where(T.lang_matches(F.col("tag"), "EN") | T.lang_matches(F.col("tag"), "de"))


@query("""
SELECT event_id AS e, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS as_integer,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 1000 AS DOUBLE) / 8 END AS as_double,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS as_boolean, event_type AS as_string,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 1000 AS DOUBLE) / 8 END AS as_float,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 1000 AS DOUBLE) / 8 END AS as_decimal,
  CASE WHEN event_id % 5 > 0 THEN 1577836800 + event_id % 5 END AS as_seconds
FROM events
""")
def fn_casts(spark: SparkSession, sf: str) -> DataFrame:
    """A cast that does not fit leaves the variable unbound."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    e, k, kind = F.col("event_id"), F.get_json_object("props", "$.k"), F.col("event_type")
    number = F.when(e % 2 == 0, ((e % 1000) / 8).cast("string")).otherwise(kind)
    truth = F.when(e % 3 == 0, "1").when(e % 3 == 1, "false").otherwise(kind)
    instant = F.when(e % 5 > 0, F.concat(F.lit("2020-01-01T00:00:0"), e % 5, F.lit("Z"))).otherwise(kind)
    return events.select(
        e.alias("e"),
        T.cast_term(k, "integer").cast("bigint").alias("as_integer"),
        T.cast_term(number, "double").alias("as_double"),
        T.cast_term(truth, "boolean").alias("as_boolean"),
        T.cast_term(kind, "string").alias("as_string"),
        T.cast_term(number, "float").cast("double").alias("as_float"),
        T.number(number)["approx"].alias("as_decimal"),
        F.unix_seconds(T.cast_term(instant, "dateTime")).alias("as_seconds"),
    )


@query("""
SELECT n_nationkey AS k, 'urn:n:' || n_nationkey AS iri, '_:' || n_name AS blank, true AS is_blank, n_name AS typed,
  'http://www.w3.org/2001/XMLSchema#token' AS typed_dt, 'en' AS tag, n_nationkey % 2 = 0 AS same, 45 AS uuid_length
FROM nation
""")
def fn_constructors(spark: SparkSession, sf: str) -> DataFrame:
    """Terms made in a query, and equality over all their parts."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    made = spark.read.parquet(f"{sf}/nation.parquet").select(
        k.alias("k"),
        T.make_iri(F.concat(F.lit("urn:n:"), k)).alias("i"),
        T.make_bnode(name).alias("b"),
        T.typed_literal(name, "http://www.w3.org/2001/XMLSchema#token").alias("t"),
        T.lang_literal(name, F.lit("EN")).alias("l"),
        T.lang_literal(name, F.when(k % 2 == 0, "en").otherwise("fr")).alias("o"),
        F.length(T.new_uuid()).alias("uuid_length"),
    )
    return made.select(
        F.col("k").cast("int").alias("k"),
        F.col("i.o").alias("iri"),
        F.col("b.o").alias("blank"),
        T.is_blank(F.col("b.o_kind")).alias("is_blank"),
        F.col("t.o").alias("typed"),
        F.col("t.o_dt").alias("typed_dt"),
        F.col("l.o_lang").alias("tag"),
        T.same_term("l", "o").alias("same"),
        "uuid_length",
    )


@query("""
SELECT p, count(*) AS n FROM (
  SELECT unnest(['urn:col:s_name', 'urn:col:s_nation', 'urn:col:s_acctbal', 'urn:rel:partOf',
    'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM supplier
  UNION ALL SELECT unnest(['urn:col:c_name', 'urn:col:c_nation', 'urn:col:c_acctbal', 'urn:col:c_mktsegment', 'urn:rel:partOf',
    'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) FROM customer) GROUP BY 1
""")
def quads_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Loading the same quads twice changes nothing."""
    quads = business_graph(spark, sf, even=True).quads().where(
        F.col("g").isin("urn:graph:supplier", "urn:graph:customer")
    )
    return dedup(quads.unionByName(quads)).groupBy("p").agg(agg.count().alias("n"))


def _documents_and_labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the quality of their label, unbound where there is none, and labels whose quality is
    unbound where the document is toxic."""
    g = business_graph(spark, sf)
    docs = bgp(g, [_t("?d", "source", "?source")])
    labels = bgp(g, [_t("?l", "about", "?d"), _t("?l", "quality", num("?q")), _t("?l", "toxic", num("?toxic"))])
    a = al.optional(docs, labels.select("d", "q"), None, [], [])
    return a, labels.select("d", F.when(F.col("toxic") == 0, F.col("q")).alias("q"), "toxic")


_DL = """
WITH a AS (SELECT d.doc_id AS d, d.source, CAST(l.quality AS DOUBLE) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
     b AS (SELECT doc_id AS d, CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END AS q, toxic FROM labels)
"""
_AGREE = "(a.q = b.q OR a.q IS NULL OR b.q IS NULL)"


@query(_DL + f"""
SELECT 'urn:documents:' || a.d AS d, coalesce(a.q, b.q) AS q, CAST(b.toxic AS DOUBLE) AS toxic
FROM a LEFT JOIN b ON a.d = b.d AND {_AGREE}
""")
def optional_unbound(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _documents_and_labels(spark, sf)
    return al.optional(a, b, None, ["q"], ["q"]).select("d", "q", "toxic")


@query(_DL + f"SELECT 'urn:documents:' || a.d AS d, a.q FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.d = b.d AND {_AGREE})")
def exists_unbound(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _documents_and_labels(spark, sf)
    return al.exists(a, b, None, ["q"], ["q"]).select("d", "q")


@query("""
SELECT 'urn:documents:' || d.doc_id AS d, CAST(l.quality AS DOUBLE) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NOT NULL AND l.quality <> 1
""")
def not_exists_unbound(spark: SparkSession, sf: str) -> DataFrame:
    """An unbound quality agrees with any, so only documents of another quality are left."""
    a, _ = _documents_and_labels(spark, sf)
    some = spark.createDataFrame([(1.0,)], "q double")
    return al.not_exists(a, some).select("d", "q")


@query("""
SELECT 'urn:documents:' || d.doc_id AS d, coalesce(CAST(l.quality AS DOUBLE), v.q) AS q, v.name
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
JOIN (VALUES (1.0::DOUBLE, 'good'), (0.0::DOUBLE, 'bad'), (NULL, 'any')) v(q, name) ON l.quality IS NULL OR v.q IS NULL OR l.quality = v.q
""")
def values_unbound(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = _documents_and_labels(spark, sf)
    return al.values(a, ["q", "name"], [(1.0, "good"), (0.0, "bad"), (None, "any")]).select("d", "q", "name")


@query("SELECT 'urn:region:' || r_regionkey AS r, v.x FROM region CROSS JOIN (VALUES ('a'), ('b')) v(x)")
def values_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    rows = bgp(business_graph(spark, sf), [_t("?r", "r_name", "?name")]).select("r")
    return al.values(rows, ["x"], [("a",), ("b",)])


@query("""
SELECT 'urn:documents:' || d.doc_id AS d, d.source, CAST(l.quality AS DOUBLE) AS quality FROM documents d JOIN labels l USING (doc_id)
""")
def star_any_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A subject with one part in one graph and another part in a second one."""
    none = F.lit(None)

    def quads(table: str, column: str) -> DataFrame:
        value = F.col(column).cast("string")
        return spark.read.parquet(f"{sf}/{table}.parquet").select(
            F.lit(f"urn:graph:{table}").alias("g"), F.concat(F.lit("urn:documents:"), "doc_id").alias("s"), F.lit(COL + column).alias("p"),
            value.alias("o"), F.lit("literal").alias("o_kind"), none.cast("string").alias("o_dt"), none.cast("string").alias("o_lang"),
            value.try_cast("double").alias("o_num"), none.cast("timestamp").alias("o_ts"),
        )

    g = QuadTable(quads("documents", "source").unionByName(quads("labels", "quality")), (COL + "source", COL + "quality"))
    return bgp(g, [_t("?d", "source", "?source"), _t("?d", "quality", num("?quality"))])


@query("""
SELECT 'urn:src:' || source AS source, coalesce(string_agg(x, ' ' ORDER BY x), '') AS labels FROM (
  SELECT d.source, CASE WHEN l.toxic = 1 THEN d.lang END AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1)
GROUP BY source
""")
def agg_group_concat_unbound(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of the toxic documents of each source, which may have none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("urn:src:"), "source").alias("source"), "lang")
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id", "toxic")
    rows = al.optional(docs, toxic, None, [], []).select("source", F.when(F.col("toxic") == 1, F.col("lang")).alias("x"))
    return agg.group_concat(rows, ["source"], "x", " ", name="labels")

"""Queries over device descriptions: intake, upgrade, flatten, triples, path search, listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import validate as V
from ..operators.algebra import describe
from ..operators.mutate import name_based_id
from ..operators.nodes import flatten, path_text
from ..operators.triples import assemble, ntriples, triplify
from ..session import scratch, spread
from ..sources import catalog as C
from ..sources import documents as intake
from ..sources.fleet import RUN, customer_documents
from ..sources.graphs import dedup, stored
from ..sources.listing import Listing
from ..sources.path_index import ANY, DEEP, ITEM, PathIndex, Test
from ..sources.sinks import binding, choose_format, write_results
from ..vocab import HCTL, JSONSCHEMA, RDF_TYPE, TD, WOTSEC
from .registry import query


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return customer_documents(spark, sf).withColumn("m", D.fields(F.try_parse_json("body")))


def _upgraded(spark: SparkSession, sf: str) -> DataFrame:
    """Stored form: upgraded and stamped, as column ``doc``."""
    stored = D.bind(D.upgrade(F.col("m")), lambda m: D.decorate(m, F.lit(RUN).cast("timestamp")))
    return _parsed(spark, sf).select("k", "id", F.to_variant_object(stored).alias("doc"))


def _quads(spark: SparkSession, sf: str) -> DataFrame:
    return triplify(_upgraded(spark, sf))


def _get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


# ---------------------------------------------------------------- intake and upgrade


@query("""
SELECT event_id AS seq,
  CASE event_id % 6 WHEN 0 THEN 'empty_body' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'not_an_object'
    WHEN 3 THEN 'id_not_allowed' ELSE 'id_missing' END AS code,
  CASE event_id % 6 WHEN 0 THEN 'The body is empty.' WHEN 1 THEN 'The body is not a JSON object.'
    WHEN 2 THEN 'The body is not a JSON object.' WHEN 3 THEN 'An anonymous document must not carry an id.'
    ELSE 'The document needs a textual @id or id.' END AS message
FROM events WHERE event_id % 6 <> 5
""")
def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests of which five in six are faulty, each in its own way."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = F.col("event_id") % 6
    props = F.col("props")
    body = (
        F.when(n == 0, "  ")
        .when(n == 1, F.concat(F.lit("["), props, F.lit("]")))
        .when(n == 2, F.concat(F.lit("{"), props))
        .when(n == 3, F.concat(F.lit('{"id":"urn:x:'), "event_id", F.lit('"}')))
        .when(n == 4, F.concat(F.lit('{"@id":'), "event_id", F.lit("}")))
        .otherwise(F.concat(F.lit('{"@id":"urn:x:'), "event_id", F.lit('","id":7}')))
    )
    ops = e.select(
        F.col("event_id").alias("seq"),
        F.when(n == 3, "CREATE").otherwise("PUT").alias("op"),
        F.lit(None).cast("string").alias("id"),
        body.alias("body"),
        "ts",
    )
    return intake.reject_rows(intake.intake(ops)).select("seq", "code", "message")


@query("""
SELECT c_custkey AS k, 'https://www.w3.org/2022/wot/td/v1.1' AS context,
  CASE WHEN c_custkey % 4 = 1 THEN 2 ELSE 1 END AS n FROM customer
""")
def normalise_context(spark: SparkSession, sf: str) -> DataFrame:
    context = _get(D.bind(F.col("m"), D.upgrade_context), "@context")
    listed = D.items(context)
    return _parsed(spark, sf).select(
        "k",
        F.coalesce(D.text_of(context), D.text_of(F.get(listed, F.lit(0)))).alias("context"),
        F.coalesce(F.size(listed), F.lit(1)).cast("bigint").alias("n"),
    )


@query("""
SELECT c_custkey AS k,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'missing_sc' ELSE 'basic_sc' END AS security,
  CASE WHEN c_custkey % 4 = 0 THEN 'basic_sc,nosec_sc' WHEN c_custkey % 6 = 5 THEN 'basic_sc,oauth_sc'
    ELSE 'basic_sc' END AS names,
  'basic' AS basic_scheme,
  CASE WHEN c_custkey % 4 = 0 THEN '{"scheme":"nosec"}' END AS nosec
FROM customer
""")
def normalise_security(spark: SparkSession, sf: str) -> DataFrame:
    m = D.bind(D.bind(F.col("m"), D.upgrade_security), D.upgrade_security_list)
    docs = _parsed(spark, sf).select("k", m.alias("m"))
    defs = D.fields(_get(F.col("m"), "securityDefinitions"))
    return docs.select(
        "k",
        F.array_join(F.transform(D.items(_get(F.col("m"), "security")), D.text_of), ",").alias(
            "security"
        ),
        F.array_join(F.array_sort(F.map_keys(defs)), ",").alias("names"),
        D.member(_get(defs, "basic_sc"), "scheme").alias("basic_scheme"),
        F.to_json(_get(defs, "nosec_sc")).alias("nosec"),
    )


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 50 <> 7 THEN c_name END AS title, '1.1' AS version,
  '{"created":"2024-01-01T00:00:00Z"}' AS registration, false AS prefixed FROM customer
""")
def normalise_title_version(spark: SparkSession, sf: str) -> DataFrame:
    docs = _parsed(spark, sf).select("k", D.upgrade(F.col("m")).alias("m"))
    m = F.col("m")
    return docs.select(
        "k",
        D.text_of(_get(m, "title")).alias("title"),
        D.text_of(_get(m, "@version")).alias("version"),
        F.to_json(_get(m, "registration")).alias("registration"),
        D.has(m, "td:title").alias("prefixed"),
    )


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN 'Device,Thing' ELSE 'Thing' END AS types,
  'http://example.com/graph/urn:customer:' || c_custkey AS graph_id,
  '2024-01-01T00:00:00Z' AS created, '2024-06-01T00:00:00.000000Z' AS modified FROM customer
""")
def decorate_types(spark: SparkSession, sf: str) -> DataFrame:
    docs = _upgraded(spark, sf).select("k", "id", D.fields(F.col("doc")).alias("m"))
    reg = _get(F.col("m"), "registration")
    return docs.select(
        "k",
        F.array_join(F.array_sort(D.types_of(F.col("m"))), ",").alias("types"),
        intake.graph_id(F.col("id")).alias("graph_id"),
        D.member(reg, "created").alias("created"),
        D.member(reg, "modified").alias("modified"),
    )


@query("""
SELECT event_id AS e, CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(event_id AS VARCHAR) END AS k,
  '"' || event_type || '"' AS src, '{"a":1}' AS extra FROM events
""")
def merge_patch_top(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's document under a patch that replaces whole members, NULL included."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    base = F.concat(
        F.lit('{"k":{"deep":1},"src":"'), "event_type", F.lit('","extra":{"b":2}}')
    )
    k = F.when(F.col("event_id") % 5 == 0, "null").otherwise(F.col("event_id").cast("string"))
    patch = F.concat(F.lit('{"k":'), k, F.lit(',"extra":{"a":1}}'))
    merged = D.overlay(D.fields(F.parse_json(base)), D.fields(F.parse_json(patch)))
    out = e.select(F.col("event_id").alias("e"), merged.alias("m"))
    return out.select("e", *[F.to_json(_get(F.col("m"), n)).alias(n) for n in ("k", "src", "extra")])


@query("""
SELECT event_id AS e, '{"l":[null,{"x":null}],"n":{"b":' || event_id || ',"e":{}}'
  || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"src":"' || event_type || '"' END || '}' AS body FROM events
""")
def remove_nulls(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(spark.read.parquet(f"{sf}/events.parquet"))
    src = F.when(F.col("event_id") % 3 == 0, "null").otherwise(
        F.concat(F.lit('"'), "event_type", F.lit('"'))
    )
    body = F.concat(
        F.lit('{"src":'), src, F.lit(',"n":{"a":null,"b":'), "event_id",
        F.lit(',"e":{"f":null}},"l":[null,{"x":null}]}'),
    )
    rows = e.select(F.col("event_id").alias("e"), body.alias("b"))
    return rows.select(
        "e", D.remove_nulls(F.parse_json("b"), D.nesting_depth(F.col("b"))).alias("body")
    )


@query("""
SELECT event_id AS id, unnest(['$', '$.k', '$.n', '$.n.v', '$.n.l', '$.n.l[0]', '$.n.l[1]']) AS path,
  unnest(['object', 'number', 'object', 'number', 'array', 'string', 'boolean']) AS kind,
  unnest([NULL, NULL, NULL, NULL, NULL, event_type, NULL]) AS v_str,
  unnest([NULL, CAST(json_extract(props, '$.k') AS DOUBLE), NULL, value, NULL, NULL, NULL]) AS v_num,
  unnest([NULL, NULL, NULL, NULL, NULL, NULL, event_id % 2 = 0]) AS v_bool
FROM events
""")
def flatten_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(spark.read.parquet(f"{sf}/events.parquet"))
    body = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"),
        F.lit(',"n":{"v":'), F.to_json(F.col("value").cast("variant")),
        F.lit(',"l":["'), "event_type", F.lit('",'),
        (F.col("event_id") % 2 == 0).cast("string"), F.lit("]}}"),
    )
    docs = e.select(F.col("event_id").alias("id"), F.parse_json(body).alias("doc"))
    nodes = flatten(docs)
    return nodes.select("id", path_text().alias("path"), "kind", "v_str", "v_num", "v_bool")


# ---------------------------------------------------------------- triples

_ROOT_SQL = f"""
  SELECT 'urn:customer:' || c_custkey AS s, '{TD}title' AS p, c_name AS o, 'literal' AS o_kind, 'en' AS o_lang
    FROM customer WHERE c_custkey % 50 <> 7
  UNION ALL SELECT 'urn:customer:' || c_custkey, '{TD}description', c_mktsegment || ' account', 'literal', 'en' FROM customer
  UNION ALL SELECT 'urn:customer:' || c_custkey, '{RDF_TYPE}', '{TD}Thing', 'iri', NULL FROM customer
  UNION ALL SELECT 'urn:customer:' || c_custkey, '{RDF_TYPE}', '{TD}Device', 'iri', NULL FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT 'urn:customer:' || c_custkey, '{TD}hasSecurityConfiguration',
    CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'missing_sc' ELSE 'basic_sc' END, 'literal', NULL FROM customer
  UNION ALL SELECT 'urn:customer:' || c_custkey, 'http://purl.org/dc/terms/created', 'yesterday', 'literal', NULL
    FROM customer WHERE c_custkey % 11 = 4
"""


@query(_ROOT_SQL)
def triplify_docs(spark: SparkSession, sf: str) -> DataFrame:
    quads = _quads(spark, sf)
    return quads.where(
        F.col("s").startswith("urn:customer:") & (F.col("o_kind") != "bnode")
    ).select("s", "p", "o", "o_kind", "o_lang")


@query(f"""
WITH c AS (SELECT c_custkey AS k,
  CASE WHEN c_custkey % 4 = 0 OR c_custkey % 6 = 5 THEN 2 ELSE 1 END AS defs FROM customer)
SELECT p, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT '{TD}hasPropertyAffordance' AS p, 2 AS n FROM c
  UNION ALL SELECT '{TD}name', 2 FROM c
  UNION ALL SELECT '{TD}hasForm', CASE WHEN k % 10 = 3 THEN 1 ELSE 2 END FROM c
  UNION ALL SELECT '{HCTL}hasTarget', CASE WHEN k % 10 = 3 THEN 1 ELSE 2 END FROM c
  UNION ALL SELECT '{HCTL}hasOperationType', 1 FROM c WHERE k % 10 <> 3
  UNION ALL SELECT '{JSONSCHEMA}const', 1 FROM c
  UNION ALL SELECT '{JSONSCHEMA}enum', 2 FROM c
  UNION ALL SELECT '{TD}definesSecurityScheme', defs FROM c
  UNION ALL SELECT '{TD}hasInstanceConfiguration', defs FROM c
  UNION ALL SELECT '{WOTSEC}in', 1 FROM c WHERE k % 4 <> 0 AND k % 6 <> 5
  UNION ALL SELECT '{WOTSEC}flow', 1 FROM c WHERE k % 4 <> 0 AND k % 6 = 5
  UNION ALL SELECT '{RDF_TYPE}', 3 + defs + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END FROM c
  UNION ALL SELECT '{TD}registration', 1 FROM c
  UNION ALL SELECT 'http://purl.org/dc/terms/created', 1 + CASE WHEN k % 11 = 4 THEN 1 ELSE 0 END FROM c)
GROUP BY 1
""")
def triplify_counts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [
        TD + "hasPropertyAffordance", TD + "name", TD + "hasForm", HCTL + "hasTarget",
        HCTL + "hasOperationType", JSONSCHEMA + "const", JSONSCHEMA + "enum",
        TD + "definesSecurityScheme", TD + "hasInstanceConfiguration", WOTSEC + "in",
        WOTSEC + "flow", RDF_TYPE, TD + "registration", "http://purl.org/dc/terms/created",
    ]
    counted = _quads(spark, sf).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("p").isin(wanted))


@query(f"SELECT p, count(*) AS n FROM ({_ROOT_SQL}) GROUP BY 1")
def triples_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The union of the triples of two loads of the same documents is the set of one load."""
    roots = triplify_docs(spark, sf).select(
        F.lit(None).cast("string").alias("g"), "s", "p", "o", "o_kind",
        F.lit(None).cast("string").alias("o_dt"), "o_lang",
    )
    return dedup(roots.unionByName(roots)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT '<urn:customer:' || c_custkey || '> <{TD}title> "' || c_name || '"@en .' AS value
FROM customer WHERE c_custkey % 50 <> 7
UNION ALL SELECT '<urn:customer:' || c_custkey || '> <{RDF_TYPE}> <{TD}Thing> .' FROM customer
""")
def ntriples_text(spark: SparkSession, sf: str) -> DataFrame:
    quads = _quads(spark, sf)
    titles = F.col("p") == TD + "title"
    things = (F.col("p") == RDF_TYPE) & (F.col("o") == TD + "Thing")
    return ntriples(quads.where(titles | things))


@query("""
SELECT 'urn:customer:' || c_custkey AS id, CASE WHEN c_custkey % 50 <> 7 THEN c_name END AS title,
  CASE WHEN c_custkey % 3 = 1 THEN 'Device,Thing' ELSE 'Thing' END AS types,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'missing_sc' ELSE 'basic_sc' END AS security,
  'basic' AS scheme, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance,
  'https://x.example/' || c_custkey || '/balance' AS href,
  CASE WHEN c_custkey % 10 = 3 THEN 0 ELSE 1 END AS segment_forms
FROM customer
""")
def assemble_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents put back together from their quads, read through paths."""
    docs, _ = assemble(stored(dedup(_quads(spark, sf))))
    m = docs.select("id", D.fields(F.parse_json("body")).alias("m"), F.parse_json("body").alias("doc"))
    doc = F.col("doc")
    first = lambda path: F.get(path.nodes(doc, F.lit(1)), F.lit(0))
    props = D.Path().child("properties")
    return m.select(
        "id",
        D.text_of(_get(F.col("m"), "title")).alias("title"),
        F.array_join(F.array_sort(D.types_of(F.col("m"))), ",").alias("types"),
        D.text_of(first(D.Path().child("security").index(0))).alias("security"),
        D.text_of(first(D.Path().child("securityDefinitions").child("basic_sc").child("scheme"))).alias(
            "scheme"
        ),
        first(props.child("balance").child("const")).cast("double").alias("balance"),
        D.text_of(first(props.child("balance").child("forms").index(0).child("href"))).alias("href"),
        F.size(props.child("segment").child("forms").any().nodes(doc, F.lit(1)))
        .cast("bigint")
        .alias("segment_forms"),
    )


@query(f"""
WITH d AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 50 <> 7)
SELECT 'urn:customer:' || k AS id,
  6 + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 4 THEN 1 ELSE 0 END AS own,
  CASE WHEN k % 10 = 3 THEN 1 ELSE 2 END AS forms
FROM d
""")
def describe_things(spark: SparkSession, sf: str) -> DataFrame:
    """Titled things of one segment with all their nested nodes."""
    quads = stored(dedup(_quads(spark, sf)))
    wanted = quads.where((F.col("p") == TD + "description") & (F.col("o") == "BUILDING account"))
    titled = quads.where(F.col("p") == TD + "title").select("s")
    about = describe(quads, wanted.join(titled, "s", "left_semi"))
    own = F.col("s").startswith("urn:") & ~F.col("p").isin(TD + "definesSecurityScheme", TD + "hasPropertyAffordance")
    counts = about.groupBy("g").agg(
        (F.count_if(own) + F.lit(1)).alias("own"), F.count_if(F.col("p") == HCTL + "hasTarget").alias("forms")
    )
    return counts.select(
        F.replace("g", F.lit("http://example.com/graph/"), F.lit("")).alias("id"), "own", "forms"
    )


@query("""
SELECT 'urn:customer:' || c_custkey AS id,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'missing_sc' ELSE 'basic_sc' END AS name,
  NOT (c_custkey % 2 = 0 AND c_custkey % 5 = 0) AS resolved FROM customer
""")
def security_resolve(spark: SparkSession, sf: str) -> DataFrame:
    found = V.resolve_security(_quads(spark, sf), TD)
    return found.select(F.col("s").alias("id"), "name", F.col("definition").isNotNull().alias("resolved"))


# ---------------------------------------------------------------- path search


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    return customer_documents(spark, sf)


@query("SELECT event_id AS e FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def path_child(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("e"), F.col("props").alias("body"))
    hit = D.Path().where(lambda v: F.try_variant_get(v, "$", "bigint") > 50)
    return C.search(e, hit).select("e")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 9 = 0")
def path_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    op = D.Path().child("properties").any().child("forms").any().child("op")
    return C.search(_bodies(spark, sf), op.where(lambda v: D.text_of(v) == "invokeAction")).select("k")


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 2 END AS n FROM customer
""")
def path_deep(spark: SparkSession, sf: str) -> DataFrame:
    docs = _bodies(spark, sf).withColumn("doc", F.parse_json("body"))
    found = D.Path().deep("href").nodes(F.col("doc"), D.nesting_depth(F.col("body")))
    return docs.select("k", F.size(found).cast("bigint").alias("n"))


@query("""
SELECT c_custkey AS k, c_mktsegment AS first, 'OTHER' AS last, c_mktsegment || ',OTHER' AS both,
  'OTHER' AS rest FROM customer
""")
def path_index_slice(spark: SparkSession, sf: str) -> DataFrame:
    docs = _bodies(spark, sf).withColumn("doc", F.parse_json("body"))
    enum = D.Path().child("properties").child("segment").child("enum")
    joined = lambda p: F.array_join(F.transform(p.nodes(F.col("doc"), F.lit(1)), D.text_of), ",")
    return docs.select(
        "k",
        joined(enum.index(0)).alias("first"),
        joined(enum.index(-1)).alias("last"),
        joined(enum.slice(0, 2)).alias("both"),
        joined(enum.slice(1)).alias("rest"),
    )


@query("""
SELECT c_custkey AS k, c_acctbal > 5000 AS more, c_acctbal <> 0 AS unlike,
  c_mktsegment LIKE 'B%' AS matches, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed,
  c_mktsegment NOT IN ('BUILDING', 'OTHER') AS all_listed, true AS has_unit, c_custkey % 10 = 3 AS empty,
  true AS size_two, c_acctbal > 5000 AND c_acctbal <= 8000 AS between
FROM customer
""")
def path_filter_ops(spark: SparkSession, sf: str) -> DataFrame:
    docs = _bodies(spark, sf).withColumn("doc", F.parse_json("body"))
    const = lambda v: D.member(v, "const", "double")
    parts = lambda v, name: D.items(F.try_element_at(D.fields(v), F.lit(name)))
    texts = lambda v: F.transform(parts(v, "enum"), D.text_of)
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    tests = {
        "more": lambda v: const(v) > 5000,
        "unlike": lambda v: const(v) != 0,
        "matches": lambda v: F.get(texts(v), F.lit(0)).rlike("^B"),
        "listed": lambda v: F.arrays_overlap(texts(v), words("BUILDING", "MACHINERY")),
        "all_listed": lambda v: F.size(F.array_except(texts(v), words("BUILDING", "OTHER"))) > 0,
        "has_unit": lambda v: D.member(v, "unit").isNotNull(),
        "empty": lambda v: F.size(parts(v, "forms")) == 0,
        "size_two": lambda v: F.size(parts(v, "enum")) == 2,
        "between": lambda v: (const(v) > 5000) & (const(v) <= 8000),
    }
    props = D.Path().child("properties")
    return docs.select(
        "k", *[props.where(t).found(F.col("doc"), F.lit(1)).alias(n) for n, t in tests.items()]
    )


@query("""
SELECT event_id AS e, least(a, b, c) AS least, greatest(a, b, c) AS most, a + b + c AS total, 3 AS n,
  'k,l' AS keys, round((a + b + c) / 3.0, 6) AS mean,
  round(sqrt(greatest((a*a + b*b + c*c) / 3.0 - ((a + b + c) / 3.0) * ((a + b + c) / 3.0), 0)), 6) AS spread
FROM (SELECT event_id, CAST(event_id % 7 AS DOUBLE) AS a, CAST(user_id % 11 AS DOUBLE) AS b,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS c FROM events)
""")
def path_fn(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"k":"x","l":['), F.col("event_id") % 7, F.lit(","), F.col("user_id") % 11,
        F.lit(","), k, F.lit("]}"),
    )
    docs = e.select(F.col("event_id").alias("e"), F.parse_json(body).alias("doc"))
    doc = F.col("doc")
    docs = docs.select(
        "e", D.Path().child("l").any().nodes(doc, F.lit(1)).alias("l"), F.array(doc).alias("root")
    )
    fn = lambda name: D.path_function(name, F.col("l"))
    return docs.select(
        "e",
        fn("min").alias("least"),
        fn("max").alias("most"),
        fn("sum").alias("total"),
        fn("length").cast("bigint").alias("n"),
        F.array_join(D.path_function("keys", F.col("root")), ",").alias("keys"),
        F.round(fn("avg"), 6).alias("mean"),
        F.round(fn("stddev"), 6).alias("spread"),
    )


@query("""
SELECT 'urn:customer:' || c_custkey AS id FROM customer
WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_custkey % 10 <> 3
""")
def xpath_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Axes and text tests inside the row: a child by its text, and a descendant by its own."""
    docs = _bodies(spark, sf)
    said = D.Path().child("description").having(lambda v: D.text_of(v).rlike("^(BUILDING|HOUSEHOLD) "))
    below = D.Path().child("properties").deep("href").having(lambda v: D.text_of(v).endswith("segment"))
    return C.search_all(docs, said, below).select("id")


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(
        F.concat(F.lit("urn:customer:"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("id"),
        F.col("c_name").alias("title"),
        F.col("c_acctbal").alias("balance"),
    )


@query("""
SELECT 'urn:customer:' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, c_name AS title FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
""")
def lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 400000")
    ids = o.select(F.concat(F.lit("urn:customer:"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("id"))
    return C.lookup(_listing(spark, sf), ids).select("id", "title")


@query("""
SELECT 'urn:customer:' || lpad(CAST(u.user_id AS VARCHAR), 12, '0') AS id, c.c_custkey IS NOT NULL AS found
FROM (SELECT DISTINCT user_id * 10 AS user_id FROM events) u LEFT JOIN customer c ON c.c_custkey = u.user_id
""")
def exists_flags(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") * 10).alias("u")).distinct()
    ids = e.select(F.concat(F.lit("urn:customer:"), F.lpad(F.col("u").cast("string"), 12, "0")).alias("id"))
    return C.exists_flags(ids, _listing(spark, sf))


@query("""
SELECT 'urn:customer:' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, c_name AS title FROM customer
ORDER BY 1 LIMIT 20 OFFSET 40
""")
def list_page(spark: SparkSession, sf: str) -> DataFrame:
    return C.list_things(_listing(spark, sf), 20, 40).select("id", "title")


@query("""
SELECT count(*) AS total, 40 AS "offset", 20 AS "limit", CASE WHEN count(*) > 60 THEN 60 END AS next_offset
FROM customer
""")
def page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return C.page_meta(_listing(spark, sf), 20, 40)


@query("""
WITH t AS (
  SELECT 'urn:customer:' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS member, c_name AS title, count(*) OVER () AS total,
    row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS n FROM customer)
SELECT '/things?offset=100&limit=25&format=collection' AS page, total,
  CASE WHEN total > 125 THEN '/things?offset=125&limit=25&format=collection' END AS next,
  n - 100 AS place, member, title FROM t WHERE n BETWEEN 100 AND 124
""")
def list_collection(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a listing sorted beforehand, with its address, its successor's and its members."""
    page = Listing.build(_listing(spark, sf), "balance", "desc").collection(25, 100)
    members = page.select(F.col("id").alias("page"), "total", "next", F.posexplode("members").alias("place", "thing"))
    return members.select("page", "total", "next", F.col("place").cast("bigint").alias("place"), F.col("thing.id").alias("member"), "thing.title")


@query("""
SELECT 'urn:customer:' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, c_acctbal AS balance FROM customer
ORDER BY c_acctbal DESC, 1 LIMIT 50
""")
def list_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return C.list_things(_listing(spark, sf), 50, 0, "balance", "desc").select("id", "balance")


@query("""
SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer
""")
def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and as tab-separated text, read back, joined."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    rows = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), segment.alias("segment"))
    as_json, as_tsv = scratch(spark, "json"), scratch(spark, "tsv")
    write_results(rows.select("k", "segment"), as_json, "json")
    write_results(rows.select("k", "name"), as_tsv, "tsv")
    left = spark.read.schema("k bigint, segment string").json(as_json)
    right = spark.read.schema("k bigint, name string").csv(as_tsv, sep="\t", header=True)
    return left.join(right, "k").select("k", "name", "segment")


@query("""
SELECT '{"s":{"type":"uri","value":"urn:customer:' || c_custkey || '"}'
  || CASE WHEN c_custkey % 3 <> 0 THEN ',"x":{"type":"literal","value":"' || c_mktsegment || '"}' ELSE '' END || '}' AS binding
FROM customer
""")
def sink_bindings(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    rows = c.select(
        F.concat(F.lit("urn:customer:"), "c_custkey").alias("s"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("x"),
    )
    return rows.select(binding({"s": "uri", "x": "literal"}).alias("binding"))


@query("""
SELECT k, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-'
  || '89ab'[(position(h[17:17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS id
FROM (SELECT c_custkey AS k, sha1(c_custkey || '|' || c_name) AS h FROM customer)
""")
def mint_names(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(k.alias("k"), name_based_id(k.cast("string"), F.col("c_name")).alias("id"))


@query("""
SELECT 'urn:customer:' || c_custkey AS id, CASE WHEN c_custkey % 50 <> 7 THEN c_name END AS title, '1.1' AS version
FROM customer WHERE c_custkey % 7 <> 3
""")
def rebuild_docs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents anew from their quads; graphs without a root give none."""
    root = F.col("s").startswith("urn:customer:") & (F.regexp_extract("s", r"(\d+)$", 1).cast("long") % 7 == 3)
    docs, _ = C.rebuild_things(stored(dedup(_quads(spark, sf)).where(~root)))
    return docs.select("id", *_titles())


def _titles() -> list[Column]:
    doc = F.parse_json("body")
    return [F.try_variant_get(doc, "$.title", "string").alias("title"), F.try_variant_get(doc, "$['@version']", "string").alias("version")]


@query("""
SELECT 'urn:customer:' || c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'changed' WHEN c_custkey % 5 = 3 THEN 'kept'
  ELSE 'kept' END AS title FROM customer WHERE c_custkey % 5 <> 2
""")
def refresh_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Of the stored documents a fifth has a new title, a fifth an emptied graph, a fifth a graph without a root."""
    quads = dedup(_quads(spark, sf)).withColumn("k", F.regexp_extract("g", r"(\d+)$", 1).cast("long"))
    title = (F.col("p") == TD + "title") & (F.col("k") % 5 == 1)
    quads = quads.where("k % 5 <> 2").where(~((F.col("k") % 5 == 3) & F.col("s").startswith("urn:customer:")))
    # untitled ones get a title as well
    fresh = quads.where((F.col("k") % 5 == 1) & (F.col("p") == TD + "description")).withColumn("p", F.lit(TD + "title")).withColumn("o", F.lit("changed"))
    now = stored(quads.where(~title).unionByName(fresh).drop("k"))
    docs = customer_documents(spark, sf)
    old = docs.select("id", F.concat(F.lit('{"id":"'), "id", F.lit('","title":"kept"}')).alias("body"))
    changed = docs.where("k % 5 in (1, 2, 3)").select(F.concat(F.lit("http://example.com/graph/"), "id").alias("g"), "id")
    things, _ = C.refresh_things(old, now, changed)
    return things.select("id", _titles()[0])


@query("""
SELECT event_id AS e, (event_id % 7) || 'x' || (user_id % 11) AS joined, 3 AS n, CAST(event_id % 7 AS VARCHAR) AS first,
  CAST(user_id % 11 AS VARCHAR) AS last, 'x' AS second, CAST(user_id % 11 AS VARCHAR) AS before_end, 'end' AS appended
FROM events
""")
def path_fn_items(spark: SparkSession, sf: str) -> DataFrame:
    """Functions over the items of a list: joined, counted, picked from either end, with one more."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    body = F.concat(F.lit('{"l":["'), F.col("event_id") % 7, F.lit('","x","'), F.col("user_id") % 11, F.lit('"]}'))
    docs = e.select(F.col("event_id").alias("e"), D.Path().child("l").any().nodes(F.parse_json(body), F.lit(1)).alias("l"))
    fn = lambda name, *a: D.path_function(name, F.col("l"), *a)
    more = fn("append", F.parse_json(F.lit('"end"')))
    return docs.select(
        "e",
        fn("concat").alias("joined"),
        fn("length").cast("bigint").alias("n"),
        D.text_of(fn("first")).alias("first"),
        D.text_of(fn("last")).alias("last"),
        D.text_of(fn("index", F.lit(1))).alias("second"),
        D.text_of(fn("index", F.lit(-1))).alias("before_end"),
        D.text_of(F.get(more, F.lit(3))).alias("appended"),
    )


@query("""
SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer
""")
def sink_csv_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Written as comma-separated text and as XML, read back, joined."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    rows = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), segment.alias("segment"))
    as_csv, as_xml = scratch(spark, "csv"), scratch(spark, "xml")
    write_results(rows.select("k", "name"), as_csv, choose_format("select", "csv"))
    write_results(rows.select("k", "segment"), as_xml, choose_format("select", "xml"))
    left = spark.read.schema("k bigint, name string").csv(as_csv, header=True)
    right = spark.read.format("xml").option("rowTag", "result").schema("k bigint, segment string").load(as_xml)
    return left.join(right, "k").select("k", "name", "segment")


@query("""
SELECT '<urn:customer:' || c_custkey || '> <urn:p:balance> "' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)
  || '"^^<http://www.w3.org/2001/XMLSchema#double> .' AS value FROM customer
UNION ALL SELECT '_:b' || c_custkey || ' <urn:p:said> "a \\"' || c_mktsegment || '\\"\\n"@en .' FROM customer
UNION ALL SELECT '<urn:customer:' || c_custkey || '> <urn:p:at> <urn:a\\u0020b:' || c_custkey || '> .' FROM customer
""")
def sink_ntriples(spark: SparkSession, sf: str) -> DataFrame:
    """A graph result as text: typed and tagged literals with escapes, a blank node, an address to escape."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    own = F.concat(F.lit("urn:customer:"), k)
    lines = (
        (own, "urn:p:balance", F.col("c_acctbal").cast("decimal(18,2)").cast("string"), "literal", "http://www.w3.org/2001/XMLSchema#double", None),
        (F.concat(F.lit("_:b"), k), "urn:p:said", F.concat(F.lit('a "'), "c_mktsegment", F.lit('"\n')), "literal", None, "en"),
        (own, "urn:p:at", F.concat(F.lit("urn:a b:"), k), "iri", None, None),
    )
    quad = lambda s, p, o, kind, dt, tag: F.struct(
        s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
        (none if dt is None else F.lit(dt)).alias("o_dt"), (none if tag is None else F.lit(tag)).alias("o_lang"),
    )
    quads = spark.read.parquet(f"{sf}/customer.parquet").select(F.explode(F.array(*[quad(*x) for x in lines])).alias("q")).select("q.*")
    home = scratch(spark, "nt")
    write_results(quads, home, choose_format("construct", None))
    return spark.read.text(home)


@query("""
SELECT 'urn:customer:' || c_custkey AS id, 'variableRepeated' AS "constraint", 'lang' AS key FROM customer WHERE c_custkey % 4 = 1
""")
def validate_uri_variables(spark: SparkSession, sf: str) -> DataFrame:
    """A template variable named both by the document and by one of its parts."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    part = F.when(k % 2 == 1, '{"lang":{"type":"string"}}').otherwise('{"unit":{"type":"string"}}')
    own = F.when(k % 4 == 1, '{"lang":{"type":"string"}}').otherwise('{"size":{"type":"integer"}}')
    body = F.concat(F.lit('{"uriVariables":'), own, F.lit(',"properties":{"p":{"uriVariables":'), part, F.lit("}}}"))
    docs = c.select(F.concat(F.lit("urn:customer:"), k).alias("id"), F.parse_json(body).alias("doc"))
    return V.check_uri_variables(flatten(docs)).select("id", "constraint", "key")


@query("""
SELECT 'urn:customer:' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/cbor'
  ELSE 'application/json' END AS response_type FROM customer
""")
def response_types(spark: SparkSession, sf: str) -> DataFrame:
    """The content type of a response: its own, else the form's, else the default."""
    k = F.col("c_custkey")
    forms = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("urn:customer:"), k).alias("id"),
        F.when(k % 3 == 1, "application/cbor").when(k % 3 == 0, "x/y").alias("form_type"),
        F.when(k % 3 == 0, "text/plain").alias("response_type"),
    )
    return V.response_content_type(forms).select("id", "response_type")


@query(f"""
SELECT 'urn:supplier:' || s_suppkey AS id, 'nameForbidden' AS "constraint" FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0
""")
def validate_auto_name(spark: SparkSession, sf: str) -> DataFrame:
    """The automatic scheme with a name; other schemes may have one."""
    k = F.col("s_suppkey")
    kind = F.when(k % 2 == 0, WOTSEC + "AutoSecurityScheme").otherwise(WOTSEC + "BasicSecurityScheme")
    row = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    parts = F.array(row(RDF_TYPE, kind), row(WOTSEC + "name", F.when(k % 3 == 0, F.lit("x"))))
    quads = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(F.lit("urn:g:"), k).alias("g"), F.concat(F.lit("urn:supplier:"), k).alias("s"), F.explode(parts).alias("q")
    )
    found = V.check_auto_name(quads.select("g", "s", "q.p", "q.o").where("o is not null"), WOTSEC)
    return found.select(F.col("focus_node").alias("id"), "constraint")


@query("SELECT c_custkey AS k, c_name AS title FROM customer WHERE c_custkey % 2 = 0")
def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of the directory; the first stays readable, the second is the current one."""
    store = C.Store(spark, scratch(spark, "store"))
    docs = customer_documents(spark, sf).select("k", "id", "body")
    quads = docs.select(
        F.lit("urn:g").alias("g"), F.col("id").alias("s"), F.lit("urn:p:k").alias("p"), F.col("k").cast("string").alias("o"),
        F.lit("literal").alias("o_kind"), *(F.lit(None).cast(t).alias(n) for n, t in (("o_dt", "string"), ("o_lang", "string"), ("o_num", "double"), ("o_ts", "timestamp"))),
    )
    first = store.commit(docs, quads)
    store.commit(docs.where("k % 2 = 0"), quads.where("cast(o as bigint) % 2 = 0"))
    names = store.things(first).select("id", F.coalesce(*(F.get_json_object("body", f"$['{n}']") for n in ("title", "td:title"))).alias("t"))
    now = store.quads().select(F.col("s").alias("id"), F.col("o").cast("bigint").alias("k"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"))
    return now.join(names, "id").join(store.things().select("id"), "id").join(c, "k").where("t is null or t = title").select("k", "title")


@query("""
WITH now AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'first' WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN 'second'
    ELSE c_name END AS title FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 7 <> 0 OR c_custkey % 5 = 0
)
SELECT 3 AS version, k, title, CAST(2 AS BIGINT) AS quads FROM now
UNION ALL
SELECT 2, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_name END, CAST(2 AS BIGINT) FROM customer
""")
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two writers change different documents of one version: each writes its own, the later one follows the other."""
    store = C.Store(spark, scratch(spark, "store"))
    third = F.col("k") % 3
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"))

    def state(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = df.withColumn("id", F.concat(F.lit("urn:customer:"), "k"))
        parts = F.array(*(F.struct(F.lit(f"urn:p:{c}").alias("p"), F.col(c).cast("string").alias("o")) for c in ("k", "title")))
        quads = named.select(F.concat(F.lit("urn:g:"), "k").alias("g"), F.col("id").alias("s"), F.explode(parts).alias("q")).select(
            "g", "s", "q.p", "q.o", F.lit("literal").alias("o_kind"),
            *(F.lit(None).cast(t).alias(n) for n, t in (("o_dt", "string"), ("o_lang", "string"), ("o_num", "double"), ("o_ts", "timestamp"))),
        )
        return named.select("id", F.to_json(F.struct("id", "k", "title")).alias("body")), quads

    first = store.commit(*state(rows))
    store.commit_changes(*state(rows.where(third == 0).withColumn("title", F.lit("first"))), read=first)
    other = rows.where(third == 1)
    gone = other.where("k % 7 = 0 and k % 5 <> 0")
    store.commit_changes(
        *state(other.where("k % 5 = 0").withColumn("title", F.lit("second"))),
        gone.select(F.concat(F.lit("urn:customer:"), "k").alias("id")),
        gone.select(F.concat(F.lit("urn:g:"), "k").alias("g")),
        first,
    )
    out = []
    for version in (2, 3):
        counted = store.quads(version).groupBy(F.col("s").alias("id")).agg(
            F.count(F.lit(1)).alias("quads"), F.max(F.when(F.col("p") == "urn:p:title", F.col("o"))).alias("told")
        )
        docs = store.things(version).select(
            "id", F.get_json_object("body", "$.k").cast("bigint").alias("k"), F.get_json_object("body", "$.title").alias("title")
        )
        both = docs.join(counted, "id", "full").where("told is null or told <=> title")
        out.append(both.select(F.lit(version).alias("version"), "k", "title", "quads"))
    return out[0].unionByName(out[1])


@query("""
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS said, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer)
SELECT 'urn:customer:' || k AS id, 'debtors' AS search FROM c WHERE said = 'BUILDING' AND balance < 0
UNION ALL SELECT 'urn:customer:' || k, 'guarded' FROM c WHERE k % 6 = 5 AND k % 4 <> 0 AND balance >= 1000
UNION ALL SELECT 'urn:customer:' || k, 'readable' FROM c WHERE k % 10 <> 3 AND k % 9 <> 0 AND k % 3 = 1
""")
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Searches with several filters, answered from the postings of paths and values."""
    index = PathIndex.build(customer_documents(spark, sf))
    balance = ("properties", "balance", "const")
    searches = {
        "debtors": (Test(("properties", "segment", "enum", ITEM), "=", "BUILDING"), Test(balance, "<", 0)),
        "guarded": (Test(("securityDefinitions", ANY, "scheme"), "=", "oauth2"), Test(balance, ">=", 1000)),
        "readable": (Test((DEEP, "op", ITEM), "=", "readProperty"), Test(("@type", ITEM), "=", "Device")),
    }
    found = [index.search(*tests).withColumn("search", F.lit(name)) for name, tests in searches.items()]
    return reduce(DataFrame.unionByName, found)

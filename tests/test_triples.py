import json

import pytest
from conftest import docs_df, lamp
from pyspark.sql import functions as F

from thingfleet.functions import documents as D
from thingfleet.operators import validate as V
from thingfleet.operators.triples import assemble, ntriples, triplify
from thingfleet.sources import rules as R
from thingfleet.sources.catalog import Store, rebuild_things, refresh_things
from thingfleet.sources.graphs import dedup
from thingfleet.vocab import CONTEXT_V11, HCTL, JSONSCHEMA, LANG_STRING, RDF_TYPE, TD, WOTSEC, XSD

FULL = lamp(
    id="urn:dev:1",
    titles={"de": "Lampe", "en": "lamp"},
    description="a lamp",
    version={"instance": "1.2"},
    support="mailto:a@b.c",
    links=[{"href": "https://x/1", "rel": "item"}, {"href": "https://x/2"}],
    actions={"toggle": {"safe": True, "forms": [{"href": "https://x/t", "op": "invokeAction"}],
                        "input": {"type": "object", "properties": {"to": {"type": "number", "minimum": 1, "maximum": 2.5}}}}},
    securityDefinitions={"nosec_sc": {"scheme": "nosec"}, "o": {"scheme": "oauth2", "flow": "code", "token": "https://t/"}},
    registration={"created": "2024-01-01T00:00:00Z", "modified": "2024-01-02T00:00:00Z"},
)


@pytest.fixture(scope="module")
def quads(spark):
    return dedup(triplify(docs_df(spark, FULL))).cache()


def test_terms_become_triples(quads):
    root = quads.where("s = 'urn:dev:1'")
    got = {(r.p, r.o, r.o_kind, r.o_dt, r.o_lang) for r in root.where("o_kind <> 'bnode'").collect()}
    assert (TD + "title", "lamp", "literal", LANG_STRING, "en") in got
    assert (TD + "titleInLanguage", "Lampe", "literal", LANG_STRING, "de") in got
    assert (RDF_TYPE, TD + "Thing", "iri", None, None) in got
    assert (TD + "supportContact", "mailto:a@b.c", "literal", XSD + "anyURI", None) in got
    assert (TD + "hasSecurityConfiguration", "nosec_sc", "literal", XSD + "string", None) in got
    assert all(r.g == "http://example.com/graph/urn:dev:1" for r in root.collect())
    links = {r.p: r.n for r in root.where("o_kind = 'bnode'").groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert links == {
        TD + "hasPropertyAffordance": 1, TD + "hasActionAffordance": 1, TD + "hasLink": 2,
        TD + "definesSecurityScheme": 2, TD + "versionInfo": 1, TD + "registration": 1,
    }


def test_nested_nodes_hang_together(quads):
    rows = quads.collect()
    by_s = {}
    for r in rows:
        by_s.setdefault(r.s, []).append(r)
    go = lambda s, p: [r.o for r in by_s.get(s, []) if r.p == p]
    (action,) = go("urn:dev:1", TD + "hasActionAffordance")
    assert go(action, TD + "name") == ["toggle"] and go(action, TD + "isSafe") == ["true"]
    (form,) = go(action, TD + "hasForm")
    assert go(form, HCTL + "hasOperationType") == [TD + "invokeAction"]
    (inp,) = go(action, TD + "hasInputSchema")
    assert go(inp, RDF_TYPE) == [JSONSCHEMA + "ObjectSchema"]
    (to,) = go(inp, JSONSCHEMA + "properties")
    assert go(to, JSONSCHEMA + "propertyName") == ["to"]
    bounds = {r.p: (r.o, r.o_dt, r.o_num) for r in by_s[to] if "imum" in r.p}
    assert bounds == {
        JSONSCHEMA + "minimum": ("1", XSD + "integer", 1.0), JSONSCHEMA + "maximum": ("2.5", XSD + "double", 2.5),
    }
    schemes = {go(s, TD + "hasInstanceConfiguration")[0]: go(s, RDF_TYPE)[0] for s in go("urn:dev:1", TD + "definesSecurityScheme")}
    assert schemes == {"nosec_sc": WOTSEC + "NoSecurityScheme", "o": WOTSEC + "OAuth2SecurityScheme"}


def test_round_trip(spark, quads):
    docs, refused = assemble(quads)
    (row,) = docs.collect()
    wanted = {k: v for k, v in FULL.items() if k != "@context"}
    wanted["@type"] = ["Thing"]
    got = json.loads(row.body)
    key = lambda v: json.dumps(v, sort_keys=True)
    wanted["properties"]["status"]["forms"][0]["op"] = "readProperty"
    assert sorted(got.pop("links"), key=key) == sorted(wanted.pop("links"), key=key)
    assert got == wanted
    assert refused.count() == 0


def test_graphs_that_give_no_document(spark, quads):
    other = quads.where("s = 'urn:dev:1'").withColumn("g", F.lit("bad")).withColumn("s", F.lit("http://x"))
    docs, refused = assemble(quads.unionByName(other))
    assert docs.count() == 1 and [tuple(r) for r in refused.collect()] == [("bad", "no_root")]


def test_ntriples_addresses(spark):
    row = ("g", "urn:a b", "urn:p", "urn:<x>", "iri", None, None)
    df = spark.createDataFrame([row], "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
    assert ntriples(df).first().value == "<urn:a\\u0020b> <urn:p> <urn:\\u003Cx\\u003E> ."


def test_ntriples(spark):
    df = docs_df(spark, {"id": "urn:a", "title": 'q"\\\n', "base": "http://b/"})
    assert {r.value for r in ntriples(triplify(df)).collect()} == {
        f'<urn:a> <{TD}title> "q\\"\\\\\\n"@en .',
        f'<urn:a> <{TD}baseURI> "http://b/"^^<{XSD}anyURI> .',
    }


def check(spark, *docs, profile="corrected", nested=False):
    q = dedup(triplify(docs_df(spark, *docs)))
    found = V.validate(q, R.catalogue(), profile, nested)
    return sorted((r.focus_node, r.shape, r.path.rsplit("#")[-1].rsplit("/")[-1], r.constraint) for r in found.collect())


def test_valid_documents_conform(spark):
    assert check(spark, FULL) == []


def test_violations(spark):
    docs = [
        lamp(id="urn:no-title", title=...),
        lamp(id="urn:two", security=..., securityDefinitions=...),
        lamp(id="urn:form", properties={"p": {"forms": []}}),
        lamp(id="urn:deep", actions={"a": {"forms": [{"href": "h h"}]}}),
        lamp(id="urn:date", created="yesterday"),
        lamp(id="urn:lang", titles={"en": "a", "EN": "b"}),
        lamp(id="urn:op", forms=[{"href": "http://x", "op": "eat"}]),
    ]
    assert check(spark, *docs) == [
        ("urn:date", "Thing", "created", "datatype"),
        ("urn:deep", "Thing", "hasActionAffordance|https://www.w3.org/2019/wot/td#hasEventAffordance".rsplit("#")[-1], "node"),
        ("urn:form", "Thing", "hasEventAffordance", "node"),
        ("urn:lang", "Thing", "titleInLanguage", "uniqueLang"),
        ("urn:no-title", "Thing", "title", "minCount"),
        ("urn:op", "Thing", "hasForm", "node"),
        ("urn:two", "Thing", "definesSecurityScheme", "minCount"),
        ("urn:two", "Thing", "hasSecurityConfiguration", "minCount"),
    ]


def test_nested_failures_are_listed_on_request(spark):
    got = check(spark, lamp(id="urn:op", forms=[{"href": "http://x", "op": "eat"}]), nested=True)
    assert [x[1:] for x in got if x[1] == "Form"] == [("Form", "hasOperationType", "in")]


def test_recursive_schema_failure_reaches_the_thing(spark):
    deep = {"type": "object"}
    for _ in range(4):
        deep = {"type": "object", "oneOf": [deep]}
    leaf = deep
    while "oneOf" in leaf:
        leaf = leaf["oneOf"][0]
    leaf["readOnly"] = "maybe"
    got = check(spark, lamp(id="urn:r", schemaDefinitions={"d": deep}))
    assert got == [("urn:r", "Thing", "schemaDefinitions", "node")]


def typed(spark, cls, **members):
    rows = [("g", "n", RDF_TYPE, WOTSEC + cls, "iri", None, None)]
    rows += [("g", "n", WOTSEC + k, v, "literal", XSD + "string", None) for k, vs in members.items() for v in vs]
    return spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")


@pytest.mark.parametrize(
    "members, corrected, strict",
    [
        ({"oneOf": ["a", "b"]}, 0, 1),
        ({"oneOf": ["a"]}, 1, 2),
        ({"oneOf": ["a", "b"], "allOf": ["a", "b"]}, 1, 0),
        ({}, 1, 2),
    ],
)
def test_combination_schemes(spark, members, corrected, strict):
    q = typed(spark, "ComboSecurityScheme", **members)
    assert V.validate(q, R.catalogue(), "corrected").count() == corrected
    assert V.validate(q, R.catalogue(), "strict").count() == strict


def test_lists_and_flow(spark):
    bad = typed(spark, "DigestSecurityScheme", qop=["other"], name=["a", "b"])
    got = {(r.constraint, r.value) for r in V.validate(bad, R.catalogue()).collect()}
    assert got == {("in", "other"), ("maxCount", None)}
    flow = typed(spark, "OAuth2SecurityScheme", flow=["code"])
    assert {r.constraint for r in V.check_oauth(flow, WOTSEC).collect()} == {"authorizationRequired"}
    auto = typed(spark, "AutoSecurityScheme", name=["x"])
    assert V.check_auto_name(auto, WOTSEC).count() == 1


def test_catalogue_covers_every_shape():
    rules = R.catalogue()
    assert len({r.shape for r in rules}) == 29
    kinds = {r.kind for r in rules}
    assert {"minCount", "maxCount", "datatype", "nodeKind", "in", "node", "uniqueLang", "exactlyOneOf"} <= kinds
    assert R.defaults()[("Form", HCTL + "forContentType")] == "application/json"


def test_further_rules(spark, quads):
    bad = lamp(id="urn:k", properties={"p": {"forms": [{"href": "http://h", "op": "invokeAction"}]}})
    q = dedup(triplify(docs_df(spark, bad)))
    assert [r.value for r in V.check_operations(q, TD).collect()] == [TD + "invokeAction"]
    assert V.check_operations(quads, TD).count() == 0
    names = {(r.name, r.definition is not None) for r in V.resolve_security(quads, TD).collect()}
    assert names == {("nosec_sc", True)}
    docs = docs_df(spark, lamp(id="a"), lamp(id="b", **{"@context": "x"}), lamp(id="c", **{"@context": [CONTEXT_V11]}))
    docs = docs.withColumn("m", D.fields(F.col("doc")))
    assert [r.id for r in V.check_context(docs, CONTEXT_V11).collect()] == ["b"]
    assert V.check_language_tags(q).count() == 0


def test_verdict(spark):
    docs = [lamp(id="urn:ok"), lamp(id="urn:bad", title=...)]
    q = dedup(triplify(docs_df(spark, *docs)))
    got = {r.g.rsplit("/")[-1]: (r.conforms, r.n) for r in V.verdict(q, V.validate(q, R.catalogue())).collect()}
    assert got == {"urn:ok": (True, 0), "urn:bad": (False, 1)}


def test_store_keeps_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current() is None
    docs = docs_df(spark, FULL)
    store.commit(docs, dedup(triplify(docs)))
    store.commit(docs.where("false"), dedup(triplify(docs)).where("false"))
    assert store.current() == 2
    assert store.things().count() == 0 and store.things(1).count() == 1
    assert store.quads(1).where("p = '%stitle'" % TD).first().o == "lamp"
    built, refused = rebuild_things(store.quads(1))
    assert json.loads(built.first().body)["@version"] == "1.1" and refused.count() == 0
    changed = spark.createDataFrame([("http://example.com/graph/urn:dev:1", "urn:dev:1")], "g string, id string")
    assert refresh_things(built, store.quads(1), changed)[0].count() == 1
    assert refresh_things(built, store.quads(1).where("false"), changed)[0].count() == 0
    rootless = store.quads(1).where("s <> 'urn:dev:1'")
    kept, refused = refresh_things(built, rootless, changed)
    assert kept.count() == 1 and refused.first().code == "no_root"


def test_documents_are_worked_out_once(spark):
    # a filter on the documents would repeat the work that makes them, and children would carry copies of their parents
    raw = spark.range(3).selectExpr("concat('urn:', id) AS id", "if(id = 1, NULL, concat('{\"title\":\"t\",\"forms\":[{\"href\":\"h', id, '\"}]}')) AS body")
    docs = raw.select("id", F.try_parse_json("body").alias("doc"))
    quads = triplify(docs)
    plan = quads._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if " Filter " in line]
    assert filters and not any("parse_json" in line or "tryparse" in line.lower().replace("_", "") for line in filters)
    assert {r.g.split("/")[-1] for r in quads.collect()} == {"urn:0", "urn:2"}


def test_levels_are_one_compiled_loop_without_the_table_in_its_rows(spark):
    """No generator over variants between the levels, which copies every row, and no constant map in rows that need none."""
    plan = triplify(docs_df(spark, lamp()))._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_explode" not in plan
    assert "map(keys:" not in plan or "if (isnull(node" in plan


def test_empty_and_scalar_members_keep_their_place(spark):
    doc = {"id": "urn:a", "title": "t", "properties": {"p": {"forms": [], "enum": [], "const": {"a": [1, None]}}, "q": {}}}
    rows = triplify(docs_df(spark, doc)).collect()
    said = sorted((r.p.rsplit("#", 1)[-1], r.o_kind, r.o if r.o_kind == "literal" else "") for r in rows)
    assert said == [
        ("const", "literal", '{"a":[1,null]}'), ("hasPropertyAffordance", "bnode", ""), ("hasPropertyAffordance", "bnode", ""),
        ("name", "literal", "p"), ("name", "literal", "q"), ("title", "literal", "t"),
    ]

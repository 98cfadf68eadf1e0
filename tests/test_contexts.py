"""Terms that a document's own context defines."""

import json

import pytest
from conftest import V11, docs_df, lamp
from pyspark.sql import functions as F

from thingfleet.functions import contexts as C
from thingfleet.operators.triples import assemble, own_contexts, triplify
from thingfleet.sources.graphs import dedup
from thingfleet.vocab import LANG_STRING, RDF_TYPE, TD, XSD

EX, EX2 = "http://ex/", "http://ex2/"


def terms_of(spark, context):
    row = docs_df(spark, {"@context": context}).select(C.own_terms(F.col("doc")).alias("t")).first()
    return row.t and {k: (v.iri, v.type) for k, v in row.t.items()}


def test_definitions(spark):
    assert terms_of(spark, V11) is None and terms_of(spark, None) is None and terms_of(spark, [V11, 3]) is None
    assert terms_of(spark, {"ex": EX}) == {"ex": (EX, None)}
    # later objects win, one without an address takes the name away
    assert terms_of(spark, [V11, {"ex": EX, "gone": EX}, {"ex": EX2, "gone": None}]) == {"ex": (EX2, None)}
    got = terms_of(spark, [{"a": "b:x", "b": "c:y/", "t": {"@id": "ex:t", "@type": "xsd:date"}}, {"c": EX, "ex": EX2, "w": "http://abs"}])
    assert got["a"] == (EX + "y/x", None) and got["b"] == (EX + "y/", None) and got["w"] == ("http://abs", None)
    assert got["t"] == (EX2 + "t", XSD + "date")


DOC = lamp(
    id="urn:own",
    **{
        "@context": [V11, {"ex": EX, "speed": "ex:velocity", "by": {"@id": "ex:by", "@type": "@id"}}, {"x2": EX2}],
        "@type": ["Thing", "ex:Lamp"],
        "ex:mass": 3.5,
        "speed": 7,
        "by": "ex:me",
        "x2:tags": ["b", "a"],
        "x2:part": [{"@type": "ex:Wheel", "ex:size": {"x2:unit": "m", "title": "not here"}}, {"speed": 1}],
        "other:key": 1,
        "stray": 2,
        "http://abs/p": False,
    },
)


def nested(depth):
    return {"ex:in": nested(depth - 1)} if depth else {"ex:leaf": "deep"}


def test_members_become_quads(spark):
    q = dedup(triplify(docs_df(spark, DOC))).collect()
    root = {(r.p, r.o, r.o_kind, r.o_dt) for r in q if r.s == "urn:own" and r.o_kind != "bnode"}
    assert {
        (EX + "mass", "3.5", "literal", XSD + "double"),
        (EX + "velocity", "7", "literal", XSD + "integer"),
        (EX + "by", EX + "me", "iri", None),
        (EX2 + "tags", "a", "literal", XSD + "string"),
        (EX2 + "tags", "b", "literal", XSD + "string"),
        ("http://abs/p", "false", "literal", XSD + "boolean"),
        (RDF_TYPE, EX + "Lamp", "iri", None),
        (TD + "title", "lamp", "literal", LANG_STRING),
    } <= root
    assert not [r for r in q if "stray" in r.p or "other" in r.p or r.o == "not here"]
    parts = [r.o for r in q if r.p == EX2 + "part"]
    assert len(parts) == 2 and {r.o for r in q if r.s in parts and r.p == EX + "velocity"} == {"1"}
    assert {r.s for r in q if r.o == EX + "Wheel"} <= set(parts)


@pytest.mark.parametrize("depth", [2, 6, 12])
def test_any_depth(spark, depth):
    doc = lamp(id="urn:deep", **{"@context": [V11, {"ex": EX}], "ex:in": nested(depth)})
    q = triplify(docs_df(spark, doc))
    assert q.where((F.col("p") == EX + "in")).count() == depth + 1
    assert [r.o for r in q.where(F.col("p") == EX + "leaf").collect()] == ["deep"]


def test_round_trip(spark):
    docs = docs_df(spark, DOC, lamp(id="urn:plain"))
    quads = dedup(triplify(docs)).cache()
    back, refused = assemble(quads, own_contexts(docs))
    bodies = {r.id: json.loads(r.body) for r in back.collect()}
    body = bodies["urn:own"]
    assert refused.count() == 0 and body["@context"] == DOC["@context"]
    for key in ("ex:mass", "speed", "http://abs/p"):
        assert body[key] == DOC[key]
    assert body["by"] == EX + "me" and sorted(body["x2:tags"]) == ["a", "b"] and sorted(body["@type"]) == ["Thing", "ex:Lamp"]
    wheel = next(x for x in body["x2:part"] if "@type" in x)
    assert wheel == {"@type": ["ex:Wheel"], "ex:size": {"x2:unit": "m"}} and {"speed": 1} in body["x2:part"]
    assert "stray" not in body and set(bodies["urn:plain"]) == {*lamp(), "id"}
    # the same quads again, node names and all
    again = triplify(back.select("id", F.parse_json("body").alias("doc")))
    named = lambda df: {(r.p, r.o, r.o_dt) for r in df.where("o_kind <> 'bnode'").collect()}
    assert named(again) == named(quads)
    # without the documents' terms members bear their addresses
    plain = {r.id: json.loads(r.body) for r in assemble(quads)[0].collect()}["urn:own"]
    assert plain[EX + "velocity"] == 7 and plain[EX + "by"] == {"@id": EX + "me"} and "@context" not in plain


def test_typed_values_keep_their_type(spark):
    doc = lamp(id="urn:t", **{"@context": [V11, {"made": {"@id": EX + "made", "@type": XSD + "date"}}], "made": "2024-05-01"})
    docs = docs_df(spark, doc)
    quads = dedup(triplify(docs))
    assert [r.o_dt for r in quads.where(F.col("p") == EX + "made").collect()] == [XSD + "date"]
    with_terms = json.loads(assemble(quads, own_contexts(docs))[0].first().body)
    assert with_terms["made"] == "2024-05-01"
    without = json.loads(assemble(quads)[0].first().body)
    assert without[EX + "made"] == {"@value": "2024-05-01", "@type": XSD + "date"}

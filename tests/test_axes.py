import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from thingfleet.operators import axes as X
from thingfleet.session import kept_by

DOCS = [
    {"id": "d0", "a": [1, {"b": "x<y & z", "c": [[1, 2], [True, None]]}, "t"], "b": {"a": {"b": {"b": "deep"}}}, "@type": "T"},
    {"id": "d1", "p": {"q": [{"r": 1, "s": []}, {"r": 2}, {"r": 3, "q": {"r": 4}}]}, "ex:k 1": "é", "9": 1.5},
    {"id": "d2"},
    {"id": "d3", "z": [], "y": {}, "x": ["", "u", "v", "w"], "w": "a\rb\x01"},
]
AXES = [
    "child", "parent", "self", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self",
    "following", "preceding", "following-sibling", "preceding-sibling",
]


class Element:
    """An element of the plain model."""

    def __init__(self, name, parent, value):
        self.name, self.parent, self.children = name, parent, []
        if isinstance(value, dict):
            self.text = None
            for k in sorted(value):
                self.add(k.replace("@", "").replace(":", "_x003A_").replace(" ", "_x0020_"), value[k])
        else:
            self.text = "" if value is None else value if isinstance(value, str) else json.dumps(value)

    def add(self, name, value):
        if isinstance(value, list):
            for v in value:
                self.add(name, v)
        else:
            self.children.append(Element("_" + name if name[0].isdigit() else name, self, value))


def in_order(e):
    return [e, *(x for c in e.children for x in in_order(c))]


def along(e, axis, everything):
    up = []
    while (up[-1] if up else e).parent:
        up.append((up[-1] if up else e).parent)
    inside = in_order(e)[1:]
    at = everything.index(e)
    family = e.parent.children if e.parent else [e]
    return {
        "child": e.children,
        "parent": up[:1],
        "self": [e],
        "descendant": inside,
        "descendant-or-self": [e, *inside],
        "ancestor": up,
        "ancestor-or-self": [e, *up],
        "following": everything[at + len(inside) + 1 :],
        "preceding": [x for x in everything[:at] if x not in up][::-1],
        "following-sibling": family[family.index(e) + 1 :],
        "preceding-sibling": family[: family.index(e)][::-1],
    }[axis]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(d["id"], json.dumps(d), 1) for d in DOCS] + [("list", "[1]", 1), ("null", None, 1)]
    docs = spark.createDataFrame(rows, "id string, body string, name int")
    return X.elements(docs.select("id", "name", F.parse_json("body").alias("doc"))).checkpoint()


def plain():
    return {d["id"]: in_order(Element(X.ROOT, None, d)) for d in DOCS}


def test_numbers_match_a_walk(table):
    got = {(r.id, r.pre): (r.last, r.level, r.above, r.name) for r in table.collect()}
    wanted = {}
    for id_, all_ in plain().items():
        for i, e in enumerate(all_):
            level = len(along(e, "ancestor", all_))
            above = all_.index(e.parent) + 1 if e.parent else None
            wanted[id_, i + 1] = (i + len(in_order(e)), level, above, e.name)
    assert got == wanted


@pytest.mark.parametrize("axis", AXES)
def test_axes_match_a_walk(table, axis):
    cases = [(None, None, None), ("b", "r", None), ("q", None, None), ("b", "b", None)]
    if axis in X.COUNTED:
        cases += [(None, None, 2), ("r", "r", 1), ("x", "x", 2), (None, "r", 1), ("b", None, 1)]
    for start, name, position in cases:
        context = table.where(F.col("name") == start) if start else table
        got = X.step(context, table, axis, name, position=position).select("id", "pre").collect()
        wanted = set()
        for id_, all_ in plain().items():
            for e in all_:
                if start in (None, e.name):
                    hits = [x for x in along(e, axis, all_) if name in (None, x.name)]
                    hits = hits if position is None else hits[position - 1 : position]
                    wanted |= {(id_, all_.index(x) + 1) for x in hits}
        assert sorted((r.id, r.pre) for r in got) == sorted(wanted), (start, name, position)


def test_paths_and_tests(table):
    found = X.path(table, ("descendant", "b", F.col("value") == "deep"), ("ancestor", "a"), ("parent",))
    assert [(r.id, r.name, r.level) for r in found.collect()] == [("d0", "b", 1)]
    assert X.path(table.where("id = 'none'"), ("child",)).count() == 0
    with pytest.raises(ValueError):
        X.step(table, table, "following", position=1)
    with pytest.raises(ValueError):
        X.step(table, table, "attribute")


def test_xml_is_read_back(table):
    got = {r.id: ET.fromstring(r.xml) for r in X.to_xml(table).collect()}
    assert set(got) == {d["id"] for d in DOCS}
    for id_, all_ in plain().items():
        read = [(e.tag, e.text or "") for e in got[id_].iter()]
        assert read == [(e.name, (e.text or "").replace("\x01", "�")) for e in all_]


def test_elements_are_numbered_without_a_join(spark):
    # a table of elements is many times its documents' size, which the plan cannot know: it must never be broadcast
    docs = spark.createDataFrame([(d["id"], json.dumps(d)) for d in DOCS], "id string, body string")
    docs = docs.select("id", F.parse_json("body").alias("doc"))
    plan = X.elements(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_steps_over_buckets_shuffle_nothing(spark, table):
    docs = spark.createDataFrame([(d["id"], json.dumps(d)) for d in DOCS], "id string, body string")
    docs = docs.select("id", F.parse_json("body").alias("doc"))
    rows = kept_by(X.elements(docs, parts=3), "elements", "id", 3)
    assert sorted(rows.collect()) == sorted(table.select(*rows.columns).collect())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("elements")]
    cases = [(axis, None, None) for axis in AXES] + [(axis, "r", 1) for axis in X.COUNTED]
    found = None
    for axis, name, position in cases:
        one = X.step(X.path(rows, ("descendant", "q")), rows, axis, name, position=position)
        same = X.step(X.path(table, ("descendant", "q")), table, axis, name, position=position)
        assert sorted((r.id, r.pre) for r in one.collect()) == sorted((r.id, r.pre) for r in same.collect()), axis
        found = one if found is None else found.unionByName(one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") > len(cases) and "Exchange" not in plan


def test_rows_without_an_id_are_met_by_none(spark):
    docs = spark.createDataFrame([("d", json.dumps(DOCS[0])), (None, json.dumps(DOCS[0]))], "id string, body string")
    rows = X.elements(docs.select("id", F.parse_json("body").alias("doc"))).checkpoint()
    for axis, position in [("child", None), ("self", None), ("descendant", None), ("child", 1), ("descendant", 1)]:
        assert {r.id for r in X.step(X.roots(rows), rows, axis, position=position).collect()} == {"d"}

"""Searches from postings against a plain walk over the documents."""

import json
import random

import pytest

from thingfleet.sources.path_index import ANY, DEEP, ITEM, PathIndex, Test

NAMES = ["a", "b", "a.b", "[", "x\\y"]


def value(rnd, depth):
    if depth and rnd.random() < 0.6:
        if rnd.random() < 0.4:
            return [value(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
        return {n: value(rnd, depth - 1) for n in rnd.sample(NAMES, rnd.randint(0, 3))}
    return rnd.choice([None, True, False, 0, 1, 2.5, -3, "1", "true", "t", ""])


def reached(node, steps):
    if not steps:
        return [node]
    step, rest = steps[0], steps[1:]
    members = list(node.values()) if isinstance(node, dict) else []
    items = node if isinstance(node, list) else []
    if step is DEEP:
        return reached(node, rest) + [x for c in [*members, *items] for x in reached(c, steps)]
    if step is ITEM:
        chosen = items
    elif step is ANY:
        chosen = [*members, *items]
    else:
        chosen = [node[step]] if isinstance(node, dict) and step in node else []
    return [x for c in chosen for x in reached(c, rest)]


def passes(doc, test):
    def ok(x):
        if test.op is None:
            return True
        kind = lambda v: bool if isinstance(v, bool) else str if isinstance(v, str) else float if isinstance(v, (int, float)) else None
        if kind(x) != kind(test.value):
            return False
        return {"=": x == test.value, "<": x < test.value, "<=": x <= test.value, ">": x > test.value, ">=": x >= test.value}[test.op]

    return any(ok(x) for x in reached(doc, test.steps))


SEARCHES = [
    (Test(("a",)),),
    (Test(("a.b",)), Test(("[",))),
    (Test(("x\\y", DEEP), "=", "t"),),
    (Test(("a", "b")), Test(("b",))),
    (Test(("a", ITEM), ">", 0),),
    (Test((ANY, ITEM)), Test((DEEP, "a"))),
    (Test((DEEP, "b"), "<=", 2.5), Test(("a",)), Test((DEEP, ITEM, DEEP, ANY), "=", "1")),
    (Test((DEEP, "a"), "=", True), Test((ANY,), "<", "u")),
    (Test(("missing",)),),
]


def test_searches_equal_a_walk(spark):
    rnd = random.Random(8)
    docs = {f"d{i}": {n: value(rnd, 3) for n in rnd.sample(NAMES, 3)} for i in range(150)}
    rows = [(i, json.dumps(d)) for i, d in docs.items()] + [("none", None), ("torn", "{"), ("flat", "5"), ("empty", "{}")]
    # a document that is there twice is found once
    table = spark.createDataFrame(rows + rows[:3], "id string, body string").repartition(3)
    index = PathIndex.build(table)
    for tests in SEARCHES:
        found = sorted(r.id for r in index.search(*tests).collect())
        assert found == sorted(i for i, d in docs.items() if all(passes(d, t) for t in tests)), tests
    assert index.documents(table, Test(("a",))).where("id = 'd0'").count() == (2 if "a" in docs["d0"] else 0)
    plan = index.ids(SEARCHES[0][0])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan and "number" not in plan.split("ReadSchema")[1]


def test_nothing_and_wrong_tests(spark):
    index = PathIndex.build(spark.createDataFrame([], "id string, body string"))
    assert index.search(Test(("a",)), Test((DEEP,))).collect() == [] and index.paths().collect() == []
    for wrong in (lambda: Test(()), lambda: Test(("a",), "="), lambda: Test(("a",), "~", 1), lambda: index.search()):
        with pytest.raises(ValueError):
            wrong()

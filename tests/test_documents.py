import json
import random

import pytest
from conftest import V10, V11, docs_df, lamp, legacy
from pyspark.sql import functions as F

from thingfleet.functions import documents as D
from thingfleet.operators.nodes import assemble_nodes, flatten, path_text
from thingfleet.sources.catalog import search, variant_search


def upgraded(spark, doc):
    df = docs_df(spark, doc).select(F.to_json(D.upgrade(D.fields(F.col("doc")))).alias("j"))
    return json.loads(df.first().j)


def test_upgrade_rewrites_every_legacy_member(spark):
    out = upgraded(spark, legacy())
    assert out == {
        "@context": [V11, {"ex": "http://ex/"}],
        "@version": "1.1",
        "id": "urn:dev:2",
        "title": "old",
        "security": ["nosec_sc"],
        "registration": {"created": "2024-01-01T00:00:00Z"},
        "securityDefinitions": {"nosec_sc": {"scheme": "nosec"}, "basic_sc": {"scheme": "basic"}},
    }


@pytest.mark.parametrize(
    "context, wanted",
    [
        (V10, V11),
        (V11, V11),
        ("http://other/", "http://other/"),
        ({V10: "x", "a": "b"}, {V10: V11, "a": "b"}),
        ({"a": "b"}, {"a": "b"}),
        ([V10, V11, {"a": "b"}, V10], [V11, V11, {"a": "b"}, V11]),
    ],
)
def test_upgrade_context(spark, context, wanted):
    assert upgraded(spark, {"@context": context})["@context"] == wanted


def test_upgrade_context_absent_and_version_present(spark):
    assert upgraded(spark, {"a": 1})["@context"] == V11
    current = {"@version": "1.1", "td:title": "kept", "security": "kept"}
    assert upgraded(spark, current) == current


def test_decorate(spark):
    now = F.lit("2024-05-05T01:02:03.5Z").cast("timestamp")
    stamp = "2024-05-05T01:02:03.500000Z"

    def run(doc):
        df = docs_df(spark, doc).select(F.to_json(D.decorate(D.fields(F.col("doc")), now)).alias("j"))
        return json.loads(df.first().j)

    assert run({"a": 1})["@type"] == ["Thing"]
    assert run({"@type": "Lamp"})["@type"] == ["Lamp", "Thing"]
    assert run({"@type": ["A", "Thing"]})["@type"] == ["A", "Thing"]
    assert run({"@type": "https://www.w3.org/2019/wot/td#Thing"})["@type"].endswith("#Thing")
    assert run({"a": 1})["registration"] == {"created": stamp, "modified": stamp}
    assert run({"registration": {"created": "x"}})["registration"] == {"created": "x", "modified": stamp}


def test_overlay_replaces_top_level_only(spark):
    df = spark.createDataFrame(
        [('{"a":{"x":1,"y":2},"b":1,"c":2}', '{"a":{"x":9},"b":null,"d":3}')], "o string, n string"
    )
    j = df.select(
        F.to_json(D.overlay(D.fields(F.parse_json("o")), D.fields(F.parse_json("n")))).alias("j")
    ).first().j
    assert json.loads(j) == {"a": {"x": 9}, "b": None, "c": 2, "d": 3}


def strip(v, inside_array=False):
    if isinstance(v, dict):
        return {k: strip(x, inside_array) for k, x in v.items() if inside_array or x is not None}
    if isinstance(v, list):
        return [strip(x, True) for x in v]
    return v


def any_json(rng, depth=0):
    kind = rng.choice(["obj", "arr", "str", "num", "bool", "null"] if depth < 5 else ["str", "null"])
    if kind == "obj":
        return {
            rng.choice(["a", "b.c", 'q"q', "é", "[0]", "", "x y"]): any_json(rng, depth + 1)
            for _ in range(rng.randint(0, 4))
        }
    if kind == "arr":
        return [any_json(rng, depth + 1) for _ in range(rng.randint(0, 12))]
    if kind == "str":
        return rng.choice(["", 'a"b', "line\nbreak", "{[", "]}", "null", "ü\\"])
    if kind == "num":
        return rng.choice([0, -5, 12345678901, 1.5])
    return True if kind == "bool" else None


def test_walk_print_and_null_removal_agree_with_plain_recursion(spark):
    rng = random.Random(7)
    docs = [{"id": f"d{i}", "v": any_json(rng), "w": any_json(rng)} for i in range(60)]
    df = docs_df(spark, *docs)
    bound = D.nesting_depth(F.col("body"))
    got = {r.id: json.loads(r.j) for r in df.select("id", D.remove_nulls(F.col("doc"), bound).alias("j")).collect()}
    assert got == {d["id"]: strip(d) for d in docs}
    again = {r.id: json.loads(r.body) for r in assemble_nodes(flatten(df)).collect()}
    assert again == {d["id"]: d for d in docs}


def test_flatten_columns(spark):
    df = docs_df(spark, {"id": "a", "x": {"y": [1, "s", True, None]}})
    rows = {
        r.p: (r.depth, r.key, r.pos, r.kind, r.v_str, r.v_num, r.v_bool)
        for r in flatten(df).withColumn("p", path_text()).collect()
    }
    assert rows == {
        "$": (0, None, None, "object", None, None, None),
        "$.id": (1, "id", None, "string", "a", None, None),
        "$.x": (1, "x", None, "object", None, None, None),
        "$.x.y": (2, "y", None, "array", None, None, None),
        "$.x.y[0]": (3, None, 0, "number", None, 1.0, None),
        "$.x.y[1]": (3, None, 1, "string", "s", None, None),
        "$.x.y[2]": (3, None, 2, "boolean", None, None, True),
        "$.x.y[3]": (3, None, 3, "null", None, None, None),
    }


DOC = {
    "id": "a",
    "store": {"book": [{"t": "x", "p": 8}, {"t": "y", "p": 12, "isbn": "1"}, {"t": "z", "p": 22}]},
    "deep": {"a": {"b": {"href": "h1"}}, "list": [{"href": "h2"}]},
    "tags": ["r", "g"],
}


@pytest.mark.parametrize(
    "path, wanted",
    [
        (D.Path().child("store").child("book").index(0).child("t"), ["x"]),
        (D.Path().child("store").child("book").index(-1, 0).child("t"), ["z", "x"]),
        (D.Path().child("store").child("book").slice(1).child("t"), ["y", "z"]),
        (D.Path().child("store").child("book").slice(-2, -1).child("t"), ["y"]),
        (D.Path().child("store").child("book").slice(0, 2).child("t", "p"), ["x", 8, "y", 12]),
        (D.Path().child("deep").any().any(), [{"href": "h1"}, {"href": "h2"}]),
        (D.Path().deep("href"), ["h2", "h1"]),
        (D.Path().child("store").child("book").where(lambda v: D.member(v, "p", "double") > 10).child("t"), ["y", "z"]),
        (D.Path().child("store").child("book").where(lambda v: D.member(v, "isbn").isNotNull()).child("t"), ["y"]),
        (D.Path().child("store").child("book").where(lambda v: D.member(v, "t").rlike("^[xz]$")).child("p"), [8, 22]),
        (D.Path().child("nothing").any().index(3), []),
        (D.Path().child("tags").any(), ["r", "g"]),
    ],
)
def test_path_steps(spark, path, wanted):
    df = docs_df(spark, DOC).select(F.to_json(path.nodes(F.col("doc"))).alias("j"), path.found(F.col("doc")).alias("f"))
    row = df.first()
    key = lambda v: json.dumps(v, sort_keys=True)
    assert sorted(json.loads(row.j), key=key) == sorted(wanted, key=key)
    assert row.f == bool(wanted)


def test_path_functions(spark):
    df = docs_df(spark, {"id": "a", "n": [1, 2, 6], "s": ["a", "b"], "o": {"k": 1, "j": 2}})
    numbers = D.Path().child("n").any().nodes(F.col("doc"))
    texts = D.Path().child("s").any().nodes(F.col("doc"))
    obj = D.Path().child("o").nodes(F.col("doc"))
    row = df.select(
        *[D.path_function(n, numbers).alias(n) for n in ("min", "max", "sum", "avg", "stddev", "length")],
        D.path_function("concat", texts).alias("concat"),
        D.path_function("keys", obj).alias("keys"),
        D.path_function("first", numbers).cast("int").alias("first"),
        D.path_function("last", numbers).cast("int").alias("last"),
        D.path_function("index", numbers, F.lit(1)).cast("int").alias("at"),
        F.size(D.path_function("append", numbers, F.lit(9).cast("variant"))).alias("more"),
    ).first()
    assert (row.min, row.max, row.sum, row.avg, row.length) == (1, 6, 9, 3, 3)
    assert abs(row.stddev - (14 / 3) ** 0.5) < 1e-9
    assert (row["concat"], row["keys"], row["first"], row["last"], row["at"], row["more"]) == ("ab", ["j", "k"], 1, 6, 2, 4)
    with pytest.raises(ValueError):
        D.path_function("nope", numbers)


def test_search(spark):
    df = docs_df(spark, lamp(id="urn:1"), lamp(id="urn:2", title="other"), {"id": "urn:3"})
    hit = search(df, D.Path().child("properties").any().child("type"))
    assert {r.id for r in hit.collect()} == {"urn:1", "urn:2"}
    assert {r.id for r in variant_search(df, "$.title").collect()} == {"urn:1", "urn:2"}
    with pytest.raises(ValueError):
        variant_search(df, "title")
    with pytest.raises(ValueError):
        D.Path().child()


def test_instant_text_is_utc(spark):
    df = spark.sql("select timestamp_micros(1714870923123456) t, timestamp_micros(-1) b")
    row = df.select(D.instant_text(F.col("t")).alias("t"), D.instant_text(F.col("b")).alias("b")).first()
    assert row.t == "2024-05-05T01:02:03.123456Z"
    assert row.b == "1969-12-31T23:59:59.999999Z"


def test_nulls_are_removed_at_every_depth_and_kept_in_arrays(spark):
    def without(v):
        return {k: without(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v

    deep = {"z": None, "a\"": 1, "l": [None, {"x": None}], "e": {}, "n": {"only": None}, "t": "null"}
    for i in range(7):
        deep = {"in": deep, "gone": None, "B": i, "b": [[{"y": None}]]}
    given = [deep, {}, {"a": None}, [None, {"a": None}], "null", None, 1.5, {"k": "no such word"}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(given)], "i int, b string")
    got = df.select("i", D.remove_nulls(F.parse_json("b"), D.nesting_depth(F.col("b"))).alias("t")).orderBy("i").collect()
    assert [json.loads(r.t) for r in got] == [without(v) for v in given]
    # the first levels are printed member by member, without arrays of all nodes down to the bound
    shallow = spark.createDataFrame([('{"a":{"b":{"c":null,"d":1}}}',)], "b string")
    assert shallow.select(D.remove_nulls(F.parse_json("b"), F.lit(1))).first()[0] == '{"a":{"b":{"d":1}}}'

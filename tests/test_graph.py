"""Pattern algebra against plain Python on small random tables."""

import random

import pytest
from pyspark.sql import functions as F

from thingfleet.functions import terms as T
from thingfleet.operators import aggregates as agg
from thingfleet.operators import algebra as al
from thingfleet.operators import property_paths as pp
from thingfleet.plans.patterns import ANY, bgp, num, triple
from thingfleet.schema import QUADS
from thingfleet.sources.graphs import QuadTable, dedup


def quad(g, s, p, o, kind="iri", number=None):
    return (g, s, p, o, kind, None, None, number, None)


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        quad("g1", "a", "knows", "b"),
        quad("g1", "b", "knows", "c"),
        quad("g2", "c", "knows", "c"),
        quad("g1", "a", "age", "30", "literal", 30.0),
        quad("g1", "b", "age", "4", "literal", 4.0),
        quad("g1", "a", "name", "A", "literal"),
        quad("g1", "b", "name", "B", "literal"),
        quad(None, "z", "name", "Z", "literal"),
    ]
    return spark.createDataFrame(rows, QUADS)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_bgp_joins_constants_and_repeats(small):
    g = QuadTable(small)
    assert rows(bgp(g, [triple("?x", "knows", "?y"), triple("?y", "age", num("?n"))]).select("x", "y", "n")) == [
        ("a", "b", 4.0)
    ]
    assert rows(bgp(g, [triple("?x", "knows", "?x")])) == [("c",)]
    assert rows(bgp(g, [triple("a", "knows", "?y")])) == [("b",)]
    assert rows(bgp(g, [triple("?x", "?p", "c")]).select("x", "p")) == [("b", "knows"), ("c", "knows")]


def test_graph_scopes(small):
    g = QuadTable(small)
    both = [triple("?x", "knows", "?y"), triple("?y", "knows", "?z")]
    assert len(rows(bgp(g, both, ANY))) == 3
    assert rows(bgp(g, both, "?g").select("g", "x", "z")) == [("g1", "a", "c"), ("g2", "c", "c")]
    assert rows(bgp(g, [triple("?x", "knows", "?y")], "g2")) == [("c", "c")]
    assert rows(bgp(g, [triple("?x", "name", "?y")], None)) == [("z", "Z")]
    assert rows(bgp(g, [triple("?x", "name", "?n")], "?g").select("x")) == [("a",), ("b",)]


def test_star_fusion_equals_joins(small):
    star = [triple("?x", "name", "?n"), triple("?x", "age", num("?a"))]
    fused = bgp(QuadTable(small, ("name", "age")), star, "?g").select("g", "x", "n", "a")
    plain = bgp(QuadTable(small), star, "?g").select("g", "x", "n", "a")
    assert rows(fused) == rows(plain) == [("g1", "a", "A", 30.0), ("g1", "b", "B", 4.0)]
    assert "Join" not in fused._jdf.queryExecution().optimizedPlan().toString()


def test_unconnected_patterns_multiply_a_small_side_only(spark, small):
    g = QuadTable(small)
    out = bgp(g, [triple("?x", "age", "?n"), triple("?y", "knows", "c")])
    assert len(rows(out)) == 4
    big = spark.range(12_000)
    assert al.product(big.toDF("a"), big.toDF("b")).count() == 144_000_000


def _agree(x, y, keys):
    return all(x[k] is None or y[k] is None or x[k] == y[k] for k in keys)


def test_unbound_variables_agree_with_anything(spark):
    rng = random.Random(9)
    for _ in range(2):
        (a, left), (b, right) = table(spark, rng, ["x", "y", "u"], nulls=("x", "y")), table(spark, rng, ["x", "y", "v"], nulls=("x", "y"))
        met = [r for r in left if any(_agree(r, o, "xy") for o in right)]
        key = lambda rs: sorted([tuple(r.values()) for r in rs], key=str)
        assert key([r.asDict() for r in al.exists(a, b).collect()]) == key(met)
        assert key([r.asDict() for r in al.not_exists(a, b).collect()]) == key([r for r in left if r not in met])
        joined = [{k: r[k] if r[k] is not None else o[k] for k in "xy"} | {"u": r["u"], "v": o["v"]} for r in left for o in right if _agree(r, o, "xy")]
        wanted = joined + [r | {"v": None} for r in left if r not in met]
        assert key([r.asDict() for r in al.optional(a, b).select("x", "y", "u", "v").collect()]) == key(wanted)
        rows_ = [("p", None), (None, "q"), ("r", "r")]
        data = [dict(zip("xy", r)) for r in rows_]
        assert al.values(a, ["x", "y"], rows_).count() == sum(_agree(r, o, "xy") for r in left for o in data)
    assert al.values(a, ["w"], [("1",), ("2",)]).count() == 2 * len(left)


def test_stars_over_any_graph(spark, small):
    split = small.withColumn("g", F.when(F.col("p") == "name", "g1").otherwise("g2"))
    star = [triple("?x", "name", "?n"), triple("?x", "age", num("?a"))]
    assert rows(bgp(QuadTable(split, ("name", "age")), star).select("x", "n", "a")) == rows(bgp(QuadTable(split), star).select("x", "n", "a"))


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("b", None)], "k string, v string")
    for distinct, a in ((True, "x,y"), (False, "x,x,y")):
        assert {r.k: r.j for r in agg.group_concat(df, ["k"], "v", ",", distinct, "j").collect()} == {"a": a, "b": ""}


def table(spark, rng, names, n=12, nulls=()):
    data = [
        tuple(None if c in nulls and rng.random() < 0.35 else rng.choice("pqr") for c in names)
        for _ in range(n)
    ]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in names)), [dict(zip(names, r)) for r in data]


def compatible(x, y):
    return all(x.get(k) is None or y.get(k) is None or x[k] == y[k] for k in x.keys() & y.keys())


@pytest.mark.parametrize("seed", [1, 2])
def test_unbound_aware_join_and_minus(spark, seed):
    rng = random.Random(seed)
    a, pa = table(spark, rng, ["x", "y", "u"], nulls=("x", "y"))
    b, pb = table(spark, rng, ["x", "y", "v"], nulls=("x", "y"))
    wanted = []
    for p in pa:
        for q in pb:
            if compatible(p, q):
                wanted.append(tuple(p[k] if p[k] is not None else q[k] for k in "xy") + (p["u"], q["v"]))
    assert rows(al.compat_join(a, b).select("x", "y", "u", "v")) == sorted(
        wanted, key=lambda t: tuple((x is not None, str(x)) for x in t)
    )
    kept = [
        tuple(p.values())
        for p in pa
        if not any(
            compatible(p, q) and any(p[k] is not None and q[k] is not None for k in "xy") for q in pb
        )
    ]
    assert rows(al.minus(a, b)) == sorted(kept, key=lambda t: tuple((x is not None, str(x)) for x in t))
    assert rows(al.minus(a, b.select("v"))) == rows(a)


def test_optional_exists_values_union(spark):
    a = spark.createDataFrame([("1", 5), ("2", 6), ("3", 7)], "x string, n int")
    b = spark.createDataFrame([("1", 1), ("2", 9)], "x string, m int")
    assert rows(al.optional(a, b, F.col("m") < F.col("n"))) == rows(
        spark.createDataFrame([("1", 5, 1), ("2", 6, None), ("3", 7, None)], "x string, n int, m int")
    )
    assert rows(al.exists(a, b)) == [("1", 5), ("2", 6)]
    assert rows(al.not_exists(a, b, F.col("m") > F.col("n"))) == [("1", 5), ("3", 7)]
    assert rows(al.values(a, ["x"], [("3",), ("9",)])) == [("3", 7)]
    assert len(rows(al.values(a, ["x", "n"], [("3", None), (None, 5)]))) == 2
    assert al.union(a, b).columns == ["x", "n", "m"] and al.union(a, b).count() == 5
    assert rows(al.theta(a, b, F.col("m") > F.col("n"))) == [("2", 6, 9)]
    assert al.ask(a) and not al.ask(a.where("n > 100"))


def naive_closure(pairs):
    out = set(pairs)
    while True:
        more = out | {(a, d) for a, b in out for c, d in pairs if b == c}
        if more == out:
            return out
        out = more


@pytest.mark.parametrize("seed, n, m", [(1, 8, 12), (2, 6, 6), (3, 12, 8)])
def test_closure(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)}
    edges = spark.createDataFrame(sorted(pairs), "s string, o string")
    wanted = naive_closure(pairs)
    assert set(rows(pp.one_or_more(edges))) == wanted
    start = spark.createDataFrame([("0",), ("1",)], "s string")
    assert set(rows(pp.one_or_more(edges, start))) == {p for p in wanted if p[0] in "01" and len(p[0]) == 1}
    everything = {(x, x) for p in pairs for x in p}
    assert set(rows(pp.zero_or_more(edges))) == wanted | everything
    assert set(rows(pp.zero_or_one(edges))) == pairs | everything


def test_closure_of_a_long_chain_and_a_ring(spark):
    chain = spark.range(300).selectExpr("cast(id as string) s", "cast(id + 1 as string) o")
    start = spark.createDataFrame([("0",)], "s string")
    assert pp.one_or_more(chain, start).count() == 300
    ring = spark.range(7).selectExpr("cast(id as string) s", "cast((id + 1) % 7 as string) o")
    assert pp.one_or_more(ring, start).count() == 7


def test_path_forms(spark, small):
    knows = pp.edges(QuadTable(small), "knows")
    assert rows(pp.seq(knows, knows)) == [("a", "c"), ("b", "c"), ("c", "c")]
    assert rows(pp.inverse(knows)) == [("b", "a"), ("c", "b"), ("c", "c")]
    assert pp.alternative(knows, knows).count() == 6
    assert {r[0] for r in rows(pp.negated(small, "knows", "age"))} == {"a", "b", "z"}


def test_describe_follows_blank_nodes(spark):
    quads = spark.createDataFrame(
        [
            quad("g", "a", "p", "_:1", "bnode"),
            quad("g", "_:1", "q", "_:2", "bnode"),
            quad("g", "_:2", "r", "_:1", "bnode"),
            quad("g", "_:2", "r", "x"),
            quad("g", "b", "p", "x"),
            quad("h", "_:1", "q", "other graph"),
        ],
        QUADS,
    )
    out = al.describe(quads, spark.createDataFrame([("a",)], "s string"))
    assert {(r.g, r.s, r.o) for r in out.collect()} == {
        ("g", "a", "_:1"), ("g", "_:1", "_:2"), ("g", "_:2", "_:1"), ("g", "_:2", "x"),
    }


def test_construct_and_dedup(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", None)], "s string, v string")
    out = al.construct(a, [(F.col("s"), F.lit("p"), F.col("v"), "literal"), (F.col("s"), F.lit("t"), F.lit("c"), "iri")])
    assert rows(out.select("s", "p", "o")) == [("1", "p", "x"), ("1", "t", "c"), ("2", "t", "c")]
    q = spark.createDataFrame([quad("g", "a", "p", "x")] * 3, QUADS)
    assert dedup(q).count() == 1


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", 3.0)], "k string, n double")
    got = {r.k: (r.s, r.m, r.c) for r in df.groupBy("k").agg(
        agg.total(F.col("n")).alias("s"), agg.mean(F.col("n")).alias("m"), agg.count(F.col("n")).alias("c")).collect()}
    assert got == {"a": (3.0, 1.5, 2), "b": (None, None, 1)}
    empty = df.where("false").agg(agg.total(F.col("n")).alias("s"), agg.mean(F.col("n")).alias("m")).first()
    assert (empty.s, empty.m) == (0.0, 0.0)
    joined = agg.group_concat(spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "k string, v string"), ["k"], "v", ",", True)
    assert rows(joined) == [("a", "x,y")]


def test_order_of_kinds(spark):
    df = spark.createDataFrame([("l", "literal"), ("i", "iri"), ("_:b", "bnode"), (None, None)], "v string, kind string")
    assert [r.v for r in al.order_solutions(df, (F.col("v"), F.col("kind"))).collect()] == [None, "_:b", "i", "l"]


def test_functions(spark):
    df = spark.createDataFrame([("a b/ü~*+c", "2011-01-10T14:45:13.815-05:00", "en-GB", "x-y-z")], "u string, d string, l string, h string")
    row = df.select(
        T.encode_for_uri(F.col("u")).alias("u"),
        T.tz(F.col("d")).alias("tz"),
        T.timezone_minutes(F.col("d")).alias("tzm"),
        T.lang_matches(F.col("l"), "EN").alias("lm"),
        T.lang_matches(F.col("l"), "fr").alias("lf"),
        T.lang_matches(F.col("l"), "*").alias("la"),
        T.str_before(F.col("h"), "-").alias("b"),
        T.str_after(F.col("h"), "-").alias("a"),
        T.str_after(F.col("h"), "?").alias("none"),
        T.round_half_up(F.lit(-2.5)).alias("r"),
        T.cast_term(F.lit("12x"), "integer").alias("ci"),
        T.cast_term(F.lit("1"), "boolean").alias("cb"),
        T.regex(F.col("h"), "^X", "i").alias("re"),
        T.replace(F.col("h"), "-", "+").alias("rp"),
        T.datatype(F.lit(None).cast("string"), F.col("l")).alias("dt"),
    ).first()
    assert row.u == "a%20b%2F%C3%BC~%2A%2Bc"
    assert (row.tz, row.tzm, row.lm, row.lf, row.la) == ("-05:00", -300, True, False, True)
    assert (row.b, row.a, row.none, row.r, row.ci, row.cb, row.re, row.rp) == ("x", "y-z", "", -2, None, True, True, "x+y+z")
    assert row.dt.endswith("langString")


def test_numbers_of_any_size(spark):
    big = "1234567890123456789012345"
    rows = [("a", "1.25"), ("a", big), ("b", "0.1"), ("b", "0.2"), ("c", "1"), ("c", "much"), ("d", "9" * 20), ("d", "1e-30")]
    numbers = spark.createDataFrame(rows, "g string, x string").select("g", T.number(F.col("x")).alias("n"))
    got = {r.g: r for r in numbers.groupBy("g").agg(agg.total_number(F.col("n")).alias("t"), agg.mean_number(F.col("n")).alias("m")).collect()}
    assert got["a"].t.exact is None and got["a"].t.approx == float(big) + 1.25
    assert got["a"].m.approx == (float(big) + 1.25) / 2
    assert str(got["b"].t.exact).rstrip("0") == "0.3" and got["b"].t.approx == 0.3
    assert got["c"].t.approx is None and got["c"].m.approx is None
    assert got["d"].t.approx == 1e20

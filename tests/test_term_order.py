"""Sort keys of mixed terms against the order of the values themselves."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from thingfleet.functions.term_order import instant_key, number_key, sort_key
from thingfleet.operators import algebra as al
from thingfleet.operators.ordered import positions
from thingfleet.vocab import LANG_STRING, XSD


def keyed(spark, texts, make):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.k for r in df.select("t", make(F.col("t")).alias("k")).collect()}


def written(rnd):
    sign = rnd.choice(["", "-", "+"])
    body = rnd.choice(["{a}", "{a}.{b}", ".{b}", "{a}.", "000{a}.{b}00", "{a}{b}{a}{b}{a}{b}", "0", "0.00{b}"])
    a, b = rnd.randint(0, 10 ** rnd.randint(0, 9)), rnd.randint(0, 10 ** rnd.randint(0, 9))
    tail = rnd.choice(["", "", f"e{rnd.randint(-30, 30)}", f"E+{rnd.randint(0, 9)}"])
    return sign + body.format(a=a, b=b) + tail


def test_numbers_of_any_length_sort_by_value(spark):
    rnd = random.Random(5)
    texts = [written(rnd) for _ in range(600)] + ["1", "1.0", "01", "10e-1", "-0", "0.000", "9" * 60, "-" + "9" * 61, "1" + "0" * 60]
    keys = keyed(spark, texts, number_key)
    assert None not in keys.values()
    with localcontext() as c:
        c.prec = 500
        values = {t: Decimal(t) for t in keys}
        ordered = sorted(keys, key=keys.get)
        assert all(values[a] <= values[b] for a, b in zip(ordered, ordered[1:]))
        assert all((keys[a] == keys[b]) == (values[a] == values[b]) for a, b in zip(ordered, ordered[1:]))


def test_what_is_no_number_has_no_key(spark):
    none = ["", " ", ".", "-", "e5", "1e", "1.2.3", "x", "1 2", "--1", "1e9999999999999999"]
    assert set(keyed(spark, none, number_key).values()) == {None}
    keys = keyed(spark, ["NaN", "-INF", "-1e99", "0", "1e99", "INF"], number_key)
    assert sorted(keys, key=keys.get) == ["NaN", "-INF", "-1e99", "0", "1e99", "INF"]


def test_instants_sort_by_moment(spark):
    rnd = random.Random(6)
    values = {}
    for _ in range(300):
        zone = timezone(timedelta(minutes=rnd.choice([0, 60, -330, 840])))
        when = datetime(rnd.randint(1890, 2100), 1, 1, tzinfo=zone) + timedelta(seconds=rnd.randint(0, 10**7), microseconds=rnd.choice([0, 5, 500000]))
        values[when.isoformat()] = when
    values["2024-01-01"] = datetime(2024, 1, 1, tzinfo=timezone.utc)
    values["2024-01-01T00:00:00"] = values["2024-01-01Z"] = values["2024-01-01"]
    keys = keyed(spark, list(values), instant_key)
    ordered = sorted(keys, key=keys.get)
    assert all(values[a] <= values[b] for a, b in zip(ordered, ordered[1:]))
    assert keys["2024-01-01"] == keys["2024-01-01T00:00:00"] == keys["2024-01-01Z"]
    fine = keyed(spark, ["2024-01-01T00:00:00.1234567Z", "2024-01-01T00:00:00.1234568Z"], instant_key)
    assert fine["2024-01-01T00:00:00.1234567Z"] < fine["2024-01-01T00:00:00.1234568Z"]
    assert set(keyed(spark, ["", "2024-13-01", "noon", "2024-01-01T25:00:00Z"], instant_key).values()) == {None}


ORDERED = [
    (None, None, None, None),
    ("_:a", "bnode", None, None),
    ("_:b", "bnode", None, None),
    ("http://a/", "iri", None, None),
    ("http://b/", "iri", None, None),
    ("-INF", "literal", XSD + "double", None),
    ("-10.5", "literal", XSD + "decimal", None),
    ("-9", "literal", XSD + "integer", None),
    ("7e-1", "literal", XSD + "double", None),
    ("10", "literal", XSD + "unsignedInt", None),
    ("", "literal", None, None),
    ("Z", "literal", XSD + "string", None),
    ("a", "literal", None, None),
    ("a\0b", "literal", None, None),
    ("é", "literal", None, None),
    ("2024-01-01T01:00:00+02:00", "literal", XSD + "dateTime", None),
    ("2024-01-01", "literal", XSD + "date", None),
    ("a", "literal", LANG_STRING, "de"),
    ("a", "literal", LANG_STRING, "EN"),
    ("a\0", "literal", LANG_STRING, "de"),
    ("b", "literal", LANG_STRING, "de"),
    ("0", "literal", XSD + "boolean", None),
    ("true", "literal", XSD + "boolean", None),
    ("x", "literal", "http://own/a", None),
    ("w", "literal", "http://own/b", None),
    ("maybe", "literal", XSD + "boolean", None),
    ("ten", "literal", XSD + "integer", None),
]


def test_all_kinds_in_one_column(spark):
    rows = [(i, *r) for i, r in enumerate(ORDERED)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "i int, v string, kind string, dt string, tag string").repartition(5)
    key = sort_key(F.col("v"), F.col("kind"), F.col("dt"), F.col("tag"))
    n = len(ORDERED)
    assert [r.i for r in al.order_solutions(df, key).collect()] == list(range(n))
    assert [r.i for r in al.order_solutions(df, key.desc()).collect()] == list(range(n))[::-1]
    terms = (F.col("v"), F.col("kind"), F.col("dt"), F.col("tag"))
    assert [r.i for r in al.order_solutions(df, (*terms, "desc")).collect()] == list(range(n))[::-1]
    assert {r.i: r.at for r in positions(df, [key], "at", 1).collect()} == {i: i + 1 for i in range(n)}


def test_positions_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(0,)] * 50 + [(1,)] * 3, "v int").repartition(6)
    got = sorted((r.at, r.v) for r in positions(df, [F.col("v")], "at").collect())
    assert got == [(i, 0 if i < 50 else 1) for i in range(53)]
    assert positions(df.where("v > 5"), [F.col("v")], "at").collect() == []

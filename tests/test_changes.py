"""Batches against a one-by-one model in plain Python; streams against batches."""

import json
import random

import pytest
from conftest import docs_df, lamp
from pyspark.sql import functions as F

from thingfleet.functions import documents as D
from thingfleet.operators import mutate as M
from thingfleet.operators.ordered import carry_last, number_rows
from thingfleet.operators.triples import triplify
from thingfleet.operators.validate import validate
from thingfleet.schema import EVENTS, OPS
from thingfleet.sources import catalog as C
from thingfleet.sources import rules as R
from thingfleet.sources.graphs import dedup
from thingfleet.sources.sinks import binding, choose_format, write_results
from thingfleet.streaming import events as E
from thingfleet.vocab import GRAPH_PREFIX


def ops_df(spark, ops):
    rows = [(i, op, id_, None if body is None else json.dumps(body), None) for i, (op, id_, body) in enumerate(ops)]
    return spark.createDataFrame(rows, OPS).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))


def strip(d):
    return {k: strip(v) if isinstance(v, dict) else v for k, v in d.items() if v is not None}


def model(ops, things):
    state, events, rejects = dict(things), [], []
    for i, (op, id_, body) in enumerate(ops):
        if op == "PUT":
            events.append((i, "thing_updated" if id_ in state else "thing_created", id_))
            state[id_] = body
        elif op == "DELETE":
            events.append((i, "thing_deleted", id_))
            state.pop(id_, None)
        elif id_ in state:
            state[id_] = strip({**state[id_], **body})
            events.append((i, "thing_updated", id_))
        else:
            rejects.append((i, id_, "not_found"))
    return state, events, rejects


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    ids = ["hot"] * 6 + ["a", "b", "c"]
    ops = []
    for _ in range(120):
        id_, op = rng.choice(ids), rng.choice(["PUT", "PATCH", "PATCH", "PATCH", "DELETE"])
        body = {k: rng.choice([1, "x", None, [None, 1], {"n": None, "m": {"z": None, "y": 1}}]) for k in "pqrs" if rng.random() < 0.4}
        ops.append((op, id_, {"id": id_, **body} if op == "PUT" else None if op == "DELETE" else body))
    base = {"a": {"id": "a", "k": 1}, "old": {"id": "old"}}
    things = spark.createDataFrame([(k, json.dumps(v)) for k, v in base.items()], "id string, body string")
    out = M.apply_ops(ops_df(spark, ops), things, block=16)
    state, events, rejects = model(ops, base)
    assert {r.id: json.loads(r.body) for r in out.things.collect()} == state
    assert sorted((r.seq, r.event, r.thing_id) for r in out.events.collect()) == events
    assert sorted((r.seq, r.id, r.code) for r in out.rejects.collect()) == rejects


def test_empty_patch_cleans_the_document(spark):
    ops = ops_df(spark, [("PUT", "a", {"id": "a", "n": None, "o": {"x": None}}), ("PATCH", "a", {})])
    out = M.apply_ops(ops, spark.createDataFrame([], "id string, body string"))
    assert json.loads(out.things.first().body) == {"id": "a", "o": {}}


def test_intake_rejects(spark):
    rows = [
        (0, "PUT", None, "", None), (1, "PUT", None, "[1]", None), (2, "PUT", None, "{bad", None),
        (3, "PUT", "p", '{"title":"x"}', None), (4, "CREATE", None, '{"id":"x"}', None),
        (5, "CREATE", None, '{"title":"x"}', None), (6, "PUT", "other", '{"@id":"mine","id":"no"}', None),
        (7, "PATCH", "gone", '{"a":1}', None), (8, "DELETE", "gone", None, None), (9, "PUT", None, '{"@id":5,"id":"five"}', None),
    ]
    ops = spark.createDataFrame(rows, OPS)
    out = M.apply_ops(ops, spark.createDataFrame([], "id string, body string"))
    assert {r.seq: r.code for r in out.rejects.collect()} == {
        0: "empty_body", 1: "not_an_object", 2: "not_an_object", 3: "id_missing", 4: "id_not_allowed", 7: "not_found",
    }
    events = {r.seq: (r.event, r.thing_id, r.data) for r in out.events.collect()}
    assert events[6] == ("thing_created", "mine", '{"id":"mine"}')
    assert events[8][0] == "thing_deleted" and events[9][1] == "five"
    assert events[5][1].startswith("urn:uuid:") and len(events[5][1]) == 45


def test_minted_ids_avoid_taken_ones(spark):
    ops = ops_df(spark, [("CREATE", None, {"title": "x"}), ("PUT", "k", {"id": "k"})])
    first = M.mint_ids(ops).where("seq = 0").select("id")
    again = M.mint_ids(ops, first)
    assert again.count() == 2
    assert again.where("seq = 0").first().id != first.first().id
    assert M.mint_ids(ops, first.where("false")).where("seq = 0").first().id == first.first().id


def test_a_created_document_says_its_id_and_takes_no_stored_one(spark):
    ops = ops_df(spark, [("CREATE", None, {"title": "x"})])
    minted = M.mint_ids(ops).first().id
    base = spark.createDataFrame([(minted, '{"id":"kept"}')], "id string, body string")
    out = M.apply_ops(ops, base)
    found = {r.id: json.loads(r.body) for r in out.things.collect()}
    assert found.pop(minted) == {"id": "kept"}
    ((new, body),) = found.items()
    assert body == {"id": new, "title": "x"} and out.events.first().thing_id == new


def test_all_errors_are_listed(spark):
    ops = ops_df(spark, [("PUT", None, lamp(id="urn:b", security=..., title=...))])
    found = validate(dedup(triplify(M.documents_to_check(ops))), R.catalogue())
    bad = M.invalid_ops(found, GRAPH_PREFIX).first()
    assert len(bad.errors) == found.count() >= 2


def test_sparse_numbers(spark):
    rows = [(s * 7_000_000_000, "a" if s % 3 else "b", str(s) if s % 4 == 0 else None) for s in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, k string, v string")
    got = {r.seq: (r.n, r.last) for r in carry_last(number_rows(df, "seq", "n"), "k", "seq", F.col("v"), "last").collect()}
    last = {}
    for i, (s, k, v) in enumerate(rows):
        assert got[s] == (i, last.get(k))
        last[k] = v if v is not None else last.get(k)


def test_no_instant_no_stamp(spark):
    df = docs_df(spark, {"id": "a", "title": "x"}).withColumn("m", D.fields(F.col("doc")))
    row = df.select(F.to_json(D.decorate_registration(F.col("m"), F.lit(None).cast("timestamp"))).alias("t")).first()
    assert "registration" not in json.loads(row.t)


def test_invalid_operations_leave_no_trace(spark):
    good = lamp(id="urn:a")
    ops = ops_df(spark, [
        ("PUT", None, good),
        ("PATCH", "urn:a", {"title": None}),
        ("PATCH", "urn:a", {"title": "new", "description": "d"}),
        ("PATCH", "urn:a", {"properties": {"p": {"forms": []}}}),
        ("PATCH", "urn:a", {"description": None}),
        ("PUT", None, lamp(id="urn:b", security=...)),
    ])
    quads = dedup(triplify(M.documents_to_check(ops)))
    bad = M.invalid_ops(validate(quads, R.catalogue()), GRAPH_PREFIX)
    out = M.apply_ops(ops, spark.createDataFrame([], "id string, body string"), bad, stamp=True)
    rejected = {r.seq: (r.code, len(r.errors)) for r in out.rejects.collect()}
    assert {k: v[0] for k, v in rejected.items()} == {1: "validation", 3: "validation", 5: "validation"}
    assert all(n >= 1 for _, n in rejected.values())
    (row,) = out.things.collect()
    doc = json.loads(row.body)
    assert doc["title"] == "new" and "description" not in doc and "status" in doc["properties"]
    assert doc["@type"] == "Thing" or doc["@type"] == ["Thing"]
    assert doc["registration"] == {"created": "2023-11-14T22:13:20.000000Z", "modified": "2023-11-14T22:13:24.000000Z"}
    assert [r.event for r in out.events.orderBy("seq").collect()] == ["thing_created", "thing_updated", "thing_updated"]


def test_ordered_helpers_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice("aab"), rng.choice([None, None, "x", "y"])) for s in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "seq bigint, k string, v string")
    last, wanted = {}, {}
    for s, k, v in sorted(rows):
        wanted[s] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    for block in (1, 7, 1000):
        got = {r.seq: r.p for r in carry_last(df, "k", "seq", F.col("v"), "p", block).collect()}
        assert got == wanted
        numbered = {r.seq: r.n for r in number_rows(df, "seq", "n", 10, block).collect()}
        assert numbered == {s: i + 10 for i, (s, _, _) in enumerate(sorted(rows))}


def test_snapshot_diff_and_upsert(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, body string")
    a = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "id string, body string")
    assert {(r.thing_id, r.event) for r in M.snapshot_diff(b, a).collect()} == {
        ("b", "thing_updated"), ("c", "thing_deleted"), ("d", "thing_created"),
    }
    out = M.upsert_documents(b, a.where("id <> 'a'"), b.where("id = 'c'"))
    assert {(r.id, r.body) for r in out.collect()} == {("a", "1"), ("b", "9"), ("d", "4")}


def test_listing(spark):
    things = spark.range(45).selectExpr("concat('t', lpad(id, 3, '0')) id", "cast(id % 4 as int) w")
    page = C.list_things(things, 10, 40)
    assert [r.id for r in page.collect()] == ["t040", "t041", "t042", "t043", "t044"]
    assert C.list_things(things).count() == 20
    assert C.list_things(things, 2, 0, "w", "desc").first().id == "t003"
    meta = [C.page_meta(things, 20, o).first().next_offset for o in (0, 20, 25, 40)]
    assert meta == [20, 40, None, None]
    assert C.exists(things, "t001") and not C.exists(things, "x")
    ids = spark.createDataFrame([("t001",), ("x",)], "id string")
    assert {(r.id, r.found) for r in C.exists_flags(ids, things).collect()} == {("t001", True), ("x", False)}
    assert C.lookup(things, ids).count() == 1
    with pytest.raises(ValueError):
        C.list_things(things, -1)


LOG = [(0, "thing_created", "a"), (1, "thing_updated", "a"), (2, "thing_created", "b"), (3, "thing_deleted", "a")]


def log_df(spark):
    return spark.createDataFrame([(s, e, i, json.dumps({"id": i}), None) for s, e, i in LOG], EVENTS)


def test_replay(spark):
    log = log_df(spark)
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(E.past_events(log, "0")) == [1, 2, 3]
    assert seqs(E.past_events(log, "-1", ("thing_created",))) == [0, 2]
    assert seqs(E.past_events(log, None)) == seqs(E.past_events(log, "x")) == seqs(E.past_events(log, "3")) == []
    with pytest.raises(ValueError):
        E.past_events(log, "0", ("other",))


def test_differences_are_refused_except_for_deletions(spark):
    log = log_df(spark)
    for types in (None, ("thing_created",), ("thing_updated",)):
        with pytest.raises(NotImplementedError):
            E.subscribe(log, types, diff=True)
    assert E.subscribe(log, ("thing_deleted",), diff=True).count() == 1


def test_frames(spark):
    rows = spark.createDataFrame([(7, "thing_created", "a", '{\n"id": "a"\r\n}', None)], EVENTS)
    assert E.frames(rows).first().value == 'event: thing_created\nid: 7\ndata: {\ndata: "id": "a"\ndata: }\n\n'


def test_subscription_stream_equals_batch(spark, tmp_path):
    log = log_df(spark)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = E.subscribe(E.read_log(spark, str(tmp_path / "log"), 1), ("thing_created", "thing_deleted"))
    E.write_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.seq, r.event) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "thing_created"), (2, "thing_created"), (3, "thing_deleted")}
    follow = E.follow(spark, str(tmp_path / "log"), "1")
    E.write_frames(follow, str(tmp_path / "frames"), str(tmp_path / "cp2")).awaitTermination()
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "frames")).collect())
    assert "id: 2" in text and "id: 3" in text and "id: 1" not in text


def test_classifier_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    ops = [(rng.choice(["PUT", "PATCH", "DELETE"]), rng.choice("aaab"), {"x": 1}) for _ in range(90)]
    df = ops_df(spark, ops)
    for i in range(3):
        df.where(f"seq >= {30 * i} and seq < {30 * i + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = E.Classifier(str(tmp_path / "home"), block=8)
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run.start(stream).awaitTermination()
    key = lambda df_: sorted((r.seq, r.event, r.thing_id) for r in df_.collect())
    assert key(run.events(spark)) == key(E.derive(df, block=8))
    numbered = E.number_events(run.events(spark), 0, 8)
    assert sorted(r.seq for r in numbered.collect()) == list(range(numbered.count()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "x string, n int")
    for fmt in ("json", "csv", "tsv", "xml"):
        write_results(df, str(tmp_path / fmt), fmt)
    assert {r.value for r in spark.read.text(str(tmp_path / "json")).collect()} == {'{"x":"a","n":1}', '{"x":"b"}'}
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).count() == 2
    assert spark.read.format("xml").option("rowTag", "result").load(str(tmp_path / "xml")).count() == 2
    with pytest.raises(ValueError):
        write_results(df, str(tmp_path / "no"), "pdf")
    got = [r.j for r in df.select(binding({"x": "uri", "n": "literal"}).alias("j")).collect()]
    assert json.loads(got[1]) == {"x": {"type": "uri", "value": "b"}}
    assert choose_format("describe", "json") == "nt" and choose_format("select", None) == "json"
    with pytest.raises(ValueError):
        choose_format("select", "pdf")


def test_operations_are_taken_in_once_for_events_and_rejects(spark):
    ops = [("PUT", None, {"id": "a"}), ("PATCH", "a", {"x": 1}), ("PATCH", "b", {"x": 1}), ("PUT", None, "no")]
    out = M.apply_ops(ops_df(spark, ops), spark.createDataFrame([], "id string, body string"))
    # both come from one written table without documents
    for df in (out.events, out.rejects):
        assert any("batch-ops" in f for f in df.inputFiles())
    assert sorted((r.seq, r.event) for r in out.events.collect()) == [(0, "thing_created"), (1, "thing_updated")]
    assert sorted((r.seq, r.code) for r in out.rejects.collect()) == [(2, "not_found"), (3, "not_an_object")]

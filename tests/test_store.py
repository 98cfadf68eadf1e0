"""Versions that hold changes only, and several writers at once."""

import random

import pytest
from conftest import lamp

from thingfleet.operators.batch import commit_batch
from thingfleet.sources import catalog
from thingfleet.sources import rules as R
from thingfleet.sources.catalog import Conflict, Store
from thingfleet.schema import QUADS
from thingfleet.vocab import GRAPH_PREFIX


def things(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "id string, body string")


def quads(spark, docs):
    rows = [("g:" + i, i, p, b, "literal", None, None, None, None) for i, b in sorted(docs.items()) for p in ("p", "q")]
    return spark.createDataFrame(rows, QUADS)


def ids(spark, names, column="id", prefix=""):
    return spark.createDataFrame([(prefix + n,) for n in names], f"{column} string")


def state(store, version=None):
    docs = {r.id: r.body for r in store.things(version).collect()}
    found = sorted((r.g, r.p, r.o) for r in store.quads(version).collect())
    assert found == sorted(("g:" + i, p, b) for i, b in docs.items() for p in ("p", "q"))
    return docs


def change(store, spark, docs, gone=(), read=None):
    return store.commit_changes(
        things(spark, docs), quads(spark, docs), ids(spark, gone), ids(spark, gone, "g", "g:"), read
    )


def test_versions_of_changes_equal_whole_ones(spark, tmp_path):
    rnd, store = random.Random(3), Store(spark, str(tmp_path / "s"))
    names = [f"t{i}" for i in range(12)]
    model, seen = {}, {}
    for step in range(1, 7):
        new = {n: f"{n}-{step}" for n in rnd.sample(names, 4)}
        gone = set(rnd.sample(names, 3)) - set(new)
        model = {n: b for n, b in model.items() if n not in gone} | new
        assert change(store, spark, new, gone) == step
        seen[step] = dict(model)
        if step == 4:
            assert store.compact() == 5
            seen[5] = dict(model)
            break
    assert change(store, spark, {"t0": "again"}, ["t1"]) == 6
    seen[6] = {n: b for n, b in model.items() if n != "t1"} | {"t0": "again"}
    assert {v: state(store, v) for v in seen} == seen and state(store) == seen[6]


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = {f"t{i:03d}": "x" for i in range(200)}
    store.commit(things(spark, docs), quads(spark, docs))
    change(store, spark, {"t005": "y"}, ["t006"])
    folder = f"{tmp_path}/s/{store._log.entry(2).folder}"
    assert spark.read.parquet(f"{folder}/things").count() == 1 and spark.read.parquet(f"{folder}/quads").count() == 2
    assert state(store) == {n: b for n, b in docs.items() if n != "t006"} | {"t005": "y"}


def test_two_writers(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    docs = {"a": "1", "b": "1", "c": "1"}
    store.commit(things(spark, docs), quads(spark, docs))
    assert change(store, spark, {"a": "2"}, read=1) == 2
    # made from version 1 as well, of other documents: it follows
    assert change(other, spark, {"b": "2"}, ["c"], read=1) == 3
    assert state(store) == {"a": "2", "b": "2"} and state(store, 2) == {"a": "2", "b": "1", "c": "1"}
    # the same documents, deleted ones included
    for mine in ({"a": "3"}, {"c": "3"}):
        with pytest.raises(Conflict):
            change(other, spark, mine, read=1)
    with pytest.raises(Conflict):
        store.commit(things(spark, docs), quads(spark, docs), read=2)
    assert store.current() == 3 and not store._log.claim(3, True, "x")
    # a whole version in between touches everything
    assert store.compact() == 4
    with pytest.raises(Conflict):
        change(other, spark, {"z": "1"}, read=3)
    assert not [f for f in (tmp_path / "s" / "log").iterdir() if f.name.startswith(".draft")]


def test_a_commit_of_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.things()
    assert change(store, spark, {}) == 1 and state(store) == {}


def test_a_batch_is_tried_again_when_another_came_first(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(
        [(i, op, id_, None if body is None else __import__("json").dumps(body), 1_700_000_000 + i) for i, (op, id_, body) in enumerate(r)],
        "seq bigint, op string, id string, body string, t bigint",
    ).selectExpr("seq", "op", "id", "body", "timestamp_seconds(t) AS ts")
    first = commit_batch(store, rows(("PUT", "urn:a", lamp(id="urn:a")), ("PUT", "urn:b", lamp(id="urn:b"))), R.catalogue())
    assert first.version == 1 and first.events.count() == 2
    real, raced = Store.commit_changes, []

    def late(self, *args):
        if not raced:
            raced.append(real(store, store.things().where("id = 'urn:a'"), store.quads().where("false")))
        return real(self, *args)

    monkeypatch.setattr(catalog.Store, "commit_changes", late)
    done = commit_batch(store, rows(("PATCH", "urn:a", {"title": "new"}), ("DELETE", "urn:b", None)), R.catalogue())
    assert raced == [2] and done.version == 3
    (row,) = store.things().collect()
    assert row.id == "urn:a" and '"title":"new"' in row.body
    assert {r.g for r in store.quads().select("g").distinct().collect()} == {GRAPH_PREFIX + "urn:a"}
    assert commit_batch(store, rows(("PATCH", "urn:gone", {})), R.catalogue()).version == 3

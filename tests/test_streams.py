"""Keyed state and running numbers over streams of several batches."""

import random

import pytest

from thingfleet.schema import EVENTS, OPS
from thingfleet.streaming import events as E


def model(ops, known):
    """Events of operations, one by one."""
    there, out = set(known), []
    for seq, op, id_ in ops:
        if op == "DELETE":
            out.append((seq, "thing_deleted", id_))
            there.discard(id_)
        elif op in ("PUT", "CREATE"):
            out.append((seq, "thing_updated" if op == "PUT" and id_ in there else "thing_created", id_))
            there.add(id_)
        elif id_ in there:
            out.append((seq, "thing_updated", id_))
    return out


def log(rng, n):
    # a third of all operations are about one document
    ids = [f"urn:{k}" for k in range(12)] + ["urn:hot"] * 6
    return [(k, rng.choice(["PUT", "PATCH", "DELETE", "PATCH", "CREATE"]), rng.choice(ids)) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_state_over_batches_and_restarts(spark, tmp_path, seed):
    rng = random.Random(seed)
    ops = log(rng, 90)
    known = ["urn:0", "urn:3", "urn:never"]
    things = spark.createDataFrame([(i,) for i in [*known, "urn:3", None]], "id string")
    for k in range(3):
        rows = ops[30 * k : 30 * k + 30]
        rng.shuffle(rows)
        table = spark.createDataFrame([(*r, None, None) for r in rows], "seq bigint, op string, id string, body string, ts timestamp")
        table.unionByName(spark.createDataFrame([(k - 99, "PUT", None, None, None)], table.schema)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
        E.write_events(E.derive_keyed(stream, things), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = [(r.seq, r.event, r.thing_id) for r in spark.read.schema(EVENTS).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == model(ops, known)


def test_keyed_state_without_stored_things(spark, tmp_path):
    ops = log(random.Random(5), 40)
    table = spark.createDataFrame([(s, o, i, None, None) for s, o, i in ops], OPS.replace("\n", " "))
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    E.write_events(E.derive_keyed(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = [(r.seq, r.event, r.thing_id) for r in spark.read.schema(EVENTS).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == model(ops, [])


def events(spark, seqs):
    return spark.createDataFrame([(s, "thing_created", f"urn:{s}", "{}", None) for s in seqs], EVENTS).repartition(3)


def test_numbers_survive_repeated_and_empty_batches(spark, tmp_path):
    ledger = E.Ledger(f"{tmp_path}/l", start=100, block=4)
    batches = [events(spark, [5, 1, 900]), events(spark, []), events(spark, range(1000, 1040, 3)), events(spark, [10**15, 2000])]
    for k, b in enumerate(batches):
        ledger(b, k)
    first = {(r.thing_id, r.seq) for r in ledger.events(spark).collect()}
    assert sorted(s for _, s in first) == list(range(100, 100 + 19))
    assert [i for i, _ in sorted(first, key=lambda x: x[1])][:3] == ["urn:1", "urn:5", "urn:900"]
    for k in (2, 0, 3, 1):  # repeated after a failure, in any order
        ledger(batches[k], k)
    again = ledger.events(spark).collect()
    assert {(r.thing_id, r.seq) for r in again} == first and len(again) == 19
    ledger(events(spark, [3000]), 7)  # numbers of batches may have gaps
    assert ledger.events(spark).where("thing_id = 'urn:3000'").first().seq == 119


def test_numbers_of_a_stream(spark, tmp_path):
    ledger = E.Ledger(f"{tmp_path}/l")
    for seqs in ([3, 2, 1], [], [7, 9], [20]):
        if seqs:
            events(spark, seqs).write.mode("append").parquet(f"{tmp_path}/in")
        ledger.start(E.read_log(spark, f"{tmp_path}/in")).awaitTermination()
    rows = ledger.events(spark).orderBy("seq").collect()
    assert [(r.seq, r.thing_id) for r in rows] == list(enumerate(f"urn:{s}" for s in (1, 2, 3, 7, 9, 20)))


def test_differences_are_refused_but_for_deletions():
    E.check_diff(("thing_deleted",), True)
    E.check_diff(None, False)
    for types in (None, ("thing_created",), ("thing_created", "thing_deleted")):
        with pytest.raises(NotImplementedError):
            E.check_diff(types, True)

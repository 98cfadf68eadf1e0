"""Interactions of filters against applying every order to every document."""

import collections
import itertools
import random

import pytest
from plain import WORD
from pyspark.sql import functions as F

from thingfleet.llm import filter_audit

rng = random.Random(8)


def texts():
    words = [f"w{k}" for k in range(400)]
    yield from (None, "", " \n", "a b c", "ÀÉ é", "x" * 3000)
    for _ in range(40):
        n = rng.choice([3, 150, 199, 200, 260])
        pool = words[: rng.choice([60, 99, 100, 130, 400])]
        text = rng.choice([" ", "\t", "\x0b\n"]).join(rng.choice(pool) for _ in range(n))
        yield rng.choice([text, text.title(), text + " #", text + " Plain. B", text])


DOCS = [(d if d % 17 else None, t, rng.choice(["en", "de", None, "", "en"])) for d, t in enumerate([*texts(), *texts(), *["twice " * 250] * 9])]
DOCS += DOCS[:12]
LABELS = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in DOCS if rng.random() < 0.6] + [(None, 1, 1), (10**6, 1, 1)]


def applied(docs, labels):
    ids, fails = collections.defaultdict(list), []
    for d, t, _ in docs:
        if d is not None:
            ids[t or ""].append(d)
    for d, t, part in docs:
        t, w = t or "", WORD.findall(t or "")
        own = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and d > min(ids[t]),
        }
        good, toxic = (d is not None and any(x[0] == d and x[k] == 1 for x in labels) for k in (1, 2))
        fails.append((part or "", {f for f in own if own[f]}, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        rows = [r[1:] for r in fails if r[0] == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                all_f = sum(f in r[0] for r in rows)
                out[part, order, step] = [len(left), len(gone), all_f - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_every_order(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").repartition(3)
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("part", "mask", "n", "same", "own", "good", "label_id", "step")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    rows = filter_audit.audit(docs, labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in rows}
    assert len(rows) == len(got)
    assert got == applied(DOCS, LABELS)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    assert filter_audit.audit(one, labels).where("step = 5 and kept = 0").count() == 120


@pytest.mark.parametrize("letters", ["A", "AB", "ABCD"])
def test_intervals_cover_each_mask_and_order_once(letters):
    orders = list(map("".join, itertools.permutations(letters)))
    assert [filter_audit.lehmer_rank(o, letters) for o in orders] == list(range(len(orders)))
    covered = collections.Counter()
    for mask, step, start, stop in filter_audit.removal_intervals(letters):
        for rank in range(start, stop):
            covered[mask, rank] += 1
            first = next(i for i, f in enumerate(orders[rank], 1) if mask >> letters.index(f) & 1)
            assert first == step
    assert set(covered.values()) == {1} and len(covered) == (2 ** len(letters) - 1) * len(orders)

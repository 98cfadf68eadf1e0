"""Circulant MinHash groups against all pairs."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from thingfleet.llm import circulant_minhash as cm

rng = random.Random(6)


def prose(n, pool=2000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def texts():
    yield from (None, "", " \t", "one", "ONE", "one two three", "one two three four", "a" * 4000)
    base = prose(150)
    for _ in range(70):  # a large group: links between some of them only
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(len(own))] = rng.choice(["x", "y", f"w{rng.randrange(40)}"])
        yield " ".join(own[rng.choice([0, 0, 3]) :])
    for _ in range(25):
        own = prose(rng.choice([8, 40, 90]), 60)
        yield " ".join(own)
        yield " ".join([*own, "tail"]).upper()
        yield " ".join(own)
    yield " ".join(prose(15_000, 9000))


DOCS = list(enumerate(texts(), 3))


def as_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in ("rep", "band", "bands", "n", "g", "key", "x", "y", "node", "set_key")})


def check(df, docs):
    want = plain.components(docs, 80)
    rows = df.collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == {(d, *v) for d, v in want.items()}
    return rows


def test_groups(spark):
    docs = as_table(spark, DOCS)
    check(cm.grouped(docs), DOCS)
    # every row twice, and texts without an id
    twice = docs.unionByName(docs).unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    rows = check(cm.grouped(twice), DOCS)
    assert len(rows) == 2 * len(DOCS) + 4
    assert cm.grouped(docs.where("doc_id < 0")).count() == 0


def test_texts_of_one_document(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l"), (4, "m n o p")]
    got = {(r["doc_id"], r["component_id"]) for r in cm.grouped(as_table(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_coordinates_agree_as_often_as_sets_do():
    gen = np.random.default_rng(5)
    for common, own in ((900, 50), (500, 250), (100, 450)):
        all_ = gen.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
        a, b = np.sort(all_[: common + own]), np.sort(np.concatenate([all_[:common], all_[common + own :]]))
        s = cm.signatures([a, a[:0], b], 1024)
        assert (s[1] == 0xFFFFFFFF).all()
        assert (s[0] == s[2]).mean() == pytest.approx(common / (common + 2 * own), abs=0.06)


def test_large_sets_in_pieces(monkeypatch):
    gen = np.random.default_rng(2)
    sets = [gen.integers(0, 2**63, n, dtype=np.uint64) for n in (3, 0, 700, 1, 0, 90)]
    whole = cm.signatures(sets, 8)
    monkeypatch.setattr(cm, "_AT_ONCE", 64)
    assert (cm.signatures(sets, 8) == whole).all()


def test_permutations_of_all_numbers():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65_537)
    for first, second in ((0x7FEB352D, 0x846CA68B), (0x21F0AAAD, 0x735A2D97)):
        assert len(np.unique(cm._permuted(x.copy(), first, second))) == len(x)


def test_sketches_differ_in_no_more_than_their_sets():
    gen = np.random.default_rng(3)
    pool = gen.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.sort(pool[gen.random(3000) < p]) for p in (0, 0.01, 0.3, 0.31, 0.9, 1)]
    bits = np.unpackbits(cm.parities(sets).view(np.uint8), axis=1)
    for a, x in zip(sets, bits):
        for b, y in zip(sets, bits):
            assert (x != y).sum() <= len(np.setxor1d(a, b))

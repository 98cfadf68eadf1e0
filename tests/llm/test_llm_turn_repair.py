"""Repair of conversations against a plain table over all edits."""

import itertools
import random

import duckdb
import plain
import pytest
from pyspark.sql import functions as F

from thingfleet.llm import queries, turn_repair

SF = "/root/testdata/sf0.001"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(df, rows):
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}
    want = {c: plain.repaired_turns(t) for c, t in plain.damage(rows).items()}
    assert got == want


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    check(queries.QUERIES["op12_turn_repair"](spark, SF), rows)


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown", "Assistant"]
    texts = ["Yes.", "no", " ", None, "", "Why?\n", "a long one without an end", "Good! ", "\t", "é。"]
    rows = []
    for c in [None, *range(conversations)]:
        for k in range(rng.randint(1, longest)):
            turn = rng.choice([k, k, k, k + 3, None, -2])
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(99)}{rng.choice(['.', '', '!'])}"
            rows.append((c, turn, rng.choice(roles) if rng.random() < 0.5 else ["user", "assistant"][k % 2], text))
    return rows


@pytest.mark.parametrize("block", [1, 3, 256])
def test_any_rows_and_blocks(spark, block):
    rows = random_rows(block, 60, 14)
    rows += rows[:40]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({c: F.lit(f"own {c}") for c in ("seg", "fault", "times", "of", "summary", "said", "case")})
    check(turn_repair.audit_table(df, block), rows)


def test_long_conversation(spark):
    rng = random.Random(9)
    rows = [(5, k, rng.choice(["user", "assistant"]), f"t{k}" + rng.choice(".?x")) for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    check(turn_repair.audit_table(df), rows)
    check(turn_repair.audit_table(df, 64), rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.audit_table(df).collect() == []
    repaired, report = turn_repair.repair(df)
    assert repaired.collect() == report.collect() == []


def test_search_is_the_least_of_all_edits():
    """Every edit sequence of short conversations, tried out."""
    rng = random.Random(3)

    def tried(heads, faults):
        best = None
        for size in range(7):
            for letters in itertools.product("DIKR", repeat=size):
                for cost in run(letters, heads, faults):
                    best = min(best, (cost, "".join(letters))) if best else (cost, "".join(letters))
        return best

    def run(letters, heads, faults):
        cost, i, said = 0, 0, ""
        for x in letters:
            if x != "I":
                if i == len(heads):
                    return
                if x != "D" and faults[i] in (turn_repair.BLANK, turn_repair.DUPLICATE):
                    return
                cost += 3 * (x != "D" and faults[i] == turn_repair.CUT_OFF)
                if x == "K":
                    said += heads[i]
                i += 1
            cost += {"D": 4, "I": 3, "K": 0, "R": 3}[x]
            if x in "IR":
                said += "a" if said[-1:] == "u" else "u"
        rest = said.removeprefix("s")
        if i == len(heads) and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2) and (rest or not said):
            yield cost

    for _ in range(40):
        n = rng.randint(1, 4)
        heads, faults = [rng.choice("suax") for _ in range(n)], [rng.choice([0, 0, 0, 1, 3]) for _ in range(n)]
        chain = turn_repair.Chain(0)
        now = turn_repair.Open(0, 0, (0,))
        for h, f in zip(heads, faults):
            now.add(0, h, f, 1)
        s = now.summary()
        chain.add(s)
        (step,) = chain.path()
        letters = (s["audits"][step["end"]] + turn_repair.CLOSING[step["end"]]).translate(turn_repair.PUBLIC)
        assert (step["total"]["cost"], letters) == tried(heads, faults)

"""Repair of conversations whose turns no longer alternate: the cheapest edits, by iterative-deepening A*.

A repaired conversation has role initials ``(s?(ua)+)?``. Four states tell how far one is: ``0`` nothing yet, ``1``
after the system turn, ``2`` after a user's, ``3`` after an assistant's; ``0`` and ``3`` may end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

SPACE = "".join(f"\\x{ord(c):02X}" for c in SPACES)
#: What a kept row needs, the role given by rerole or insert, and the state after it.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Which states can still be met on the way to a state.
FROM = {0: (0,), 1: (0, 1), 2: (0, 1, 2, 3), 3: (0, 1, 2, 3)}
#: Turns to be inserted after the last row.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}
CHANGE, DELETE, TRUNCATED = 3, 4, 3
#: Letters inside this module: ``S`` keeps a system turn, ``d`` deletes a further copy of the row before it.
PUBLIC = str.maketrans("Sd", "KD")
NEVER = 1 << 40
LEAST, MOST = -(1 << 63), (1 << 63) - 1

SOUND, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3


# One stretch of rows ---------------------------------------------------------------------------


class Stretch:
    """Neighbouring rows of one conversation: their role initials and faults, and the cheapest edits between any
    two states at its ends. Turns are inserted before a row of it, never after the last one."""

    def __init__(self, initials: str, faults: list[int]):
        self.initials, self.faults = initials, faults
        self.least = [0]  # no completion from row i costs less
        for f in reversed(faults):
            self.least.append(self.least[-1] + (DELETE if f in (BLANK, DUPLICATE) else TRUNCATED if f == CUT_OFF else 0))
        self.least.reverse()

    def moves(self, i: int, q: int, goal: int) -> list[tuple[int, int, int, str]]:
        """Edits at row ``i`` in state ``q``, in ASCII order: cost, next row, next state, letter."""
        if i == len(self.faults):
            return []
        fault, after = self.faults[i], GIVEN[q][1]
        out = [(DELETE, i + 1, q, "D"), (CHANGE, i, after, "I")]
        if fault in (SOUND, CUT_OFF):
            more = TRUNCATED if fault == CUT_OFF else 0
            if (kept := KEPT.get((q, self.initials[i]))) is not None:
                out.append((more, i + 1, kept, "S" if kept == 1 else "K"))
            out.append((CHANGE + more, i + 1, after, "R"))
        return [m for m in out if m[2] in FROM[goal]]

    def search(self, start: int, goal: int, failed: dict[tuple[int, int], int]) -> tuple[int, str] | None:
        """Cost and letters of the ASCII-least cheapest edits that lead from ``start`` to ``goal``; None without any.

        Depth-first under a bound that rises to the least cost found beyond it. ``failed`` keeps, for a row and a
        state, the largest budget that led nowhere; it holds for every start and bound with this goal.
        """
        if start not in FROM[goal]:
            return None
        n, bound = len(self.faults), self.least[0]
        while True:
            beyond = NEVER
            # a frame: row, state, budget left, the least it lacks, moves left
            stack = [[0, start, bound, NEVER, iter(self.moves(0, start, goal))]]
            letters: list[str] = []
            if n == 0:
                return (0, "") if start == goal else None
            while stack:
                frame = stack[-1]
                i, q, left, _, todo = frame
                for cost, j, to, letter in todo:
                    rest = left - cost
                    lacking = self.least[j] - rest
                    if lacking > 0:
                        frame[3] = min(frame[3], lacking)
                        continue
                    if j == n:
                        if to == goal:
                            return bound - rest, "".join([*letters, letter])
                        continue
                    known = failed.get((j, to))
                    if known is not None and known[0] >= rest:
                        frame[3] = min(frame[3], known[0] + known[1] - rest)
                        continue
                    letters.append(letter)
                    stack.append([j, to, rest, NEVER, iter(self.moves(j, to, goal))])
                    break
                else:
                    # no way out with this budget, nor with less than what it lacks on top
                    failed[i, q] = (left, frame[3])
                    stack.pop()
                    if stack:
                        letters.pop()
                        stack[-1][3] = min(stack[-1][3], frame[3])
                    else:
                        beyond = frame[3]
            if beyond >= NEVER:
                return None
            bound += beyond

    def answers(self, starts: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
        out = {}
        for goal in range(4):
            failed: dict[tuple[int, int], int] = {}
            for start in starts:
                if (got := self.search(start, goal, failed)) is not None:
                    out[start, goal] = got
        return out


# Rows of a table -------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the damage that the checksum of ``conv_id:turn`` gives each row.

    Nulls count as one space, in the checksum as well as in role and text; ids and turns stay null. By the checksum
    modulo 20: 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    has it twice, 4 makes it a user's.
    """
    one = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    read = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one(F.col("role")).alias("role"), one(F.col("text")).alias("text")
    )
    case = F.crc32(F.concat(one(F.col("conv_id")), F.lit(":"), one(F.col("turn"))).cast("binary")) % 20
    return (
        read.withColumn("case", case)
        .where("case <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("case") == 3, 2).otherwise(1).alias("times"),
        )
    )


def faulty(turns: DataFrame, times: str | None = None) -> DataFrame:
    """Equal rows of a conversation as one with ``times``, and the first ``fault`` of the first of them. A column
    ``times`` of ``turns`` says how often each of its rows stands there.

    Copies are counted before they are shuffled, and the first place of a role and text is an aggregate, so
    neither repeated rows nor a text said everywhere meet in one task.
    """
    counted = F.lit(1) if times is None else F.col(times)
    space = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", space("role"), space("text"), counted.alias("times"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", said)
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("said").alias("what"), "first")
    here = rows.join(first, rows.conv_id.eqNullSafe(F.col("of")) & (F.col("said") == F.col("what")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK)
        .when(again, DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), CUT_OFF)
        .otherwise(SOUND)
    )
    return here.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"))


LAID = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), ("fault", pa.int32())]
    + [("seg", pa.int64()), ("pos", pa.int64())]
)
SUMMARY = pa.struct(
    [("conv_id", pa.int64()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))]
    + [(c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
    + [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string())]
)
LAID_SQL = "conv_id long, turn long, role string, text string, times long, fault int, seg long, pos long, summary struct<conv_id:long,seg:long,costs:array<long>,ranks:array<int>,audits:array<string>,low:long,high:long,turns:long,blank:long,duplicate:long,truncated:long,illegal:long,first_turn:long,last_turn:long,first:string,last:string>"
#: Adjacent role initials that a conversation may have.
LEGAL = ("su", "ua", "au")


class Open:
    """The stretch that a task is reading."""

    def __init__(self, conv, seg: int, starts: tuple[int, ...]):
        self.conv, self.seg, self.starts = conv, seg, starts
        self.initials, self.faults, self.turns = [], [], []
        self.copies: list[tuple[int, int]] = []

    def add(self, turn, role: str, fault: int, times: int) -> int:
        at = len(self.faults)
        initial = role[:1]
        self.initials.append(initial)
        self.faults.append(fault)
        if times > 1:
            self.copies.append((at, times - 1))
        self.turns.append(turn)
        return at

    def summary(self) -> dict:
        # further copies of a row only can be deleted; their letters follow the row's own
        found = Stretch(["" if x not in ("s", "u", "a") else x for x in self.initials], self.faults).answers(self.starts)
        extra = DELETE * sum(n for _, n in self.copies)
        costs, ranks, audits = [], [], []
        found = {key: (cost, _with_copies(audit, self.copies)) for key, (cost, audit) in found.items()}
        order = {a: k for k, a in enumerate(sorted({a for _, a in found.values()}, key=lambda a: a.translate(PUBLIC)))}
        for key in ((p, q) for p in range(4) for q in range(4)):
            cost, audit = found.get(key, (NEVER, None))
            costs.append(cost + extra if audit is not None else NEVER)
            ranks.append(order[audit] if audit is not None else 0)
            audits.append(audit)
        blank = lambda f: f == BLANK
        more = sum(n for _, n in self.copies)
        more_blank = sum(n for at, n in self.copies if blank(self.faults[at]))
        pairs = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:]))
        known = [t for t in self.turns if t is not None]
        return {
            "conv_id": self.conv,
            "seg": self.seg,
            "costs": costs,
            "ranks": ranks,
            "audits": audits,
            "low": min(known, default=None),
            "high": max(known, default=None),
            "turns": len(set(known)),
            "blank": self.faults.count(BLANK) + more_blank,
            "duplicate": self.faults.count(DUPLICATE) + more - more_blank,
            "truncated": self.faults.count(CUT_OFF),
            "illegal": pairs + more,  # a copy has its row's own initial
            "first_turn": self.turns[0],
            "last_turn": self.turns[-1],
            "first": self.initials[0],
            "last": self.initials[-1],
        }


def _with_copies(audit: str, copies: list[tuple[int, int]]) -> str:
    """The letters with those of further copies, which are deleted where they stand."""
    if not copies:
        return audit
    ends = [k + 1 for k, letter in enumerate(audit) if letter != "I"]
    out, at = [], 0
    for row, n in copies:
        out += [audit[at : ends[row]], "d" * n]
        at = ends[row]
    return "".join([*out, audit[at:]])


def laid_out(rows: DataFrame, block: int = 256) -> DataFrame:
    """The rows of :func:`faulty` in stretches of at most ``block``, and a row with the summary of each stretch.

    Conversations lie by id, turn (nulls first), role and text over ranges that the sort cuts by rows, so that one
    of any length spreads over many tasks. A task holds the initials and faults of one stretch, never its texts.
    """
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, now = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            closed, segs, at = [], [], []
            for conv, turn, role, times, fault in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "times", "fault"))):
                if now is None or conv != now.conv or len(now.faults) >= block:
                    # what comes before in the order ends here; only the first of a task may go on with another's
                    first = now is not None and conv != now.conv
                    if now is not None:
                        closed.append(now.summary())
                    now = Open(conv, part + made, (0,) if first else (0, 1, 2, 3))
                    made += 1
                segs.append(now.seg)
                at.append(now.add(turn, role, fault, times))
            columns = [b.column(b.schema.get_field_index(f.name)).cast(f.type) for f in list(LAID)[:6]]
            empty = pa.nulls(b.num_rows, SUMMARY)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(segs, pa.int64()), pa.array(at, pa.int64()), empty], names=[*LAID.names, "summary"])
            if closed:
                yield _summaries(closed)
        if now is not None:
            yield _summaries([now.summary()])

    return dealt.select(*LAID.names[:6]).mapInArrow(run, LAID_SQL)


def _summaries(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(found), f.type) for f in LAID), pa.array(found, SUMMARY)], names=[*LAID.names, "summary"])


class Chain:
    """The stretches of one conversation, from the last to the first: what to do in each of them."""

    def __init__(self, conv):
        self.conv, self.rows = conv, []
        # what the rest costs from each state: at the end only closing turns
        self.rest = [CHANGE * len(CLOSING[q]) for q in range(4)]
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.after = None

    def add(self, s: dict) -> None:
        """Take the stretch before those taken so far."""
        to, rest = [], []
        for p in range(4):
            # letters of equal total cost differ before one ends, so the least of the stretch is the least of all
            best = min((s["costs"][4 * p + q] + self.rest[q], s["ranks"][4 * p + q], q) for q in range(4))
            to.append(best[2])
            rest.append(min(best[0], NEVER))
        self.rest = rest
        self.rows.append((s["seg"], to))
        for c in self.sums:
            self.sums[c] += s[c]
        if self.after is not None:
            self.sums["illegal"] += s["last"] + self.after["first"] not in LEGAL
            # a turn that goes on in the next stretch is one turn
            self.sums["turns"] -= s["last_turn"] is not None and s["last_turn"] == self.after["first_turn"]
        self.after = s
        self.low = s["low"] if self.low is None else self.low if s["low"] is None else min(self.low, s["low"])
        self.high = s["high"] if self.high is None else self.high if s["high"] is None else max(self.high, s["high"])

    def path(self) -> Iterator[dict]:
        """From the first stretch on: the states it starts and ends in; totals beside the last one."""
        q = 0
        for k, (seg, to) in enumerate(reversed(self.rows)):
            last = k == len(self.rows) - 1
            row = {"conv_id": self.conv, "seg": seg, "start": q, "end": to[q], "last": last, "total": None}
            q = to[q]
            if last:
                gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.sums["turns"], MOST)
                row["total"] = {"gaps": gaps, "cost": self.rest[0], **{c: self.sums[c] for c in ("blank", "duplicate", "truncated", "illegal")}}
            yield row


TOTAL = pa.struct([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
PATH = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_()), ("total", TOTAL)])
PATH_SQL = "conv_id long, seg long, start int, end int, last boolean, total struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long>"


def paths(summaries: DataFrame) -> DataFrame:
    """``conv_id, seg, start, end, last, total`` of each stretch: the states in which the cheapest and then
    ASCII-least edits of the whole conversation enter and leave it. One small row a stretch is read in order."""
    slim = summaries.drop("audits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for s in b.to_pylist():
                if now is None or s["conv_id"] != now.conv:
                    if now is not None:
                        done += now.path()
                    now = Chain(s["conv_id"])
                now.add(s)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema=PATH)
                done = []
        if now is not None:
            done += now.path()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=PATH)

    return slim.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")).mapInArrow(run, PATH_SQL)


EDIT_SQL = "conv_id long, seg long, no long, pos long, letter string, given string"
EDIT = ("conv_id", "seg", "no", "pos", "letter", "given")


def edits(chosen: DataFrame) -> DataFrame:
    """``conv_id, seg, no, pos, letter, given``: the edits of ``chosen(conv_id, seg, start, audit)`` one by one, the
    row of the stretch each is about (none for an inserted turn) and the role it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out, q, row = [], r["start"], -1
                for no, letter in enumerate(r["audit"]):
                    given = None
                    row += letter in "DKRS"
                    if letter in "IR":
                        given, q = GIVEN[q]
                    elif letter in "KS":
                        q = 1 if letter == "S" else GIVEN[q][1]
                    out.append((r["conv_id"], r["seg"], no, None if letter == "I" else row, letter.translate(PUBLIC), given))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=EDIT)

    return chosen.mapInArrow(run, EDIT_SQL)


def repair(turns: DataFrame, block: int = 256, times: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and the report of ``turns(conv_id, turn, role, text)``; further columns are not read.

    ``repaired``: ``conv_id, seg, no, role, text, letter``; a conversation's turns in the order of ``seg, no``.
    ``report``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row per conversation.

    Rows of a conversation stand by turn (nulls first), and where turns are equal by role and text; equal rows stand
    side by side and all but the first are duplicates. A null role or text is one space; a null ``conv_id`` is a
    conversation of its own. Roles count by their first character, whatever follows it. An empty table gives two
    empty ones. The result does not depend on ``block``, how many rows are searched at once.
    """
    laid = stored(laid_out(faulty(turns, times), block), "turns-laid")
    summaries = laid.where("summary is not null").select("summary.*")
    way = stored(paths(summaries), "turn-paths")
    said = summaries.select("seg", "audits")
    closing = F.when(F.col("last"), F.element_at(F.array(*(F.lit(CLOSING[q]) for q in range(4))), F.col("end") + 1)).otherwise("")
    chosen = way.join(said, "seg").select(
        "conv_id", "seg", "start", F.concat(F.get("audits", 4 * F.col("start") + F.col("end")), closing).alias("audit")
    )
    chosen = stored(chosen, "turn-edits")
    kept = edits(chosen).where("letter <> 'D'")
    rows = laid.where("summary is null").select(F.col("seg").alias("at"), F.col("pos").alias("place"), "role", "text")
    repaired = kept.join(rows, (F.col("seg") == F.col("at")) & (F.col("pos") == F.col("place")), "left").select(
        "conv_id", "seg", "no", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "letter"
    )
    # an answer is one string of a conversation's letters
    letters = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "audit"))).alias("a"))
    letters = letters.select(F.col("conv_id").alias("of"), F.translate(F.array_join("a.audit", ""), "Sd", "KD").alias("audit"))
    totals = way.where("last").select("conv_id", "total.*")
    report = totals.join(letters, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    return repaired, report


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of each conversation's ``role:text`` lines. A hash of all text of a conversation
    reads it in order: its rows pass one task, one batch at a time."""
    lines = repaired.select("conv_id", "seg", "no", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, done = None, None, []
        for b in batches:
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if sums is None or conv != now:
                    if sums is not None:
                        done.append((now, sums.hexdigest()))
                    now, sums = conv, hashlib.sha256()
                else:
                    sums.update(b"\n")
                sums.update(line.encode("utf-8", "surrogatepass"))
            if done:
                yield _digest_rows(done)
                done = []
        if sums is not None:
            yield _digest_rows([(now, sums.hexdigest())])

    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "no").select("conv_id", "line")
    return dealt.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    ids, sums = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])


def audit_table(turns: DataFrame, block: int = 256) -> DataFrame:
    """The report and the hash of the repaired turns for every ``conv_id`` of ``turns``, after :func:`damaged`.

    A conversation that loses all its rows to the damage has zeros, no edits and the hash of the empty text.
    """
    repaired, report = repair(damaged(turns), block, "times")
    report = report.withColumnRenamed("conv_id", "of")
    sums = digests(repaired).withColumnRenamed("conv_id", "of_text")
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        ids.join(report, F.col("conv_id").eqNullSafe(F.col("of")), "left")
        .join(sums, F.col("conv_id").eqNullSafe(F.col("of_text")), "left")
        .select(
            "conv_id",
            *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )

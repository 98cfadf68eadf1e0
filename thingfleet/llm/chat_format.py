"""Reply trees to training conversations: chosen root-to-leaf paths, a reversible template, a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import is_empty, rows_of, running_start, stored

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left: ``<``, any backslashes and ``|`` get one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("&", "&amp;").replace("\n", "&#10;")


def unescape_role(role: str) -> str:
    return unescape(role.replace("&#10;", "\n").replace("&amp;", "&"))


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """A turn in the template, and where its text lies in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and the place of the escaped text, of each turn."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in TURN.finditer(formatted)]


def chains(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as a forest: each row replies to the one before it in its conversation.

    Rows stand in the order of turn, then role and text, so ties and repeated rows have a fixed order; null
    turns come first, a null ``conv_id`` is one conversation. Rows are numbered along a range partitioning,
    so a conversation with very many rows is dealt to several tasks.
    """
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).withColumn("one", F.lit(1))
    numbered = running_start(stored(dealt, "turns"), ["at"], "one", "id").drop("one", "at", "part")
    first = numbered.groupBy("conv_id").agg(F.min("id").alias("root")).select(F.col("conv_id").alias("c2"), "root")
    return numbered.join(first, F.col("conv_id").eqNullSafe(F.col("c2"))).select(
        "id", F.when(F.col("id") > F.col("root"), F.col("id") - 1).alias("parent"), "conv_id", F.lit(0.0).alias("score"), "role", "text"
    )


def ranked_leaves(nodes: DataFrame, best: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """The ``best`` leaves of each root by the mean score of their paths, and the jump tables of the forest.

    Every round joins the table of jumps with itself, so 2**k generations take k rounds; a jump carries
    the sum of the scores it passes. Ties go to the longer path, then to the smaller leaf.
    """
    jump = nodes.select("id", F.col("parent").alias("to"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("n"))
    done = jump.where("to is null").select("id", F.col("id").alias("root"), "sum", "n")
    jumps = [stored(nodes.where("parent is not null").select("id", F.col("parent").alias("to")), "jump")]
    open_ = stored(jump.where("to is not null"), "jump-open")
    done = stored(done, "jump-done")
    while not is_empty(open_):
        # the far end is either finished (its root is known) or open itself
        ends = done.select(F.col("id").alias("to"), "root", F.col("sum").alias("s2"), F.col("n").alias("n2"))
        got = open_.join(ends, "to").select("id", "root", (F.col("sum") + F.col("s2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n"))
        far = open_.select(F.col("id").alias("to"), F.col("to").alias("t2"), F.col("sum").alias("s2"), F.col("n").alias("n2"))
        on = open_.join(far, "to").select("id", F.col("t2").alias("to"), (F.col("sum") + F.col("s2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n"))
        open_ = stored(on, "jump-open")
        done = done.unionByName(stored(got, "jump-done"))
        jumps.append(open_.select("id", "to"))
    leaves = done.join(nodes.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    # a hot root: each task keeps its own best before they meet
    mean = F.col("sum") / F.col("n")
    if best == 1:
        top = leaves.groupBy("root").agg(F.max_by("id", F.struct(mean, F.col("n"), -F.col("id"))).alias("leaf"))
        return top.select("root", "leaf", F.lit(1).alias("rank")), jumps[:-1] if len(jumps) > 1 else jumps
    place = F.row_number().over(Window.partitionBy("root").orderBy(mean.desc(), F.desc("n"), "id"))
    return leaves.select("root", F.col("id").alias("leaf"), place.alias("rank")).where(F.col("rank") <= best), jumps


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """``root, leaf, rank, up, id``: every node of each chosen path, ``up`` generations above the leaf.

    The rows of a path double with each jump table, so the work is the size of the chosen paths.
    """
    top, jumps = ranked_leaves(nodes, best)
    out = top.select("root", "leaf", "rank", F.lit(0).cast("long").alias("up"), F.col("leaf").alias("id"))
    for k, jump in enumerate(jumps):
        further = out.join(jump, "id").select("root", "leaf", "rank", (F.col("up") + F.lit(2**k)).alias("up"), F.col("to").alias("id"))
        out = stored(out.unionByName(further), "paths")
    return out


def format_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """``conv_id, leaf, rank, at, formatted, mask``: the chosen paths in the template, a row per turn.

    A conversation is the ``formatted`` of its rows in the order ``at``; ``mask`` is the place of a text
    that is trained on (of an assistant), else null. Rows keep long conversations out of single values.
    """
    rows = paths(nodes, best).join(nodes.select("id", "conv_id", "role", "text"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, masks = [], []
            for role, text in zip(rows_of(b, "role"), rows_of(b, "text")):
                turn, place = format_turn(role, text)
                made.append(turn)
                masks.append(list(place) if role == "assistant" else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(4)] + [pa.array(made, pa.string()), pa.array(masks, pa.list_(pa.int64()))],
                names=["conv_id", "leaf", "rank", "up", "formatted", "mask"],
            )

    picked = rows.select("conv_id", "leaf", "rank", "up", "role", "text")
    return picked.mapInArrow(run, "conv_id long, leaf long, rank int, up long, formatted string, mask array<long>").select(
        "conv_id", "leaf", "rank", (-F.col("up")).alias("at"), "formatted", "mask"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, ``up`` the rows of a conversation in order.

    Rows of a conversation are sorted by Spark and hashed as they pass, so a very long one is never whole
    in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def close() -> pa.RecordBatch:
            n, turns, loss_chars, loss, chars = state
            return pa.RecordBatch.from_pylist(
                [{"conv_id": key[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}],
                schema=schema,
            )

        for b in batches:
            for conv, leaf, formatted, mask in zip(*(rows_of(b, c) for c in ("conv_id", "leaf", "formatted", "mask"))):
                if (conv, leaf) != key or state is None:
                    if state is not None:
                        yield close()
                    key, state = (conv, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if mask is not None:
                    said = unescape(formatted[mask[0] : mask[1]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
        if state is not None:
            yield close()

    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    dealt = formatted.repartition("conv_id", "leaf").sortWithinPartitions("conv_id", "leaf", "at")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

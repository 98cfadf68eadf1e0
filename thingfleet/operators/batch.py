"""The write path in one call: intake, upgrade, stamp, validation, and the new state of documents and quads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..session import kept
from ..sources.catalog import Conflict, Store
from ..vocab import GRAPH_PREFIX
from ..sources.graphs import dedup, stored
from ..sources.rules import Rule
from . import mutate as M
from .triples import triplify
from .validate import validate


@dataclass(frozen=True)
class Batch:
    """``things`` (id, body) and ``quads`` after a batch, its ``events`` and ``rejects``."""

    things: DataFrame
    quads: DataFrame
    events: DataFrame
    rejects: DataFrame


def apply_batch(ops: DataFrame, things: DataFrame, quads: DataFrame, rules: list[Rule]) -> Batch:
    """Apply ``ops`` (seq, op, id, body, ts) to stored documents and their quads.

    Each operation is taken in, its document upgraded and stamped, checked against all rules and applied or
    rejected with all its errors; one that fails leaves the others alone. Only graphs of documents that
    changed are written anew.
    """
    out, docs, graphs = _changes(ops, things, rules)
    return Batch(out.things, M.overwrite_graphs(quads, _quads(docs), graphs), out.events, out.rejects)


def _changes(ops: DataFrame, things: DataFrame, rules: list[Rule]) -> tuple[M.Outcome, DataFrame, DataFrame]:
    """What a batch leads to, the documents it wrote (``id, body``), and the graphs of all it touched (``id, g``)."""
    checked = stored(dedup(triplify(M.documents_to_check(ops))))
    invalid = M.invalid_ops(validate(checked, rules), GRAPH_PREFIX)
    out = M.apply_ops(ops, things, invalid, stamp=True)
    touched = out.events.select(F.col("thing_id").alias("id")).distinct()
    docs = out.things.join(touched, "id", "left_semi")
    return out, docs, touched.select("id", F.concat(F.lit(GRAPH_PREFIX), "id").alias("g"))


def _quads(docs: DataFrame) -> DataFrame:
    return dedup(triplify(docs.select("id", F.parse_json("body").alias("doc"))))


@dataclass(frozen=True)
class Committed:
    """The version that a batch became (the one it read, when it changed nothing), its ``events`` and ``rejects``."""

    version: int
    events: DataFrame
    rejects: DataFrame


def commit_batch(store: Store, ops: DataFrame, rules: list[Rule], tries: int = 3) -> Committed:
    """:func:`apply_batch` on the current version of ``store``, of which only changed documents and graphs are written.

    When another writer has changed one of the same documents in between, the batch is applied again to what is
    there then, up to ``tries`` times.
    """
    for left in reversed(range(tries)):
        read = store.current() or 0
        things = store.things(read) if read else ops.sparkSession.createDataFrame([], "id string, body string")
        out, docs, touched = _changes(ops, things, rules)
        docs, touched = kept(docs, "changed"), kept(touched, "touched")
        events, rejects = kept(out.events, "events"), kept(out.rejects, "rejects")
        if touched.isEmpty():
            return Committed(read, events, rejects)
        try:
            version = store.commit_changes(docs, _quads(docs), touched, touched, read)
            return Committed(version, events, rejects)
        except Conflict:
            if not left:
                raise
    raise ValueError("a batch is tried at least once")

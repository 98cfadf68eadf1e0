"""Ordered batches of create, replace, patch and delete applied to a table of documents.

Operations take effect in the order of ``seq``. The outcome is computed with aggregations: per id the
last replace or delete wins, per id and top-level key the last patch after it. Both combine on the
map side, so an id that holds a large share of all operations is no bottleneck. What an operation
means at its own time (created or updated, patch of something that is gone) comes from
:func:`thingfleet.operators.ordered.carry_last`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..schema import QUAD_COLS
from ..session import cut, kept
from ..sources.documents import intake, message_of, reject_rows
from .ordered import carry_last

RESETS = ("CREATE", "PUT", "DELETE")


@dataclass(frozen=True)
class Outcome:
    """``things`` (id, body), ``events`` and ``rejects`` of a batch, each worked out when asked for."""

    after: Callable[[], DataFrame]
    answers: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def things(self) -> DataFrame:
        return self.after()

    @cached_property
    def _answers(self) -> tuple[DataFrame, DataFrame]:
        return self.answers()

    @property
    def events(self) -> DataFrame:
        return self._answers[0]

    @property
    def rejects(self) -> DataFrame:
        return self._answers[1]


def name_based_id(*parts: Column) -> Column:
    """An address that looks like a version 5 UUID, derived from ``parts``."""
    h = F.sha1(F.concat_ws("|", *parts))
    piece = lambda start, n: F.substr(h, F.lit(start), F.lit(n))
    variant = D.at(
        F.array(*[F.lit(x) for x in "89ab"]), (F.conv(piece(17, 1), 16, 10).cast("int") % 4) + 1
    )
    return F.concat(
        F.lit("urn:uuid:"),
        F.concat_ws(
            "-",
            piece(1, 8),
            piece(9, 4),
            F.concat(F.lit("5"), piece(14, 3)),
            F.concat(variant, piece(18, 3)),
            piece(21, 12),
        ),
    )


def mint_ids(ops: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Give anonymous creates an id from their number and body, again while one is taken.

    ``taken`` has the ids in use; the minted ones of a batch differ because their numbers do. The id is
    written into the document. Operations of other kinds pass unchanged.
    """
    return _with_own_id(_mint(ops, taken))


def _with_own_id(ops: DataFrame) -> DataFrame:
    """Created documents say their id themselves; needs ``m``."""
    if "m" not in ops.columns:
        return ops
    own = F.create_map(F.lit("id"), D.text_variant(F.col("id")))
    return ops.withColumn("m", F.when(F.col("op") == "CREATE", D.overlay(F.col("m"), own)).otherwise(F.col("m")))


def _mint(ops: DataFrame, taken: DataFrame | None) -> DataFrame:
    named = ops.withColumn(
        "id",
        F.when(F.col("op") == "CREATE", name_based_id(F.col("seq").cast("string"), F.col("body")))
        .otherwise(F.col("id")),
    )
    if taken is None:
        return named
    done, salt = [], 0
    while True:
        creates = named.where("op = 'CREATE'")
        clash = cut(creates.join(taken.select("id").distinct(), "id", "left_semi"))
        if clash.isEmpty():
            break
        done.append(named.join(clash.select("seq"), "seq", "left_anti"))
        salt += 1
        again = name_based_id(F.col("seq").cast("string"), F.lit(str(salt)), F.col("body"))
        named = clash.select(*ops.columns).withColumn("id", again)
    for part in done:
        named = named.unionByName(part)
    return named


def flag_existing(ops: DataFrame, things: DataFrame) -> DataFrame:
    """Add ``known``: whether the id is in ``things``."""
    ids = things.select("id", F.lit(True).alias("known")).dropDuplicates(["id"])
    return ops.join(ids, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def classify(ops: DataFrame, things: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Add ``existed``: whether the document was there just before the operation."""
    told = carry_last(
        ops, "id", "seq", F.when(F.col("op").isin(*RESETS), F.col("op") != "DELETE"), "__there", block
    )
    if things is None:
        return told.withColumn("existed", F.coalesce("__there", F.lit(False))).drop("__there")
    return (
        flag_existing(told, things)
        .withColumn("existed", F.coalesce("__there", "known"))
        .drop("__there", "known")
    )


def event_type() -> Column:
    """The event an accepted operation causes; needs ``existed``."""
    op = F.col("op")
    return (
        F.when(op == "CREATE", "thing_created")
        .when(op == "DELETE", "thing_deleted")
        .when((op == "PUT") & F.col("existed"), "thing_updated")
        .when(op == "PUT", "thing_created")
        .when((op == "PATCH") & F.col("existed"), "thing_updated")
    )


def event_rows(classified: DataFrame) -> DataFrame:
    """Events in the order of the operations, numbered by them."""
    return (
        classified.withColumn("event", event_type())
        .where("event is not null")
        .select(
            "seq",
            "event",
            F.col("id").alias("thing_id"),
            F.to_json(F.struct("id")).alias("data"),
            "ts",
        )
    )


def fold(ops: DataFrame, things: DataFrame, stamp: bool = False) -> DataFrame:
    """Documents after all of ``ops``: ``id, body``. Needs ``m``; invalid operations are gone.

    A patch of a document that was not there needs no treatment: it lies before the reset that
    decides, or there is nothing to lay it over.

    With ``stamp`` documents are upgraded and stamped as they would be one at a time.
    """
    resets = ops.where(F.col("op").isin(*RESETS))
    body = F.col("m")
    if stamp:
        body = D.bind(D.upgrade(body), lambda x: D.decorate(x, F.col("ts")))
    # keep the text: VARIANT cannot be ordered, and one row per id is all that is kept
    last_reset = resets.groupBy("id").agg(
        F.max(F.struct("seq", "op", F.to_json(body).alias("body"))).alias("r")
    )
    patches = ops.where("op = 'PATCH'")
    by_key = (
        # an empty patch has no key, but it cleans and stamps the document as well
        patches.select("id", "seq", "ts", F.explode_outer(F.map_entries("m")).alias("e"))
        .select("id", "seq", "ts", F.col("e.key").alias("key"), F.to_json("e.value").alias("value"))
        .groupBy("id", "key")
        .agg(F.max(F.struct("seq", "value", "ts")).alias("p"))
    )
    # one row per id: its keys are those of one document
    by_id = by_key.groupBy("id").agg(
        F.collect_list(F.struct("key", "p.seq", "p.value", "p.ts")).alias("patch")
    )
    base = things.select("id", F.col("body").alias("base"))
    rows = (
        base.join(last_reset, "id", "full")
        .join(by_id, "id", "full")
        .withColumn(
            "start", F.when(F.col("r").isNull(), F.col("base")).when(F.col("r.op") != "DELETE", F.col("r.body"))
        )
        .where("start is not null")
    )
    since = F.coalesce(F.col("r.seq"), F.lit(-1).cast("bigint"))
    live = F.filter("patch", lambda k: k["seq"] > since)
    rows = rows.withColumn("live", F.coalesce(live, F.array().cast(rows.schema["patch"].dataType)))
    start = D.fields(F.try_parse_json("start"))
    over = F.map_from_entries(
        F.transform(
            F.filter("live", lambda k: k["key"].isNotNull()),
            lambda k: F.struct(k["key"], F.parse_json(k["value"]).alias("value")),
        )
    )
    merged = F.to_json(D.drop_null_fields(D.overlay(start, over)))
    text = D.remove_nulls(F.parse_json(merged), D.nesting_depth(merged))
    rows = rows.withColumn(
        "body",
        F.when(F.size("live") == 0, F.to_json(F.parse_json("start"))).otherwise(text),
    )
    if stamp:
        fields = D.fields(F.parse_json("body"))
        gone = F.filter("live", lambda k: (k["key"] == "registration") & (k["value"] == "null"))
        # a patch that drops the stamp block makes the document start a new one at that moment
        restarted = D.bind(
            fields,
            lambda x: F.when(
                F.size(gone) > 0, D.decorate(x, F.get(gone, F.lit(0))["ts"])
            ).otherwise(x),
        )
        last = F.array_max(F.transform("live", lambda k: F.struct(k["seq"], k["ts"])))
        stamped = D.bind(restarted, lambda x: D.decorate(x, last["ts"]))
        rows = rows.withColumn(
            "body", F.when(F.size("live") == 0, F.col("body")).otherwise(F.to_json(stamped))
        )
    return rows.select("id", "body")


def apply_ops(
    ops: DataFrame,
    things: DataFrame,
    invalid: DataFrame | None = None,
    stamp: bool = False,
    block: int | None = None,
) -> Outcome:
    """Apply a batch: one operation that fails is rejected, the rest proceed.

    ``ops`` has ``seq, op, id, body, ts``; ``things`` has ``id, body``. ``invalid`` lists
    operations (``seq``, optionally ``errors``) whose document breaks the shape rules. Because
    every rule of a document looks at one top-level member, and a patch replaces whole members,
    whether an operation is valid does not depend on the ones before it (see
    :func:`documents_to_check`), so rejecting them first equals doing it one at a time.
    """
    taken_in = intake(ops)
    listed = None
    if invalid is not None:
        listed = invalid.select("seq", *[c for c in invalid.columns if c == "errors"])
        if "errors" not in listed.columns:
            listed = listed.withColumn(
                "errors", F.array().cast("array<struct<field:string,description:string>>")
            )

    def named(rows: DataFrame) -> DataFrame:
        return mint_ids(rows.where("code is null").drop("code"), things)

    def after() -> DataFrame:
        good = named(taken_in)
        if listed is not None:
            good = good.join(listed.select("seq"), "seq", "left_anti")
        return fold(good, things, stamp)

    def answers() -> tuple[DataFrame, DataFrame]:
        # documents are parsed once; what follows is read several times and needs the text of creates at most
        text = F.when(F.col("op") == "CREATE", F.col("body")).alias("body")
        taken = kept(taken_in.select("seq", "op", "id", text, "ts", "code"), "batch-ops")
        bad, good = reject_rows(taken), named(taken).drop("body")
        if listed is not None:
            failed = good.join(listed.dropDuplicates(["seq"]), "seq").withColumn("code", F.lit("validation"))
            bad = bad.unionByName(
                failed.select("seq", "id", "code", message_of(F.col("code")).alias("message"), "errors")
            )
            good = good.join(listed.select("seq"), "seq", "left_anti")
        told = classify(good, things, block)
        missing = told.where("op = 'PATCH' and not existed")
        bad = bad.unionByName(reject_rows(missing.withColumn("code", F.lit("not_found"))))
        return event_rows(told.where("op <> 'PATCH' or existed")), bad

    return Outcome(after, answers)


def documents_to_check(ops: DataFrame) -> DataFrame:
    """A document per operation whose validity is that of the operation: ``id`` is the number.

    A created or replaced document is checked as it is, after the upgrade. A patch is laid over a
    smallest valid document, which checks the members it brings and that it removes no required one.
    """
    filler = (
        '{"title":"t","security":["nosec_sc"],'
        '"securityDefinitions":{"nosec_sc":{"scheme":"nosec"}},"@type":["Thing"]}'
    )
    parsed = intake(ops).where("code is null and op <> 'DELETE'")
    ts = F.col("ts")
    whole = D.bind(D.upgrade(F.col("m")), lambda x: D.decorate(x, ts))
    patched = D.decorate(
        D.drop_null_fields(D.overlay(D.fields(F.parse_json(F.lit(filler))), F.col("m"))), ts
    )
    return parsed.select(
        F.concat(F.lit("urn:op:"), "seq").alias("id"),
        F.to_variant_object(F.when(F.col("op") == "PATCH", patched).otherwise(whole)).alias("doc"),
    )


def invalid_ops(violations: DataFrame, prefix: str) -> DataFrame:
    """Operation numbers with all their errors, from violations of :func:`documents_to_check`.

    A list is as long as one document has errors.
    """
    errors = F.collect_set(F.struct(F.col("constraint").alias("field"), F.col("message").alias("description")))
    return violations.groupBy("g").agg(F.array_sort(errors).alias("errors")).select(
        F.replace("g", F.lit(prefix + "urn:op:"), F.lit("")).cast("bigint").alias("seq"), "errors"
    )


# ---------------------------------------------------------------- graphs and snapshots


def overwrite_graphs(quads: DataFrame, new: DataFrame, emptied: DataFrame | None = None) -> DataFrame:
    """Replace whole graphs: those named in ``new`` or ``emptied`` lose all their quads first."""
    changed = new.select("g")
    if emptied is not None:
        changed = changed.unionByName(emptied.select("g"))
    kept = quads.join(changed.distinct(), "g", "left_anti")
    return kept.select(*QUAD_COLS).unionByName(new.select(*QUAD_COLS))


def upsert_documents(things: DataFrame, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Replace rows by id; ``deleted`` ids go."""
    changed = new.select("id")
    if deleted is not None:
        changed = changed.unionByName(deleted.select("id"))
    return things.join(changed.distinct(), "id", "left_anti").unionByName(new)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events that lead from one table of documents (id, body) to another.

    Compares content hashes, so only two short columns are shuffled.
    """
    digest = lambda d, name: d.select("id", F.sha2("body", 256).alias(name))
    both = digest(before, "__b").join(digest(after, "__a"), "id", "full")
    event = (
        F.when(F.col("__b").isNull(), "thing_created")
        .when(F.col("__a").isNull(), "thing_deleted")
        .when(F.col("__a") != F.col("__b"), "thing_updated")
    )
    return both.select(F.col("id").alias("thing_id"), event.alias("event")).where("event is not null")

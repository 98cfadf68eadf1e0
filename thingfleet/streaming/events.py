"""The change stream: log, replay, subscription, derivation from operations, text frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.mutate import RESETS, classify, event_rows, event_type
from ..operators.ordered import number_rows
from ..schema import EVENTS
from ..vocab import EVENT_TYPES


def known_type(event: Column) -> Column:
    """The event name if it is one of the three, else NULL."""
    return F.when(event.isin(*EVENT_TYPES), event)


def wire_name(name: Column) -> Column:
    """Name on the wire of an event type given in upper case."""
    return known_type(F.lower(name))


def _types(types: tuple[str, ...] | None) -> list[str]:
    chosen = list(types or EVENT_TYPES)
    unknown = [t for t in chosen if t not in EVENT_TYPES]
    if unknown:
        raise ValueError(f"unknown event types {unknown}")
    return chosen


def payload(id_: Column | str) -> Column:
    return F.to_json(F.struct((F.col(id_) if isinstance(id_, str) else id_).alias("id")))


def past_events(log: DataFrame, last: str | None, types: tuple[str, ...] | None = None) -> DataFrame:
    """Logged events after the last one a subscriber has seen.

    Without a last id, or with one that is not a whole number, there is nothing to replay.
    """
    seen = F.lit(last).try_cast("bigint")
    return log.where(F.col("seq") > seen).where(F.col("event").isin(*_types(types)))


def check_diff(types: tuple[str, ...] | None, diff: bool) -> None:
    """Changes as differences are not offered, except that deletions have none to offer."""
    if diff and list(types or EVENT_TYPES) != ["thing_deleted"]:
        raise NotImplementedError("differences are not supported for this subscription")


def subscribe(
    stream: DataFrame, types: tuple[str, ...] | None = None, diff: bool = False
) -> DataFrame:
    """The events of some types; works on a stream and on a table."""
    check_diff(types, diff)
    return stream.where(F.col("event").isin(*_types(types)))


def merge(*streams: DataFrame) -> DataFrame:
    """One stream from streams of single types."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event log as a stream. A new reader replays the log and goes on without a gap."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def follow(spark: SparkSession, path: str, last: str | None, types: tuple[str, ...] | None = None):
    """Replay after ``last`` and then live events, from one reading of the log."""
    stream = subscribe(read_log(spark, path), types)
    seen = F.lit(last).try_cast("bigint")
    return stream.where(F.col("seq") > seen) if last is not None else stream


def number_events(rows: DataFrame, start: int = 0, block: int | None = None) -> DataFrame:
    """Renumber events without gaps from ``start`` in the order of ``seq``."""
    return number_rows(rows, "seq", "__n", start, block).withColumn("seq", F.col("__n")).drop("__n")


def derive(ops: DataFrame, things: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Events of a batch of valid operations."""
    return event_rows(classify(ops, things, block))


def frames(rows: DataFrame) -> DataFrame:
    """Text frame per event in column ``value``: event, id, one data line per line of data."""
    lines = F.transform(
        F.split("data", r"\r\n|\n|\r"), lambda x: F.concat(F.lit("data: "), x, F.lit("\n"))
    )
    line = lambda name, c: F.when(
        c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\n"))
    ).otherwise("")
    text = F.concat(
        line("event", F.col("event")),
        line("id", F.col("seq")),
        F.array_join(lines, ""),
        F.lit("\n"),
    )
    return rows.select("seq", text.alias("value"))


def write_frames(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    # every text line ends with a newline, and a frame ends with an empty line
    text = frames(stream).select(F.regexp_replace("value", r"\n\z", "").alias("value"))
    writer = text.writeStream.format("text").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def write_log(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of events to a log, one folder per type."""
    writer = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("event")
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def write_events(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of events to a folder; each batch counts once, also when it is repeated."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


class Classifier:
    """Events from a stream of operations, with what exists kept in a table between batches.

    A batch is classified like any table, so an id with very many operations is spread over tasks
    instead of meeting one keyed state. After a batch only the ids it touched are added to the
    state table; a reader takes the newest line of an id. Folders carry the batch number and are
    overwritten when a batch is repeated, so a retry changes nothing.
    """

    def __init__(self, home: str, block: int | None = None):
        self._home, self._block = home.rstrip("/"), block

    def state(self, spark: SparkSession, before: int) -> DataFrame | None:
        """Ids that exist after all batches below ``before``."""
        if before <= 0:
            return None
        schema = "id string, seq bigint, there boolean"
        paths = f"{self._home}/state"
        try:
            rows = spark.read.schema(schema + ", batch bigint").option("basePath", paths).parquet(paths)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        newest = rows.where(F.col("batch") < before).groupBy("id").agg(
            F.max(F.struct("seq", "there")).alias("s")
        )
        return newest.where("s.there").select("id")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self.state(spark, number)
        told = classify(batch, before, self._block)
        event_rows(told).write.mode("overwrite").parquet(f"{self._home}/events/batch={number}")
        batch.where(F.col("op").isin(*RESETS)).groupBy("id").agg(
            F.max(F.struct("seq", "op")).alias("r")
        ).select("id", "r.seq", (F.col("r.op") != "DELETE").alias("there")).write.mode(
            "overwrite"
        ).parquet(f"{self._home}/state/batch={number}")

    def start(self, ops: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = ops.writeStream.foreachBatch(self).option(
            "checkpointLocation", f"{self._home}/checkpoint"
        )
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def events(self, spark: SparkSession) -> DataFrame:
        path = f"{self._home}/events"
        return spark.read.schema(EVENTS).option("basePath", path).parquet(path).select(
            "seq", "event", "thing_id", "data", "ts"
        )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Existence(StatefulProcessor):
    """Whether the document of an id is there, as the state of that id."""

    def init(self, handle) -> None:
        self._there = handle.getValueState("there", "there boolean")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat([r[["seq", "op", "ts"]] for r in rows]).sort_values("seq", kind="stable", ignore_index=True)
        there = self._there.get()[0] if self._there.exists() else False
        # what each operation leaves behind, as 0 or 1; a patch changes nothing
        made = batch["op"].map({op: float(op != "DELETE") for op in RESETS})
        left = pd.concat([pd.Series([float(there)]), made], ignore_index=True).ffill()
        existed = left.iloc[:-1].astype(bool).reset_index(drop=True)
        self._there.update((bool(left.iloc[-1]),))
        yield pd.DataFrame({"id": key[0], "seq": batch["seq"], "op": batch["op"], "ts": batch["ts"], "existed": existed})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._there.update((True,))

    def close(self) -> None:
        pass


def classify_keyed(ops: DataFrame, things: DataFrame | None = None) -> DataFrame:
    """``id, seq, op, ts, existed`` of a stream of operations: whether the document was there before each of them.

    Existence is keyed state in RocksDB, one flag per id, so a micro-batch costs its own rows whatever was seen
    before. It starts from the ids of ``things`` (``id``), read once with the first batch. The operations of an id
    are taken in the order of ``seq`` within a micro-batch and batches in theirs; those of one id in one
    micro-batch (numbers, kinds and times, no bodies) are held together in a task, which the source's limit of
    files per batch bounds. Operations without an id are dropped, as they name nothing.
    """
    spark = ops.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = None
    if things is not None:
        known = things.where("id is not null").select("id").distinct().groupBy("id")
    return (
        ops.where("id is not null")
        .select("id", "seq", "op", "ts")
        .groupBy("id")
        .transformWithStateInPandas(
            statefulProcessor=_Existence(),
            outputStructType="id string, seq bigint, op string, ts timestamp, existed boolean",
            outputMode="Append",
            timeMode="None",
            initialState=known,
        )
    )


def derive_keyed(ops: DataFrame, things: DataFrame | None = None) -> DataFrame:
    """The events of a stream of operations, with keyed state instead of a table read anew for every batch."""
    return event_rows(classify_keyed(ops, things))


class Ledger:
    """Gapless numbers over a stream: every micro-batch goes on where the last one ended.

    A batch is numbered in the order of ``seq`` and written to a folder of its number; the ledger keeps one row a
    batch with the total up to its end. A repeated batch reads the same total before it and overwrites its own
    folders, so numbers stay the same; an empty batch only carries the total on.
    """

    def __init__(self, home: str, start: int = 0, block: int | None = None):
        self._home, self._start, self._block = home.rstrip("/"), start, block

    def before(self, spark: SparkSession, number: int) -> int:
        """The number of the first event of batch ``number``."""
        path = f"{self._home}/totals"
        schema = "total bigint, batch bigint"
        try:
            totals = spark.read.schema(schema).option("basePath", path).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self._start
            raise
        # folders of batches are listed, one of them is read
        earlier = totals.where(F.col("batch") < number)
        newest = earlier.agg(F.max("batch").alias("b")).first().b
        return self._start if newest is None else totals.where(F.col("batch") == newest).first().total

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = self.before(spark, number)
        numbered = number_events(batch, first, self._block)
        folder = f"{self._home}/events/batch={number}"
        numbered.write.mode("overwrite").parquet(folder)
        count = spark.read.schema(EVENTS).parquet(folder).count()
        spark.range(1).select(F.lit(first + count).cast("bigint").alias("total")).coalesce(1).write.mode("overwrite").parquet(
            f"{self._home}/totals/batch={number}"
        )

    def start(self, events: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Number a stream of events (columns of ``EVENTS``)."""
        writer = events.writeStream.foreachBatch(self).option("checkpointLocation", f"{self._home}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def events(self, spark: SparkSession) -> DataFrame:
        path = f"{self._home}/events"
        return spark.read.schema(EVENTS).option("basePath", path).parquet(path).select("seq", "event", "thing_id", "data", "ts")


__all__ = [
    "Classifier", "Ledger", "check_diff", "classify_keyed", "derive", "derive_keyed", "event_type", "follow", "frames", "known_type", "merge",
    "number_events", "past_events", "payload", "read_log", "subscribe", "wire_name", "write_events", "write_frames",
    "write_log",
]

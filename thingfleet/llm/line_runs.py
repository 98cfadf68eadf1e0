"""Line deduplication over levelled sorted runs of line hashes, by DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thingfleet.session import scratch

from .common import SPACES, lowered, stored, with_key

ADDED = ("n_lines", "n_dropped", "new_text")
RUN = "h1 long, h2 long, n_docs long, last_doc long"


class LineRuns:
    """What batches have shown so far: runs of ``(key hash, documents, largest document)`` sorted by hash.

    A new batch is joined with every run: keys that no run holds are its own new lines, the others are met
    again. It then becomes a run of level 0; ``fanout`` runs of one level are merged into one of the next,
    so there are few runs to join and each row is rewritten once per level. The counts of a key add up over
    runs because a document lies in one batch.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.folder = scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level={level}/run-{self.made}"
        self.made += 1
        run.select("h1", "h2", "n_docs", "last_doc").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        """One row per key in sorted runs of each partition."""
        return (
            rows.groupBy("h1", "h2")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            .sortWithinPartitions("h1", "h2")
        )

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The keys of a batch that no run holds: a merge anti join with the runs."""
        return reduce(lambda b, p: b.join(self._read([p]).hint("merge"), ["h1", "h2"], "left_anti"), self.paths(), batch)

    def add(self, pairs: DataFrame) -> None:
        """Take a batch of ``(h1, h2, doc_id)``: its unseen keys and the further counts of seen ones."""
        own = self.merged(
            pairs.select("h1", "h2", "doc_id").distinct().select(
                "h1", "h2", F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("last_doc")
            )
        )
        if not self.paths():
            self._write(own, 0)
        else:
            own = stored(own, "line-batch")
            new = self.unseen(own)
            again = own.join(new.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self._write(new.unionByName(again).sortWithinPartitions("h1", "h2"), 0)
        self.compact()

    def compact(self) -> None:
        for level in range(len(self.levels) + 1):
            if level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                paths, self.levels[level] = self.levels[level], []
                self._write(self.merged(self._read(paths)), level + 1)

    def totals(self) -> DataFrame:
        return self.merged(self._read(self.paths()))


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, row_key, line_no`` and the hash of the key, null for keys of fewer than ``least`` code points."""
    key = lowered(F.btrim("line", F.lit(SPACES)))
    long_enough = F.char_length(key) >= least
    return (
        with_key(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
        .select("doc_id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .select(
            "doc_id",
            "row_key",
            "line_no",
            F.when(long_enough, F.xxhash64(key)).alias("h1"),
            F.when(long_enough, F.xxhash64(F.lit("second"), key)).alias("h2"),
        )
    )


def dedup_lines(docs: DataFrame, least: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with the lines that ``min_docs`` documents share kept only in the largest ``doc_id`` holding them.

    Adds ``n_lines`` (before), ``n_dropped`` and ``new_text``, which replace columns of these names; all other
    columns and all rows of ``docs`` stay, in which rows of one ``doc_id`` are one document. Null and empty texts are one empty line. A null
    ``doc_id`` counts as one document, smaller than any other. Keys are told apart by 128 bits of hash.
    Lines travel as hashes; the texts of documents are shuffled once, to meet their marks.
    """
    spark = docs.sparkSession
    # only lines that may go are written; batches are the documents by hash
    found = line_keys(docs, least).where("h1 is not null")
    found = stored(found.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "line-keys")
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(found.where(F.col("batch") == k))
    # a table of its own, so that the join with it may be split where a line is very common
    shared = stored(runs.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"), "shared-lines")
    goes = (
        found.join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .select("doc_id", "row_key", "line_no")
        .distinct()
        .groupBy("doc_id", "row_key")
        .agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    )
    # the marks and the document lie apart in structs, so no column of ``docs`` can stand in for a helper
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    text = F.coalesce("doc.text", F.lit(""))
    id_ = F.col("doc.doc_id").cast("long")
    same = F.xxhash64(id_, text).eqNullSafe(F.col("mark.row_key")) & id_.eqNullSafe(F.col("mark.doc_id"))
    joined = whole.join(goes.select(F.struct("doc_id", "row_key", "gone").alias("mark")), same, "left")
    gone = F.col("mark.gone")
    untouched = gone.isNull()
    told = joined.withColumn("split", F.split(text, "\n", -1)).select(
        "doc",
        F.size("split").cast("long").alias("n_before"),
        F.when(untouched, 0).otherwise(F.size(gone)).cast("long").alias("n_gone"),
        F.when(untouched, text).otherwise(_kept_lines("split", gone)).alias("left_text"),
    )
    return told.select(
        *(F.col(f"doc.`{c}`") for c in docs.columns if c not in ADDED),
        F.col("n_before").alias("n_lines"),
        F.col("n_gone").alias("n_dropped"),
        F.col("left_text").alias("new_text"),
    )


def _kept_lines(lines: str, gone: Column) -> Column:
    """The text of ``lines`` without those whose numbers the sorted ``gone`` holds.

    Stretches between neighbouring numbers are slices, so the work grows with the lines.
    """
    bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    ends = F.arrays_zip(F.slice(bounds, 1, F.size(gone) + 1).alias("a"), F.slice(bounds, 2, F.size(gone) + 1).alias("b"))
    stretches = F.transform(ends, lambda e: F.slice(lines, e["a"] + 2, e["b"] - e["a"] - 1))
    return F.array_join(F.flatten(stretches), "\n")

"""A corpus made ready for training: quality rules, line dedup, near copies, decontamination, packing.

Every stage takes the documents that its predecessor kept and, but for the last, returns rows with the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thingfleet.llm import decontaminate, jaccard_join, line_runs, packing, quality_rules
from thingfleet.llm.common import prepared, stored, table

#: Word weights and certified cutoffs can't be said in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` and text are those of a row in ``gone(doc_id, row_key)``."""
    gone = gone.select("doc_id", "row_key").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("doc"))  # whatever its columns are called
    same = F.xxhash64("doc.doc_id", "doc.text").eqNullSafe(F.col("row_key")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id"))
    return whole.join(gone, same, "left_anti").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules reject go; null texts have no words and go too."""
    prepared(spark)
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one of them; ``n_chars`` follows the text."""
    out = line_runs.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    return out.select(
        *(
            F.when(changed, F.col("new_text")).otherwise(F.col("text")).alias("text")
            if c == "text"
            else F.when(changed, F.char_length("new_text").cast(t)).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(c)
            for c, t in docs.dtypes
        )
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest ``doc_id`` stays."""
    prepared(spark)
    groups = jaccard_join.grouped(docs)
    copies = groups.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words inside benchmark passages go."""
    prepared(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(decontaminate.is_contaminated()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    prepared(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Bulk document intake: parse, check, take the id, promote hot fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..vocab import GRAPH_PREFIX


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files of one JSON document per line, as column ``body``."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def parse(rows: DataFrame) -> DataFrame:
    """Add ``m``, the top-level fields of ``body``; NULL unless it is a JSON object."""
    return rows.withColumn("m", D.fields(F.try_parse_json("body")))


def body_id(m: Column) -> Column:
    """The textual ``@id``, else the textual ``id``."""
    return F.coalesce(
        D.text_of(F.try_element_at(m, F.lit("@id"))), D.text_of(F.try_element_at(m, F.lit("id")))
    )


def graph_id(id_: Column, prefix: str = GRAPH_PREFIX) -> Column:
    return F.concat(F.lit(prefix), id_)


def intake_code(op: Column, m: Column, body: Column, id_: Column) -> Column:
    """Why an incoming document cannot be taken; NULL when it can."""
    return (
        F.when(op == "DELETE", None)
        .when(F.coalesce(F.length(F.trim(body)), F.lit(0)) == 0, "empty_body")
        .when(m.isNull(), "not_an_object")
        .when((op == "CREATE") & id_.isNotNull(), "id_not_allowed")
        .when((op == "PUT") & (F.coalesce(F.length(id_), F.lit(0)) == 0), "id_missing")
    )


MESSAGES = {
    "empty_body": "The body is empty.",
    "not_an_object": "The body is not a JSON object.",
    "id_not_allowed": "An anonymous document must not carry an id.",
    "id_missing": "The document needs a textual @id or id.",
    "not_found": "There is no document with this id.",
    "validation": "The document breaks at least one rule.",
}


def message_of(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, text in MESSAGES.items():
        out = out.when(code == name, text)
    return out


def intake(ops: DataFrame) -> DataFrame:
    """``ops`` with ``m``, the id taken from the body where the operation says so, and ``code``.

    A replace takes its id from the document itself, a patch or delete from the request.
    """
    parsed = parse(ops).withColumn("__own", body_id(F.col("m")))
    coded = parsed.withColumn(
        "code", intake_code(F.col("op"), F.col("m"), F.col("body"), F.col("__own"))
    )
    return coded.withColumn(
        "id", F.when(F.col("op") == "PUT", F.col("__own")).otherwise(F.col("id"))
    ).drop("__own")


def reject_rows(coded: DataFrame) -> DataFrame:
    errors = F.array().cast("array<struct<field:string,description:string>>")
    return coded.where("code is not null").select(
        "seq", "id", "code", message_of(F.col("code")).alias("message"), errors.alias("errors")
    )


def promote(docs: DataFrame, prefix: str = GRAPH_PREFIX) -> DataFrame:
    """The canonical ``things`` table from ``id`` and ``body`` text."""
    parsed = parse(docs)
    reg = D.fields(F.try_element_at("m", F.lit("registration")))
    stamp = lambda name: D.text_of(F.try_element_at(reg, F.lit(name))).try_cast("timestamp")
    return parsed.select(
        "id",
        graph_id(F.col("id"), prefix).alias("graph_id"),
        D.text_of(F.try_element_at("m", F.lit("title"))).alias("title"),
        D.types_of(F.col("m")).alias("types"),
        stamp("created").alias("created"),
        stamp("modified").alias("modified"),
        F.try_parse_json("body").alias("doc"),
    )

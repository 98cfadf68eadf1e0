"""Device descriptions and operations derived from the business tables.

Every customer becomes a description; which legacy forms, gaps and faults it shows follows from
its key, so that a query over all descriptions meets all cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..vocab import CONTEXT_V10, CONTEXT_V11

RUN = "2024-06-01T00:00:00Z"


def _text(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _member(key: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f'"{key}":'), value)


def _object(*members: Column) -> Column:
    """JSON object text of the members that are not NULL."""
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, id, body``: one description per customer."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    k = F.col("c_custkey")
    case = lambda n: k % n
    context = (
        F.when(case(4) == 0, f'"{CONTEXT_V10}"')
        .when(case(4) == 1, f'["{CONTEXT_V10}",{{"ex":"http://ex/"}}]')
        .when(case(4) == 2, f'"{CONTEXT_V11}"')
    )
    legacy_defs = '{"@none":{"scheme":"nosec","x":1},"basic_sc":{"td:scheme":"basic"}}'
    plain_defs = '{"basic_sc":{"scheme":"basic","in":"header"}}'
    oauth_defs = (
        '{"basic_sc":{"scheme":"basic"},"oauth_sc":{"scheme":"oauth2","flow":"code",'
        '"token":"https://auth.example/token"}}'
    )
    defs = (
        F.when(case(4) == 0, legacy_defs).when(case(6) == 5, oauth_defs).otherwise(plain_defs)
    )
    href = lambda name: _text(
        F.concat(F.lit("https://x.example/"), k, F.lit(f"/{name}"))
    )
    balance = _object(
        _member("type", '"number"'),
        _member("unit", '"USD"'),
        _member("const", F.col("c_acctbal").cast("decimal(18,2)").cast("string")),
        _member(
            "forms", F.concat(F.lit("["), _object(_member("href", href("balance"))), F.lit("]"))
        ),
    )
    form = _object(
        _member("href", href("segment")),
        _member("op", F.when(case(9) == 0, '["invokeAction"]').otherwise('["readProperty"]')),
    )
    segment = _object(
        _member("type", '"string"'),
        _member("enum", F.concat(F.lit("["), _text(F.col("c_mktsegment")), F.lit(',"OTHER"]'))),
        _member(
            "forms", F.when(case(10) == 3, "[]").otherwise(F.concat(F.lit("["), form, F.lit("]")))
        ),
    )
    body = _object(
        _member("@context", context),
        _member("@type", F.when(case(3) == 0, '"Thing"').when(case(3) == 1, '["Device"]')),
        _member("id", _text(F.concat(F.lit("urn:customer:"), k))),
        F.when(
            case(50) != 7,
            F.concat(
                F.when(case(4) < 2, '"td:title":').otherwise('"title":'), _text(F.col("c_name"))
            ),
        ),
        _member("description", _text(F.concat(F.col("c_mktsegment"), F.lit(" account")))),
        F.when(
            case(2) == 0,
            F.concat(
                F.lit('"hasSecurityConfiguration":'),
                F.when(case(5) == 0, '"missing_sc"').otherwise('"basic_sc"'),
            ),
        ).otherwise('"security":["basic_sc"]'),
        _member("securityDefinitions", defs),
        _member("properties", _object(_member("balance", balance), _member("segment", segment))),
        _member("nation", F.col("c_nationkey").cast("string")),
        _member("registration", '{"id":"_:b0","created":"2024-01-01T00:00:00Z"}'),
        F.when(case(11) == 4, '"created":"yesterday"'),
    )
    return c.select(k.alias("k"), F.concat(F.lit("urn:customer:"), k).alias("id"), body.alias("body"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, op, id, body, ts``: each event of a user as an operation on their description."""
    return as_operations(spread(spark.read.parquet(f"{sf_dir}/events.parquet")))


def as_operations(e: DataFrame) -> DataFrame:
    """Operations from rows of the events table; works on a stream as well."""
    kind, id_ = F.col("event_type"), F.concat(F.lit("urn:user:"), "user_id")
    k = F.get_json_object("props", "$.k")
    value = F.to_json(F.col("value").cast("variant"))
    whole = _object(
        _member("id", _text(id_)), _member("k", k), _member("v", value), _member("src", _text(kind))
    )
    body = (
        F.when(kind.isin("signup", "purchase"), whole)
        .when(kind == "click", _object(_member("k", k)))
        .when((kind == "view") & (F.col("event_id") % 5 == 0), '{"k":null}')
        .when(kind == "view", _object(_member("v", value)))
    )
    op = (
        F.when(kind.isin("signup", "purchase"), "PUT")
        .when(kind == "error", "DELETE")
        .otherwise("PATCH")
    )
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), id_.alias("id"), body.alias("body"), "ts")


ACCOUNT, PLACE = "https://account.example/ns#", "https://place.example/"


def extended_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, body``: a description per customer with members of two vocabularies of its own.

    Every third context redefines the second prefix, so the same member means another address there; a term has a
    type of its own, and nested nodes hold further members.
    """
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    k = F.col("c_custkey")
    context = F.concat(
        F.lit(f'["{CONTEXT_V11}",{{"acc":"{ACCOUNT}","at":"{PLACE}old/","tier":"acc:tier","owner":{{"@id":"acc:owner","@type":"@id"}},'),
        F.lit('"since":{"@id":"acc:since","@type":"xsd:date"}}'),
        F.when(k % 3 == 0, f',{{"at":"{PLACE}"}}').otherwise(""),
        F.lit("]"),
    )
    place = _object(_member("@type", '"at:Place"'), _member("at:nation", F.col("c_nationkey").cast("string")), _member("unknown", "1"))
    body = _object(
        _member("@context", context),
        _member("id", _text(F.concat(F.lit("urn:account:"), k))),
        _member("title", _text(F.col("c_name"))),
        _member("acc:balance", F.col("c_acctbal").cast("decimal(18,2)").cast("string")),
        _member("acc:open", F.when(k % 2 == 0, "true").otherwise("false")),
        _member("tier", _text(F.col("c_mktsegment"))),
        _member("owner", _text(F.concat(F.lit("acc:person/"), k))),
        _member("since", _text(F.lit("2024-01-01"))),
        F.when(k % 5 != 0, _member("at:place", place)),
        _member("acc:tags", F.concat(F.lit('["a","'), k % 7, F.lit('"]'))),
        _member("nobody:knows", "5"),
        _member("stray", '"x"'),
    )
    return c.select(F.concat(F.lit("urn:account:"), k).alias("id"), body.alias("body"))

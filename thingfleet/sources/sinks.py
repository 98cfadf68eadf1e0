"""Result sinks: solution tables, graph results and event frames as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.triples import ntriples
from ..schema import QUAD_COLS

SOLUTION_FORMATS = ("json", "xml", "csv", "tsv")


def write_results(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write solutions as json, xml, csv or tsv, and quads as nt.

    A table of quads is a graph result and is always written as N-Triples.
    """
    if set(QUAD_COLS[1:5]) <= set(df.columns):
        fmt = "nt"
    if fmt == "nt":
        rows = df
        for c in QUAD_COLS:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        ntriples(rows).write.mode(mode).text(path)
    elif fmt == "json":
        # an unbound variable is absent from its row
        df.write.mode(mode).json(path, ignoreNullFields=True)
    elif fmt in ("csv", "tsv"):
        df.write.mode(mode).csv(path, header=True, sep="," if fmt == "csv" else "\t", escape='"')
    elif fmt == "xml":
        df.write.mode(mode).format("xml").option("rootTag", "results").option(
            "rowTag", "result"
        ).save(path)
    else:
        raise ValueError(f"format must be nt or one of {', '.join(SOLUTION_FORMATS)}")


def binding(columns: dict[str, str]) -> Column:
    """A solution in the shape ``{"x": {"type": ..., "value": ...}}``, unbound variables absent.

    ``columns`` maps each variable to its term type: uri, literal or bnode.
    """
    entries = [
        F.when(
            F.col(c).isNotNull(),
            F.struct(
                F.lit(c).alias("key"),
                F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("value")).alias("value"),
            ),
        )
        for c, t in columns.items()
    ]
    return F.to_json(F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def choose_format(query_type: str, wanted: str | None) -> str:
    """The format of a result: graphs are N-Triples, tables what was asked for, else json."""
    if query_type in ("construct", "describe"):
        return "nt"
    if query_type not in ("select", "ask"):
        raise ValueError(f"unknown kind of query {query_type}")
    fmt = wanted or "json"
    if fmt not in SOLUTION_FORMATS:
        raise ValueError(f"format must be one of {', '.join(SOLUTION_FORMATS)}")
    return fmt

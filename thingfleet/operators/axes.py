"""Documents in XML form: numbered elements, steps along axes, and the XML text.

A member is an element of its name, an item of an array is an element of the array's name, and the document
is the element ``ObjectNode``. ``@`` is left out of names; what no name may hold is written ``_xHHHH_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import documents as D
from .nodes import flatten

ROOT = "ObjectNode"
COLUMNS = ["id", "pre", "last", "level", "above", "name", "value"]
#: Axes along which a position can be asked for.
COUNTED = ("child", "following-sibling", "preceding-sibling", "descendant", "self", "parent")


def xml_name(key: Column) -> Column:
    """The element name of a member."""
    plain = F.replace(key, F.lit("@"), F.lit(""))
    escaped = F.array_join(
        F.transform(
            F.filter(F.split(plain, ""), lambda c: c != ""),
            lambda c: F.when(c.rlike(r"[\p{L}\p{Nd}_.\-]"), c).otherwise(
                F.concat(F.lit("_x"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit("_"))
            ),
        ),
        "",
    )
    return F.when(escaped.rlike(r"^[\p{L}_]"), escaped).otherwise(F.concat(F.lit("_"), escaped))


def elements(docs: DataFrame, doc: str = "doc", parts: int | None = None) -> DataFrame:
    """One row per element of the documents in column ``doc``, keyed by the distinct ``id``.

    ``pre`` counts elements in document order (members in the order of their keys), ``last`` is the number of
    the last element inside, ``above`` that of the parent, ``value`` the text of an element without elements.
    Documents that are no objects have no elements. Numbers are given inside one document.

    Only whole documents are shuffled, to ``parts`` parts by their ids; elements stay where they are made.
    """
    objects = docs.where(D.kind_of(F.col(doc)) == "object").select("id", doc)
    dealt = objects.repartition("id") if parts is None else objects.repartition(parts, "id")
    nodes = flatten(dealt, doc).where("kind <> 'array'")
    key_at = F.array_max(F.transform("ord", lambda s, i: F.when(s["pos"] < 0, i).otherwise(-1)))
    level = F.size(F.filter("ord", lambda s: s["pos"] < 0))
    rows = nodes.select(
        "id",
        "ord",
        level.alias("level"),
        F.coalesce(xml_name(F.get("ord", key_at)["key"]), F.lit(ROOT)).alias("name"),
        F.when(F.col("kind") == "string", F.col("v_str"))
        .when(F.col("kind") == "null", "")
        .otherwise(F.col("leaf"))
        .alias("value"),
    )
    # an element ends after all that begin inside it
    ends = F.array_append("ord", F.struct(F.lit(2**31 - 1).alias("pos"), F.lit("").alias("key")))
    rows = rows.withColumn("pre", F.row_number().over(Window.partitionBy("id").orderBy("ord")))
    rows = rows.withColumn("post", F.row_number().over(Window.partitionBy("id").orderBy(ends))).drop("ord")
    # the parent is the last element before that is one level higher: each element stands at its own level to be
    # found and at the one above to look, so nothing is joined and all windows share the shuffle by document
    rows = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("__own"))
    rows = rows.withColumn("__at", F.col("level") - (~F.col("__own")).cast("int"))
    before = Window.partitionBy("id", "__at").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("__own"), F.col("pre")), ignorenulls=True).over(before)
    return rows.withColumn("above", above).where("NOT __own").select(
        "id", "pre", (F.col("post") + F.col("level")).alias("last"), "level", "above", "name", "value"
    )


def roots(table: DataFrame) -> DataFrame:
    """The document elements, where a path begins."""
    return table.where("level = 0")


def step(
    context: DataFrame,
    table: DataFrame,
    axis: str,
    name: str | None = None,
    test: Column | None = None,
    position: int | None = None,
) -> DataFrame:
    """The elements of ``table`` along ``axis`` of those in ``context``, each once.

    ``name`` and ``test`` (over the columns of :func:`elements`) choose among them; ``position`` counts the
    chosen ones from each element of the context, backwards for ``preceding-sibling``. Every axis is a window
    over the numbers of one document: no pairs of elements are made. Over a table in buckets of ``id``
    (``session.kept_by``) nothing shuffles.
    """
    if position is not None and (axis not in COUNTED or position < 1):
        raise ValueError(f"no position {position} along {axis}")
    chosen = F.coalesce(test, F.lit(False)) if test is not None else F.lit(True)
    if name is not None:
        chosen = chosen & (F.col("name") == name)
    if axis in ("self", "parent"):
        wanted = context.select("id", F.col("pre" if axis == "self" else "above").alias("pre"))
        out = _told(table.where(chosen), wanted, ["id", "pre"]).where("__c")
        return (out if position in (None, 1) else out.where("false")).select(*COLUMNS)

    document, family = Window.partitionBy("id"), Window.partitionBy("id", "above")
    if axis == "child":
        found = _told(table.where(chosen), context.select("id", F.col("pre").alias("above")), ["id", "above"]).where("__c")
        if position is not None:
            found = found.withColumn("__k", F.row_number().over(family.orderBy("pre"))).where(F.col("__k") == position)
        return found.select(*COLUMNS)
    # what is neither chosen nor in the context changes no answer
    marked = _told(table.select(*COLUMNS, chosen.alias("__t")), context.select("id", "pre"), ["id", "pre"]).where("__t or __c")
    if position is not None:
        return _counted(marked, axis, position)
    here = lambda c: F.when(F.col("__c"), F.col(c))
    before = document.orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    after = document.orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    if axis == "following-sibling":
        hit = F.col("pre") > F.min(here("pre")).over(family)
    elif axis == "preceding-sibling":
        hit = F.col("pre") < F.max(here("pre")).over(family)
    elif axis == "following":
        hit = F.col("pre") > F.min(here("last")).over(document)
    elif axis == "preceding":
        hit = F.col("last") < F.max(here("pre")).over(document)
    elif axis in ("descendant", "descendant-or-self"):
        hit = F.col("pre") <= F.max(here("last")).over(before)
    elif axis in ("ancestor", "ancestor-or-self"):
        hit = F.col("last") >= F.min(here("pre")).over(after)
    else:
        raise ValueError(f"no axis {axis}")
    if axis.endswith("-or-self"):
        hit = F.coalesce(hit, F.lit(False)) | F.col("__c")
    return marked.withColumn("__hit", hit).where("__hit and __t").select(*COLUMNS)


def _told(rows: DataFrame, asked: DataFrame, keys: list[str], value: Column | None = None) -> DataFrame:
    """``rows`` with ``__c``: whether ``asked`` has their ``keys`` (none NULL), or the greatest ``value`` it has there.

    Both stand in one window. A join on more than ``id`` would shuffle rows that lie in buckets of ``id``, or broadcast
    elements by the size of their files, which are many times larger in memory.
    """
    kept = rows.select("*", F.lit(True).alias("__own"))
    said = (F.lit(True) if value is None else value).alias("__said")
    known = asked.select(*keys, said, F.lit(False).alias("__own")).dropna(subset=keys)
    found = F.max("__said").over(Window.partitionBy(*keys))
    found = found if value is not None else F.coalesce(found, F.lit(False))
    return kept.unionByName(known, allowMissingColumns=True).withColumn("__c", found).where("__own").drop("__own", "__said")


def _counted(marked: DataFrame, axis: str, position: int) -> DataFrame:
    """The ``position``-th chosen element from each element of the context: running counts of the chosen ones say
    which number it has, so contexts meet their elements by equal numbers."""
    keys = ["id"] if axis == "descendant" else ["id", "above"]
    so_far = Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("__k", F.sum(F.col("__t").cast("long")).over(so_far))
    if axis == "preceding-sibling":
        wanted = F.col("__k") - F.col("__t").cast("long") - position + 1
    else:
        wanted = F.col("__k") + position
    asked = counted.where("__c").select(*keys, wanted.alias("__k"), F.col("last").alias("__last")).where("__k > 0")
    found = _told(counted.where("__t").drop("__c"), asked, [*keys, "__k"], F.col("__last")).where("__c is not null")
    return (found.where("pre <= __c") if axis == "descendant" else found).select(*COLUMNS)


def path(table: DataFrame, *steps: tuple) -> DataFrame:
    """Steps one after another from the document elements; each is the arguments of :func:`step` from ``axis`` on."""
    found = roots(table)
    for one in steps:
        found = step(found, table, *one)
    return found


def to_xml(table: DataFrame) -> DataFrame:
    """``id, xml`` of every document of ``table``; a group is one document and holds only its elements."""
    said = F.regexp_replace(F.coalesce("value", F.lit("")), r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]", "�")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        said = F.replace(said, F.lit(sign), F.lit(entity))
    opened = F.struct(
        F.col("pre").alias("at"), F.lit(0).alias("end"), F.lit(0).alias("deep"),
        F.concat(F.lit("<"), "name", F.lit(">"), said).alias("text"),
    )
    # closing tags stand after the last element inside, the deepest first
    closed = F.struct(
        F.col("last").alias("at"), F.lit(1).alias("end"), (-F.col("level")).alias("deep"),
        F.concat(F.lit("</"), "name", F.lit(">")).alias("text"),
    )
    tags = table.select("id", F.explode(F.array(opened, closed)).alias("tag"))
    parts = F.transform(F.sort_array(F.collect_list("tag")), lambda t: t["text"])
    return tags.groupBy("id").agg(F.array_join(parts, "").alias("xml"))

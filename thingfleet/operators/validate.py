"""Shape validation over quads: every rule of every shape in a few grouped passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..session import cut
from ..sources.rules import BOTH, CORRECTED, Rule
from ..vocab import LANG_STRING, RDF_TYPE, XSD

VALUE_KINDS = ("datatype", "datatypeIn", "nodeKind", "in", "reference")
COUNT_KINDS = ("minCount", "maxCount", "exactlyOneOf")


def label(path: tuple[str, ...]) -> str:
    """A path as text; alternatives are joined by a bar."""
    return "|".join(path)


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Rules as a broadcast side: as many rows as the rule list spells out."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _well_formed(o: Column, dt: Column) -> Column:
    """Whether the text of a literal fits its datatype."""
    return (
        F.when(dt == XSD + "boolean", o.isin("true", "false", "1", "0"))
        .when(dt == XSD + "dateTime", o.try_cast("timestamp").isNotNull() & o.contains("T"))
        .when(dt == XSD + "integer", o.rlike(r"^[+-]?\d+$"))
        .when(
            dt == XSD + "unsignedInt",
            F.coalesce(
                o.rlike(r"^\+?\d+$") & o.try_cast("decimal(38,0)").between(0, 4294967295),
                F.lit(False),
            ),
        )
        .when(dt == XSD + "double", o.try_cast("double").isNotNull())
        .when(dt == XSD + "anyURI", ~o.rlike(r'[\s<>"{}|\\^`]'))
        .otherwise(True)
    )


def _has_datatype(dt: Column) -> Column:
    """The value is a well-formed literal of datatype ``dt``."""
    own = F.when(F.col("o_lang").isNotNull(), LANG_STRING).otherwise(
        F.coalesce("o_dt", F.lit(XSD + "string"))
    )
    tagged = (dt != LANG_STRING) | F.col("o_lang").isNotNull()
    return (F.col("o_kind") == "literal") & (own == dt) & tagged & _well_formed(F.col("o"), dt)


def _is_address(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def _passes() -> Column:
    kind, arg, listed = F.col("kind"), F.col("arg_str"), F.col("arg_list")
    any_uri = _has_datatype(F.lit(XSD + "anyURI"))
    return F.coalesce(
        F.when(kind == "datatype", _has_datatype(arg))
        .when(kind == "datatypeIn", F.array_contains(listed, F.col("o_dt")) & _has_datatype(F.col("o_dt")))
        .when(kind == "nodeKind", F.col("o_kind") == arg)
        # an address of the list is no text, and the other way round
        .when(kind == "in", F.array_contains(listed, F.col("o")) & (_is_address(F.col("o")) == (F.col("o_kind") == "iri")))
        .when(kind == "reference", (F.col("o_kind") == "iri") | any_uri),
        F.lit(False),
    )


def members(quads: DataFrame, rules: list[Rule]) -> DataFrame:
    """Which shapes apply to which nodes: ``g, node, shape, is_target``.

    A node is a target by its class, or a candidate because a rule sends the values of some
    predicate to a nested shape.
    """
    spark = quads.sparkSession
    classes = sorted({(r.target_class, r.shape) for r in rules if r.target_class})
    targets = (
        quads.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*sorted({c for c, _ in classes})))
        .join(_table(spark, classes, "o string, shape string"), "o")
        .select("g", F.col("s").alias("node"), "shape", F.lit(True).alias("is_target"))
    )
    nested = sorted({(p, r.node_shape) for r in rules if r.kind == "node" for p in r.path})
    if nested:
        reached = (
            quads.where(F.col("p").isin(*sorted({p for p, _ in nested})))
            .join(_table(spark, nested, "p string, shape string"), "p")
            .select("g", F.col("o").alias("node"), "shape", F.lit(False).alias("is_target"))
        )
        targets = targets.unionByName(reached)
    return targets.groupBy("g", "node", "shape").agg(F.max("is_target").alias("is_target"))


def _value_violations(quads: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """Rows that break a rule about single values, before asking whose shape it is."""
    rows = [
        (p, r.shape, label(r.path), r.kind, r.arg_str, list(r.arg_list) if r.arg_list else None)
        for r in rules
        if r.kind in VALUE_KINDS
        for p in r.path
    ]
    if not rows:
        return None
    table = _table(
        quads.sparkSession,
        rows,
        "p string, shape string, path string, kind string, arg_str string, arg_list array<string>",
    )
    wrong = quads.where(F.col("p").isin(*sorted({r[0] for r in rows}))).join(table, "p").where(~_passes())
    return wrong.select(
        "g",
        F.col("s").alias("node"),
        "shape",
        "path",
        F.col("kind").alias("constraint"),
        F.col("o").alias("value"),
    )


def _lang_violations(quads: DataFrame, rules: list[Rule]) -> DataFrame | None:
    rows = [(p, r.shape, label(r.path)) for r in rules if r.kind == "uniqueLang" for p in r.path]
    if not rows:
        return None
    table = _table(quads.sparkSession, rows, "p string, shape string, path string")
    repeated = (
        quads.where(F.col("p").isin(*sorted({r[0] for r in rows})) & F.col("o_lang").isNotNull())
        .groupBy("g", "s", "p", F.lower("o_lang").alias("tag"))
        .count()
        .where("count > 1")
    )
    return repeated.join(table, "p").select(
        "g",
        F.col("s").alias("node"),
        "shape",
        "path",
        F.lit("uniqueLang").alias("constraint"),
        F.col("tag").alias("value"),
    )


def _count_violations(quads: DataFrame, who: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """Too few or too many values, absent ones included.

    Values are counted per node and predicate first (map-side combined, so a node with very many
    values is no heavier than others); a second grouping brings the few counts of a node together
    with its shapes. Both lists are bounded by the rule table, not by the data.
    """
    counted = [r for r in rules if r.kind in COUNT_KINDS]
    if not counted:
        return None
    spark = quads.sparkSession
    used = sorted({p for r in counted for p in r.path})
    counts = (
        quads.where(F.col("p").isin(*used))
        .groupBy("g", F.col("s").alias("node"), "p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    facts = counts.select("g", "node", "p", "n", F.lit(None).cast("string").alias("shape"))
    facts = facts.unionByName(
        who.where(F.col("shape").isin(*sorted({r.shape for r in counted}))).select(
            "g",
            "node",
            F.lit(None).cast("string").alias("p"),
            F.lit(None).cast("bigint").alias("n"),
            "shape",
        )
    )
    per_node = facts.groupBy("g", "node").agg(
        F.collect_set("shape").alias("shapes"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "n")))
        ).alias("have"),
    )
    by_shape: dict[str, list[tuple]] = {}
    for r in counted:
        by_shape.setdefault(r.shape, []).append((list(r.path), r.kind, r.arg_num, label(r.path)))
    table = _table(
        spark,
        list(by_shape.items()),
        "shape string, rules array<struct<path:array<string>,kind:string,n:bigint,label:string>>",
    )
    have = F.col("have")
    number = lambda p: F.coalesce(F.try_element_at(have, p), F.lit(0))

    def broken(r: Column) -> Column:
        total = F.aggregate(r["path"], F.lit(0).cast("bigint"), lambda a, p: a + number(p))
        enough = F.size(F.filter(r["path"], lambda p: number(p) >= r["n"]))
        present = F.size(F.filter(r["path"], lambda p: number(p) > 0))
        return (
            F.when(r["kind"] == "minCount", total < r["n"])
            .when(r["kind"] == "maxCount", total > r["n"])
            .otherwise((enough != 1) | (present != 1))
        )

    return (
        per_node.where(F.size("shapes") > 0)
        .select("g", "node", F.explode("shapes").alias("shape"), "have")
        .join(table, "shape")
        .select("g", "node", "shape", F.explode(F.filter("rules", broken)).alias("r"))
        .select(
            "g",
            "node",
            "shape",
            F.col("r.label").alias("path"),
            F.col("r.kind").alias("constraint"),
            F.lit(None).cast("string").alias("value"),
        )
    )


def _report(found: DataFrame) -> DataFrame:
    """Violations in report form."""
    text = F.concat_ws(
        " ", F.col("constraint"), F.lit("violated at"), F.col("path"), F.concat(F.lit("by "), "value")
    )
    return found.select(
        "g",
        F.col("node").alias("focus_node"),
        "shape",
        "path",
        "constraint",
        "value",
        text.alias("message"),
    )


def validate(
    quads: DataFrame, rules: list[Rule], profile: str = CORRECTED, nested: bool = False
) -> DataFrame:
    """All violations: ``g, focus_node, shape, path, constraint, value, message``.

    ``quads`` is a set (see :func:`dedup`). Rules of another profile are left out. A value that
    breaks a nested shape counts once against its parent, as a ``node`` violation; the failures
    inside it are added with ``nested=True``.
    """
    rules = [r for r in rules if r.profile in (BOTH, profile)]
    who = members(quads, rules)
    parts = [
        part.join(who.select("g", "node", "shape"), ["g", "node", "shape"])
        for part in (_value_violations(quads, rules), _lang_violations(quads, rules))
        if part is not None
    ]
    counted = _count_violations(quads, who, rules)
    if counted is not None:
        parts.append(counted)
    if not parts:
        raise ValueError("no rule to check in this profile")
    columns = ["g", "node", "shape", "path", "constraint", "value"]
    found = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    node_rules = [
        (p, r.node_shape, r.shape, label(r.path))
        for r in rules
        if r.kind == "node"
        for p in r.path
    ]
    if node_rules:
        found = _with_nested(quads, who, found, node_rules)
    if not nested:
        found = found.join(
            who.where("is_target").select("g", "node", "shape"), ["g", "node", "shape"]
        )
    return _report(found)


def _with_nested(
    quads: DataFrame, who: DataFrame, found: DataFrame, node_rules: list[tuple]
) -> DataFrame:
    """Carry failures of nested shapes up to the nodes that refer to them.

    Only failing nodes travel. A round looks at those that failed for the first time in the round
    before, so shapes that refer to themselves end as well.
    """
    table = _table(
        quads.sparkSession,
        node_rules,
        "p string, bad string, shape string, path string",
    )
    links = quads.where(F.col("p").isin(*sorted({r[0] for r in node_rules}))).select(
        "g", "s", "p", "o"
    )
    found = cut(found)
    failing = cut(found.select("g", "node", "shape").distinct())
    seen, parts = [failing], [found]
    columns = found.columns
    while not failing.isEmpty():
        bad = failing.select("g", F.col("node").alias("o"), F.col("shape").alias("bad"))
        up = (
            links.join(bad, ["g", "o"])
            .join(table, ["p", "bad"])
            .select(
                "g",
                F.col("s").alias("node"),
                "shape",
                "path",
                F.lit("node").alias("constraint"),
                F.col("o").alias("value"),
            )
            .join(who.select("g", "node", "shape"), ["g", "node", "shape"])
            .select(*columns)
            .distinct()
        )
        up = cut(up)
        parts.append(up)
        known = reduce(DataFrame.unionByName, seen)
        failing = cut(
            up.select("g", "node", "shape")
            .distinct()
            .join(known, ["g", "node", "shape"], "left_anti")
        )
        seen.append(failing)
    return reduce(DataFrame.unionByName, parts).distinct()


def verdict(graphs: DataFrame, violations: DataFrame) -> DataFrame:
    """``g, conforms, n`` for every graph in ``graphs`` (column ``g``)."""
    counts = violations.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return (
        graphs.select("g")
        .distinct()
        .join(counts, "g", "left")
        .select("g", F.col("n").isNull().alias("conforms"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def apply_defaults(wide: DataFrame, values: dict[str, str]) -> DataFrame:
    """Fill absent members of a table with one column per member."""
    return wide.select(
        *[
            F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c)
            for c in wide.columns
        ]
    )


# ---------------------------------------------------------------- further rules, off by default

_AFFORDANCE_OPS = {
    "hasPropertyAffordance": ("readProperty", "writeProperty", "observeProperty", "unobserveProperty"),
    "hasActionAffordance": ("invokeAction", "queryAction", "cancelAction"),
    "hasEventAffordance": ("subscribeEvent", "unsubscribeEvent"),
}
_THING_OPS = (
    "readAllProperties", "writeAllProperties", "readMultipleProperties", "writeMultipleProperties",
    "observeAllProperties", "unobserveAllProperties", "subscribeAllEvents", "unsubscribeAllEvents",
    "queryAllActions",
)


def check_operations(quads: DataFrame, td: str) -> DataFrame:
    """Operations of a form that do not suit the kind of thing part the form belongs to."""
    forms = quads.where(F.col("p") == td + "hasForm").select(
        "g", F.col("s").alias("owner"), F.col("o").alias("form")
    )
    owners = quads.where(F.col("p").isin(*[td + k for k in _AFFORDANCE_OPS])).select(
        "g", F.col("o").alias("owner"), F.col("p").alias("role")
    )
    ops = quads.where(F.col("p").endswith("hypermedia#hasOperationType")).select(
        "g", F.col("s").alias("form"), F.col("o").alias("op")
    )
    allowed = [
        (td + role, [td + o for o in names]) for role, names in _AFFORDANCE_OPS.items()
    ] + [("thing", [td + o for o in _THING_OPS])]
    table = _table(quads.sparkSession, allowed, "role string, allowed array<string>")
    placed = (
        ops.join(forms, ["g", "form"])
        .join(owners, ["g", "owner"], "left")
        .withColumn("role", F.coalesce("role", F.lit("thing")))
        .join(table, "role")
    )
    bad = placed.where(~F.array_contains("allowed", F.col("op")))
    return _report(
        bad.select(
            "g",
            F.col("form").alias("node"),
            F.lit("Form").alias("shape"),
            F.lit("hctl:hasOperationType").alias("path"),
            F.lit("operationKind").alias("constraint"),
            F.col("op").alias("value"),
        )
    )


def check_oauth(quads: DataFrame, wotsec: str) -> DataFrame:
    """OAuth2: the code flow needs authorization and token, client needs token and no authorization."""
    names = {k: wotsec + k for k in ("flow", "authorization", "token")}
    wide = (
        quads.where(F.col("p").isin(*names.values()))
        .groupBy("g", F.col("s").alias("node"))
        .agg(*[F.max(F.when(F.col("p") == p, F.col("o"))).alias(k) for k, p in names.items()])
    )
    problem = (
        F.when((F.col("flow") == "code") & F.col("authorization").isNull(), "authorizationRequired")
        .when(
            F.col("flow").isin("code", "client") & F.col("token").isNull(), "tokenRequired"
        )
        .when((F.col("flow") == "client") & F.col("authorization").isNotNull(), "authorizationForbidden")
    )
    return _report(
        wide.withColumn("constraint", problem)
        .where("constraint is not null")
        .select(
            "g",
            "node",
            F.lit("OAuth2SecurityScheme").alias("shape"),
            F.lit("wotsec:flow").alias("path"),
            "constraint",
            F.col("flow").alias("value"),
        )
    )


def check_language_tags(quads: DataFrame) -> DataFrame:
    """Language tags that are not well-formed."""
    bad = quads.where(F.col("o_lang").isNotNull() & ~F.col("o_lang").rlike(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"))
    return _report(
        bad.select(
            "g", F.col("s").alias("node"), F.lit("MultiLanguage").alias("shape"),
            F.col("p").alias("path"), F.lit("languageTag").alias("constraint"),
            F.col("o_lang").alias("value"),
        )
    )


def check_auto_name(quads: DataFrame, wotsec: str) -> DataFrame:
    """The automatic security scheme must not carry a name."""
    auto = quads.where(
        (F.col("p") == RDF_TYPE) & (F.col("o") == wotsec + "AutoSecurityScheme")
    ).select("g", "s")
    bad = quads.where(F.col("p") == wotsec + "name").join(auto, ["g", "s"], "left_semi")
    return _report(
        bad.select(
            "g", F.col("s").alias("node"), F.lit("AutoSecurityScheme").alias("shape"),
            F.lit("wotsec:name").alias("path"), F.lit("nameForbidden").alias("constraint"),
            F.col("o").alias("value"),
        )
    )


def check_context(docs: DataFrame, context: str) -> DataFrame:
    """Documents (``id`` and top-level fields ``m``) whose context lacks the given address."""


    value = F.try_element_at("m", F.lit("@context"))
    listed = F.transform(D.items(value), D.text_of)
    ok = (D.text_of(value) == context) | F.array_contains(listed, context)
    return docs.where(~F.coalesce(ok, F.lit(False))).select("id", F.lit("contextRequired").alias("constraint"))


def check_uri_variables(nodes: DataFrame) -> DataFrame:
    """Template variable names used both on a document and on one of its parts."""
    named = nodes.where(
        (F.size("parent") > 0) & (D.at("parent", -1) == ".uriVariables")
    ).select("id", "key", (F.size("parent") == 1).alias("own"))
    return (
        named.groupBy("id", "key")
        .agg(F.max("own").alias("on_thing"), F.min("own").alias("only_thing"))
        .where("on_thing and not only_thing")
        .select("id", "key", F.lit("variableRepeated").alias("constraint"))
    )


def response_content_type(forms: DataFrame) -> DataFrame:
    """The content type of a response, the form's own where the response names none.

    ``forms`` has ``form_type`` and ``response_type``.
    """
    return forms.withColumn(
        "response_type", F.coalesce("response_type", "form_type", F.lit("application/json"))
    )


def resolve_security(quads: DataFrame, td: str) -> DataFrame:
    """Each security name with the definition of the same document it stands for.

    ``g, s, name, definition``; an unresolved name has no definition.
    """
    used = quads.where(F.col("p") == td + "hasSecurityConfiguration").select(
        "g", "s", F.col("o").alias("name")
    )
    defined = quads.where(F.col("p") == td + "hasInstanceConfiguration").select(
        "g", F.col("o").alias("name"), F.col("s").alias("definition")
    )
    return used.join(defined, ["g", "name"], "left").select("g", "s", "name", "definition")

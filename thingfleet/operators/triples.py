"""Documents to quads and back, over the device description vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contexts as C
from ..functions import documents as D
from ..schema import QUAD_COLS
from ..session import cut
from .nodes import FAST_LEVELS, STEP
from ..vocab import (
    DEFAULT_NAME_PREDICATE,
    GRAPH_PREFIX,
    LANG_STRING,
    NAME_PREDICATE,
    PREFIXES,
    RDF,
    RDF_TYPE,
    SCHEMA_TYPES,
    SECURITY_SCHEMES,
    TD,
    TERMS,
    XSD,
    iri,
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map_text(pairs: dict[str, str]) -> str:
    """A constant map as SQL text."""
    return "map(" + ", ".join(_quoted(x) for kv in pairs.items() for x in kv) + ")"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.expr(_map_text(pairs))


def _transitions() -> dict[str, str | None]:
    """State of a JSON value from the state of the object around it and its key, for every key known there."""
    out: dict[str, str | None] = {}
    for context, terms in TERMS.items():
        for key, (_, spec) in terms.items():
            out[f"{context}.{key}"] = None
            if spec[0] == ">":
                out[f"{context}.{key}"] = spec[1:]
            elif spec[0] == "*":
                out[f"{context}.{key}"] = "map:" + spec[1:]
            elif spec == "texts":
                out[f"{context}.{key}"] = "texts"
    return out


def _label(at: str) -> str:
    """The name of a node: the document's id for its root, else one that is stable for its place."""
    return f"if({at} = '', id, concat('_:', sha1(concat(id, '|', {at}))))"


_KNOWN = ["state", "owner", "term", "name", "at", "mine", "mine_type"]
# The entry of members that a document's own context explains, and the kind of node they lead to.
_MINE, _OWN_NODE = "*", "Own"


def _fresh(state: str, key: str, known: str) -> str:
    """SQL text: the predicate that the document's own terms give a key of a node that is not ``known``."""
    return f"CASE WHEN {state} IS NOT NULL AND NOT ({known}) THEN {C.expand_key('__terms', key)} END"


def _inside(state: str, item: str) -> tuple[str, str, str]:
    """SQL text: whether the value around a child is a map, a text table, or keeps the child in its own role."""
    in_map, in_texts = f"startswith({state}, 'map:')", f"{state} = 'texts'"
    return in_map, in_texts, f"{item} OR {in_map} OR {in_texts}"


def _advance(cur: str, item: str, key: str, step: str, found: str, known: str, fresh: str, inside: tuple[str, str, str]) -> dict[str, str]:
    """What is known of a child, from what is known of the value around it, as SQL text.

    ``state`` is the kind of node the value is, or the map or text table it is; ``owner`` and
    ``term`` are the node it belongs to and the vocabulary entry there; ``name`` its key in a map;
    ``at`` its place; ``mine`` the predicate, and ``mine_type`` the type of values, that the document's own
    terms give a member the vocabulary does not know. The child is an array ``item`` or has a ``key``;
    ``found`` is the state the vocabulary gives the child of a node, ``known`` whether it has the key, ``fresh`` what
    the document's terms give the key, ``inside`` what :func:`_inside` tells.
    """
    state, owner, term, name, at, mine, mine_type = (f"{cur}{c}" for c in _KNOWN)
    in_map, in_texts, same = inside
    return {
        "state": f"CASE WHEN {item} THEN {state} WHEN {in_map} THEN substr({state}, 5) "
        f"WHEN {in_texts} THEN NULL WHEN {known} THEN {found} WHEN {fresh} IS NOT NULL THEN '{_OWN_NODE}' END",
        "owner": f"CASE WHEN {same} THEN {owner} WHEN {state} IS NOT NULL THEN {_label(at)} END",
        "term": f"CASE WHEN {same} THEN {term} WHEN {fresh} IS NOT NULL THEN '{_MINE}' ELSE concat({state}, '.', {key}) END",
        "name": f"CASE WHEN {item} THEN {name} WHEN {in_map} OR {in_texts} THEN {key} END",
        "at": f"concat({at}, '/', {step})",
        "mine": f"CASE WHEN {same} THEN {mine} ELSE {fresh} END",
        "mine_type": f"CASE WHEN {same} THEN {mine_type} ELSE {C.value_type('__terms', key)} END",
    }


def triplify(docs: DataFrame, doc: str = "doc", prefix: str = GRAPH_PREFIX) -> DataFrame:
    """Quads of each document (``id`` and a VARIANT column), one graph per document.

    The document is taken apart level by level in one pass; each level looks up its keys in the
    vocabulary (a fixed table, broadcast). A key it does not know counts by the terms and prefixes that the
    document's own context defines, which travel with its rows; keys known to neither are dropped. Nothing
    shuffles until the set is made distinct. Nested nodes are blank nodes named after their place.
    """
    spark = docs.sparkSession
    table = _transitions()
    words = F.broadcast(spark.createDataFrame(list(table.items()), "__w string, __found string").withColumn("__known", F.lit(True)))
    none = "cast(NULL AS string)"
    # no filter on the documents here: it would work them out once more; the first level drops those that are NULL
    rows = docs.selectExpr(
        "id",
        "'Thing' AS state",
        f"{none} AS owner",
        f"{none} AS term",
        f"{none} AS name",
        "'' AS at",
        f"{none} AS mine",
        f"{none} AS mine_type",
        f"{none} AS kind",
        f"{none} AS word",
        f"`{doc}` AS node",
    )
    rows = rows.withColumn("__terms", C.own_terms(F.col("node")))
    inside = ("__in_map", "__in_texts", "__same")
    child = _advance("", "__k IS NULL", "__k", STEP, "__found", "__known IS NOT NULL", "__fresh", inside)
    for _ in range(FAST_LEVELS):
        # in steps, so that the code made of each stays small enough to be compiled to machine code
        rows = (
            _opened(rows)
            .selectExpr("*", *[f"{x} AS {c}" for x, c in zip(_inside("state", "__k IS NULL"), inside)])
            # those below without a term
            .where("own OR if(__same, term, state) IS NOT NULL")
            .selectExpr("*", "if(own, NULL, concat(state, '.', __k)) AS __w")
            .join(words, "__w", "left")
            .selectExpr("*", f"if(own, NULL, {_fresh('state', '__k', '__known IS NOT NULL')}) AS __fresh", "to_json(__v) AS __j")
            .selectExpr(
                "id",
                *[f"if(own, {c}, {child[c]}) AS {c}" for c in _KNOWN],
                *_OLD,
                "__terms",
            )
        )
        rows = _values(rows)
    return _emit(_deeper(rows, table), prefix)


def _opened(rows: DataFrame) -> DataFrame:
    """Every row without its ``node`` (``own``), and one row per child of a ``node``, with position ``__p`` or key
    ``__k`` and value ``__v``. Only objects and arrays still to be taken apart are nodes."""
    keep = [c for c in rows.columns if c != "node"]
    kind = "array<struct<key:string,value:variant>>"
    own = f"cast(array(named_struct('key', NULL, 'value', NULL)) AS {kind})"
    held = "try_variant_get(node, '$', 'array<variant>')"
    members = f"cast(map_entries(try_variant_get(node, '$', 'map<string,variant>')) AS {kind})"
    items = f"cast(arrays_zip(array_repeat(cast(NULL AS string), size({held})), {held}) AS {kind})"
    # no generator over variants and no lambda: all levels run as one compiled loop, and rows aren't copied between them
    below = f"posexplode(if(node IS NULL, {own}, concat({own}, coalesce({members}, {items})))) AS (__i, __e)"
    return rows.selectExpr(*keep, below).selectExpr(*keep, "__i = 0 AS own", "__i - 1 AS __p", "__e.key AS __k", "__e.value AS __v")


# What a row had, where it is ``own``, and the value and its JSON text, where it is not.
_OLD = ["own", "kind AS __kind", "word AS __word", "__v", "__j"]


def _values(rows: DataFrame) -> DataFrame:
    """``kind``, ``word`` and ``node`` of each row, those it has where it is ``own``. The word is the text of a string
    and the JSON text of other scalars, of objects and arrays only where a term keeps them whole; only objects and
    arrays stay nodes, and their shape isn't worked out."""
    whole = ", ".join(_quoted(f"{c}.{k}") for c, terms in TERMS.items() for k, (_, spec) in terms.items() if spec == "any")
    keep = ["id", *_KNOWN, "__terms"]
    return (
        rows.selectExpr("*", "CASE left(__j, 1) WHEN '{' THEN 'object' WHEN '[' THEN 'array' END AS __holds")
        .selectExpr("*", "if(__holds IS NULL, schema_of_variant(__v), NULL) AS __shape")
        .selectExpr(
            *keep,
            f"if(own, __kind, coalesce(__holds, {_SCALAR})) AS kind",
            "CASE WHEN own THEN __word WHEN __shape = 'STRING' THEN try_variant_get(__v, '$', 'string') "
            f"WHEN __holds IS NULL OR term IN ({whole}) THEN __j END AS word",
            "if(__holds IS NULL, NULL, __v) AS node",
        )
    )


_SCALAR = "CASE __shape WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VOID' THEN 'null' ELSE nvl2(__shape, 'number', NULL) END"


def _deeper(rows: DataFrame, table: dict[str, str | None]) -> DataFrame:
    """Rows as they are, and everything below those still open, worked out inside the row."""
    key, of = "substr(taken, 2)", "concat(cur.state, taken)"
    known = f"try_element_at(__table, {of}) IS NOT NULL"
    taken = _advance(
        "cur.",
        "startswith(taken, '[')",
        key,
        "taken",
        f"nullif(try_element_at(__table, {of}), '')",
        known,
        _fresh("cur.state", key, known),
        _inside("cur.state", "startswith(taken, '[')"),
    )
    struct = "struct<" + ",".join(f"{c}:string" for c in _KNOWN) + ">"
    pack = lambda values: "named_struct(" + ", ".join(f"'{c}', {values[c]}" for c in _KNOWN) + ")"
    here = f"cast({pack({c: c for c in _KNOWN})} AS {struct})"
    words = _map_text({k: v or "" for k, v in table.items()})
    open_ = F.col("node").isNotNull()
    # the table only where it is needed: it would be copied with every row
    wide = rows.selectExpr("*", f"if(node IS NULL, NULL, {words}) AS __table").withColumn("__nodes", F.when(open_, D.walk(F.col("node"), D.nesting_depth(F.to_json("node")))))
    below = (
        f"transform(__nodes, n -> named_struct('k', aggregate(n.path, {here}, "
        f"(cur, taken) -> cast({pack(taken)} AS {struct})), 'node', n.node))"
    )
    rows = (
        wide.selectExpr("*", f"explode_outer({below}) AS __n")
        .selectExpr(
            "id",
            *[f"if(node IS NULL, {c}, __n.k.{c}) AS {c}" for c in _KNOWN],
            "node IS NULL AS own",
            "kind AS __kind",
            "word AS __word",
            "__n.node AS __v",
            "to_json(__n.node) AS __j",
            "__terms",
        )
        .where("term IS NOT NULL")
    )
    return _values(rows).drop("node")


def _emit(rows: DataFrame, prefix: str) -> DataFrame:
    """The quads of each value: a literal or address, or the link to a node and its name."""
    spark = rows.sparkSession
    entries = [
        (f"{c}.{k}", iri(p), spec) for c, terms in TERMS.items() for k, (p, spec) in terms.items()
    ]
    entries.append((_MINE, None, "own"))
    names = {iri(k): iri(v) for k, v in NAME_PREDICATE.items()}
    terms = F.broadcast(spark.createDataFrame(entries, "term string, p string, spec string"))
    told = rows.join(terms, "term").withColumn("p", F.coalesce("mine", "p"))
    # one column at a time, so that none is worked out more than once per row
    told = (
        told.withColumn("address", _address())
        .withColumn("dt", F.when(F.col("address").isNull(), _datatype()))
        .withColumn(
            "tag",
            F.when(F.col("spec") == "text", "en").when(F.col("spec") == "texts", F.lower("name")),
        )
    )
    spec, kind = F.col("spec"), F.col("kind")
    is_map = spec.startswith("*")
    is_node = spec.startswith(">") | is_map | ((spec == "own") & (kind == "object"))
    child = F.expr(_label("at"))
    # one declared type for all, so that branches agree on which fields may be NULL
    row = (
        "struct<s:string,p:string,v:struct<o:string,o_kind:string,o_dt:string,o_lang:string,"
        "o_num:double,o_ts:timestamp>>"
    )
    triple = lambda s, p, v: F.struct(s.alias("s"), p.alias("p"), v.alias("v")).cast(row)
    link = triple(F.col("owner"), F.col("p"), _value(child, "bnode"))
    name_predicate = F.coalesce(
        F.try_element_at(_literal_map(names), F.col("p")), F.lit(iri(DEFAULT_NAME_PREDICATE))
    )
    name = triple(child, name_predicate, _value(F.col("name"), "literal", F.lit(XSD + "string")))
    number = F.col("dt").isin(*[XSD + t for t in ("integer", "double", "unsignedInt")])
    value = _value(
        F.coalesce("address", "word"),
        F.when(F.col("address").isNotNull(), "iri").otherwise("literal"),
        F.col("dt"),
        F.col("tag"),
        F.when(number, F.col("word").try_cast("double")),
        F.when(spec == "dateTime", F.col("word").try_cast("timestamp")),
    )
    plain = triple(F.col("owner"), F.col("p"), value)
    # the map or text table itself is no value, only what it holds
    in_place = (~(is_map | (spec == "texts")) | F.col("name").isNotNull()) & ~kind.isin("array", "null")
    triples = (
        F.when(is_map & in_place & (kind == "object"), F.array(link, name))
        .when(is_node & in_place & (kind == "object"), F.array(link))
        .when(in_place & ~is_node & ((kind != "object") | (spec == "any")), F.array(plain))
    )
    return (
        told.select(F.concat(F.lit(prefix), "id").alias("g"), F.explode(triples).alias("t"))
        .select("g", "t.s", "t.p", "t.v.*")
        .where(F.col("o").isNotNull())
        .select(*QUAD_COLS)
    )


def _value(
    o: Column,
    kind: str | Column,
    dt: Column | None = None,
    tag: Column | None = None,
    num: Column | None = None,
    ts: Column | None = None,
) -> Column:
    none = F.lit(None)
    return F.struct(
        o.cast("string").alias("o"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("o_kind"),
        (none if dt is None else dt).cast("string").alias("o_dt"),
        (none if tag is None else tag).cast("string").alias("o_lang"),
        (none if num is None else num).cast("double").alias("o_num"),
        (none if ts is None else ts).cast("timestamp").alias("o_ts"),
    )


def _expand_class(word: Column) -> Column:
    """An address from a class name: prefixed, absolute, or a word of the vocabulary."""
    head = F.substring_index(word, ":", 1)
    base = F.coalesce(F.try_element_at(F.col("__terms"), head)["iri"], F.try_element_at(_literal_map(PREFIXES), head))
    return (
        F.when(~word.contains(":"), F.concat(F.lit(TD), word))
        .when(base.isNotNull(), F.concat(base, F.substr(word, F.length(head) + 2)))
        .otherwise(word)
    )


def _address() -> Column:
    """The address a word stands for, NULL where the vocabulary expects a literal."""
    spec, word = F.col("spec"), F.col("word")
    vocabulary = lambda names: F.coalesce(
        F.try_element_at(_literal_map({k: iri(v) for k, v in names.items()}), word),
        F.concat(F.lit(TD), word),
    )
    return (
        F.when(spec == "iri", word)
        .when(spec == "op", F.concat(F.lit(TD), word))
        .when(spec == "schemaType", vocabulary(SCHEMA_TYPES))
        .when(spec == "scheme", vocabulary(SECURITY_SCHEMES))
        .when(spec == "class", _expand_class(word))
        .when((spec == "own") & (F.col("kind") == "string") & F.col("mine_type").isin("@id", "@vocab"), _expand_class(word))
    )


def _datatype() -> Column:
    """The datatype of a literal: the vocabulary's, or that of the JSON value."""
    spec, word, kind = F.col("spec"), F.col("word"), F.col("kind")
    return (
        F.when(spec.isin("text", "texts"), LANG_STRING)
        .when((spec == "own") & ~F.col("mine_type").startswith("@"), F.col("mine_type"))
        .when(~spec.isin("number", "any", "own"), F.concat(F.lit(XSD), spec))
        .when(kind == "boolean", XSD + "boolean")
        .when((kind == "number") & word.rlike(r"^-?\d+$"), XSD + "integer")
        .when(kind == "number", XSD + "double")
        .when(kind == "object", RDF + "JSON")
        .otherwise(XSD + "string")
    )


def ntriples(quads: DataFrame, with_graph: bool = False) -> DataFrame:
    """One line of text per quad in column ``value``, ready for ``write.text``."""
    escaped = F.col("o")
    for found, wanted in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(found), F.lit(wanted))
    # characters that an address may not hold are written as their code
    forbidden = {c: f"\\u{ord(c):04X}" for c in '<>"{}|^`\\ '}

    def address(c: Column) -> Column:
        for found, wanted in sorted(forbidden.items(), key=lambda x: x[0] != "\\"):
            c = F.replace(c, F.lit(found), F.lit(wanted))
        return F.concat(F.lit("<"), c, F.lit(">"))

    resource = lambda c: F.when(c.startswith("_:"), c).otherwise(address(c))
    literal = F.concat(
        F.lit('"'),
        escaped,
        F.lit('"'),
        F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang"))
        .when(
            F.col("o_dt").isNotNull() & (F.col("o_dt") != XSD + "string"),
            F.concat(F.lit("^^<"), "o_dt", F.lit(">")),
        )
        .otherwise(""),
    )
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(resource(F.col("o")))
    parts = [resource(F.col("s")), address(F.col("p")), obj]
    if with_graph:
        parts.append(address(F.col("g")))
    return quads.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


# ---------------------------------------------------------------- quads back to documents

# Members that stay arrays even with one value.
_LISTS = ["@type", "forms", "links", "security", "oneOf", "enum", "required", "allOf", "scopes"]


def _reverse_terms(spark) -> DataFrame:
    rows = []
    for context, terms in TERMS.items():
        for key, (p, spec) in terms.items():
            rows.append((context, iri(p), key, spec))
    return spark.createDataFrame(rows, "ctx string, p string, key string, spec string")


def own_contexts(docs: DataFrame, doc: str = "doc", prefix: str = GRAPH_PREFIX) -> DataFrame:
    """``g, terms, context``: the terms that each document defines itself, and its ``@context`` as JSON text."""
    context = F.to_json(F.try_variant_get(doc, "$['@context']", "variant"))
    return docs.where(F.col(doc).isNotNull()).select(
        F.concat(F.lit(prefix), "id").alias("g"), C.own_terms(F.col(doc)).alias("terms"), context.alias("context")
    )


def assemble(quads: DataFrame, contexts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents from quads, and the graphs that cannot become one.

    The document starts at the node whose name begins with ``urn``; nested nodes are placed level
    by level. Predicates outside the vocabulary become members too, named by the terms of the graph's row in
    ``contexts`` (:func:`own_contexts`, one row per graph; its ``@context`` is put back as well), else by their
    address. Returns ``(id, g, body)`` and ``(g, code)``: graphs without such a node.
    """
    spark = quads.sparkSession
    sizes = quads.groupBy("g").agg(F.min(F.when(F.col("s").startswith("urn"), F.col("s"))).alias("root"))
    refused = sizes.where("root is null").select("g", F.lit("no_root").alias("code"))
    roots = sizes.where("root is not null")
    if contexts is None:
        roots = roots.withColumn("__terms", F.lit(None).cast(C.TERM_MAP)).withColumn("context", F.lit(None).cast("string"))
    else:
        roots = roots.join(contexts.withColumnRenamed("terms", "__terms"), "g", "left")
    roots = cut(roots)
    fixed = {iri(p) for members in TERMS.values() for p, _ in members.values()}
    fixed |= {iri(x) for x in {*NAME_PREDICATE.values(), DEFAULT_NAME_PREDICATE}}
    terms = F.broadcast(_reverse_terms(spark))  # the fixed term table
    names = quads.where(
        F.col("p").isin(*[iri(x) for x in {*NAME_PREDICATE.values(), DEFAULT_NAME_PREDICATE}])
    )
    names = names.groupBy("g", F.col("s").alias("o")).agg(F.min("o").alias("child_name"))

    empty_ord = F.array().cast(D.ORD)
    front = roots.select(
        "g", F.col("root").alias("s"), F.lit("Thing").alias("ctx"), empty_ord.alias("ord"), "__terms"
    )
    placed = [
        roots.select("g", empty_ord.alias("ord"), F.lit("object").alias("kind"), F.lit(None).cast("string").alias("leaf")),
        roots.select(
            "g",
            F.array(F.struct(F.lit(-1).alias("pos"), F.lit("id").alias("key"))).alias("ord"),
            F.lit("string").alias("kind"),
            D.json_string(F.col("root")).alias("leaf"),
        ),
    ]
    if contexts is not None:
        at_context = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("@context").alias("key")))
        placed.append(
            roots.where("context is not null").select("g", at_context.alias("ord"), F.lit("leaf").alias("kind"), F.col("context").alias("leaf"))
        )
    while True:
        told = front.join(quads, ["g", "s"]).join(terms, ["ctx", "p"], "left")
        told = (
            told.where(
                F.when(F.col("key").isNotNull(), _fits(F.col("key"), F.col("spec"), F.col("o"))).otherwise(~F.col("p").isin(*fixed))
            )
            .withColumn("spec", F.coalesce("spec", F.lit("own")))
            .withColumn("key", F.coalesce("key", C.compact(F.col("__terms"), F.col("p"))))
            .join(names, ["g", "o"], "left")
        )
        same = Window.partitionBy("g", "s", "key").orderBy("o", "o_lang")
        total = Window.partitionBy("g", "s", "key")
        told = cut(
            told.withColumn("i", F.row_number().over(same) - 1)
            .withColumn("many", F.count(F.lit(1)).over(total) > 1)
            .withColumn("is_list", (F.col("key").isin(*_LISTS)) | F.col("many"))
            .withColumn("in_map", F.col("spec").startswith("*") | (F.col("spec") == "texts"))
        )
        if told.isEmpty():
            break
        place = lambda pos, key: F.struct(pos.cast("int").alias("pos"), key.alias("key"))
        base = F.array_append("ord", place(F.lit(-1), F.col("key")))
        inner_key = F.when(F.col("spec") == "texts", F.col("o_lang")).otherwise(F.col("child_name"))
        ord_ = (
            F.when(F.col("in_map"), F.array_append(base, place(F.lit(-1), inner_key)))
            .when(F.col("is_list"), F.array_append(base, place(F.col("i"), F.lit(""))))
            .otherwise(base)
        )
        is_node = F.col("spec").substr(1, 1).isin(">", "*") | ((F.col("spec") == "own") & (F.col("o_kind") == "bnode"))
        kind = F.when(is_node, "object").otherwise("leaf")
        told = told.withColumn("at", ord_)
        # the map or array around the values, once
        placed.append(
            told.where("in_map or is_list")
            .select("g", base.alias("ord"), F.when(F.col("in_map"), "object").otherwise("array").alias("kind"))
            .distinct()
            .withColumn("leaf", F.lit(None).cast("string"))
        )
        placed.append(
            told.select(
                "g",
                F.col("at").alias("ord"),
                kind.alias("kind"),
                F.when(~is_node, _leaf()).alias("leaf"),
            )
        )
        front = told.where(is_node).select(
            "g",
            F.col("o").alias("s"),
            F.expr(f"if(spec = 'own', '{_OWN_NODE}', regexp_replace(spec, '^[>*]', ''))").alias("ctx"),
            F.col("at").alias("ord"),
            "__terms",
        )
    nodes = placed[0]
    for part in placed[1:]:
        nodes = nodes.unionByName(part)
    built = nodes.groupBy("g").agg(F.collect_list(F.struct("ord", "kind", "leaf")).alias("n"))
    docs = built.join(roots, "g").select(
        F.col("root").alias("id"), "g", D.print_nodes(F.col("n")).alias("body")
    )
    return docs, refused


def _fits(key: Column, spec: Column, o: Column) -> Column:
    """Which of the keys that share ``rdf:type`` an object belongs to."""
    types = [iri(v) for v in SCHEMA_TYPES.values()]
    schemes = [iri(v) for v in SECURITY_SCHEMES.values()]
    return (
        F.when(spec == "schemaType", o.isin(*types))
        .when(spec == "scheme", o.isin(*schemes))
        .when(spec == "class", ~o.isin(*types, *schemes))
        .otherwise(True)
    )


def _leaf() -> Column:
    """JSON text of a quad's object."""
    o, spec = F.col("o"), F.col("spec")
    words = {iri(v): k for k, v in {**SCHEMA_TYPES, **SECURITY_SCHEMES}.items()}
    word = (
        F.when(spec.isin("schemaType", "scheme"), F.try_element_at(_literal_map(words), o))
        .when((spec == "class") & ~o.startswith(TD), C.compact(F.col("__terms"), o))
        .when(spec.isin("op", "class"), F.replace(o, F.lit(TD), F.lit("")))
        .otherwise(o)
    )
    bare = F.col("o_dt").isin(
        *[XSD + t for t in ("boolean", "integer", "double", "unsignedInt")], RDF + "JSON"
    )
    # values of own terms say what the term does not
    dt, lang = F.col("o_dt"), F.col("o_lang")
    typed = F.try_element_at(F.col("__terms"), F.col("key"))["type"]
    own = (
        F.when((F.col("o_kind") == "iri") & ~F.coalesce(typed.isin("@id", "@vocab"), F.lit(False)), F.to_json(F.struct(o.alias("@id"))))
        .when(lang.isNotNull(), F.to_json(F.struct(o.alias("@value"), lang.alias("@language"))))
        .when((F.col("o_kind") == "literal") & (dt != XSD + "string") & ~dt.eqNullSafe(typed), F.to_json(F.struct(o.alias("@value"), dt.alias("@type"))))
    )
    return (
        F.when(bare & (F.col("o_kind") == "literal"), o)
        .when((spec == "own") & own.isNotNull(), own)
        .otherwise(D.json_string(word))
    )

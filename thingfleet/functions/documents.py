"""Column functions over JSON documents: parse, walk, rewrite, merge, search, print.

A document is a VARIANT; one that is edited at the top level is a ``map<string,variant>``.
Everything here is a row-local expression, so no function in this module shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import CONTEXT_V10, CONTEXT_V11, TD

FIELDS = "map<string,variant>"
ITEMS = "array<variant>"
ORD = "array<struct<pos:int,key:string>>"


# ---------------------------------------------------------------- reading


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def at(array: Column | str, position: Column | int) -> Column:
    """An item counted from 1, or from the end; NULL beyond it."""
    if isinstance(position, int):
        return F.try_element_at(array, F.lit(position))
    return F.try_element_at(array, F.nullif(position, F.lit(0)))


def fields(v: Column) -> Column:
    """The fields of an object, NULL for anything else."""
    return F.try_variant_get(v, "$", FIELDS)


def items(v: Column) -> Column:
    """The items of an array, NULL for anything else."""
    return F.try_variant_get(v, "$", ITEMS)


def text_of(v: Column) -> Column:
    """The value of a JSON string, NULL for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    return bind(F.schema_of_variant(v), kind_of_shape)


def kind_of_shape(shape: Column) -> Column:
    """The kind of a value from its ``schema_of_variant``."""
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(shape.isNotNull(), "number")
    )


def to_variant(value: Column) -> Column:
    """A typed value as VARIANT."""
    return F.parse_json(F.to_json(value))


def text_variant(value: Column | str) -> Column:
    """A string as a VARIANT string."""
    value = F.lit(value) if isinstance(value, str) else value
    return value.cast("variant")


def nesting_depth(text: Column) -> Column:
    """How deep objects and arrays nest in valid JSON ``text``."""
    # drop escapes, then strings, then all but the brackets
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    marks = F.translate(F.regexp_replace(bare, r"[^\[\]{}]", ""), "[]", "{}")

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(marks, "(?!^)"), start, step)["most"]


# ---------------------------------------------------------------- walking


def walk(doc: Column, bound: Column) -> Column:
    """All nodes of a document, level by level, as one array.

    Each node is ``struct<path, ord, node>``. A path element is ``.key`` below an object and
    ``[i]`` below an array; ``ord`` sorts nodes into document order. ``bound`` is the depth of the
    document, or more: further rounds find nothing to do.
    """
    node_type = f"struct<path:array<string>,ord:{ORD},node:variant>"

    def child(parent: Column, step: Column, pos: Column, key: Column, node: Column) -> Column:
        return F.struct(
            F.array_append(parent["path"], step).alias("path"),
            F.array_append(
                parent["ord"], F.struct(pos.cast("int").alias("pos"), key.alias("key"))
            ).alias("ord"),
            node.alias("node"),
        )

    def children(n: Column) -> Column:
        return F.coalesce(
            F.transform(
                F.map_entries(fields(n["node"])),
                lambda e: child(n, F.concat(F.lit("."), e["key"]), F.lit(-1), e["key"], e["value"]),
            ),
            F.transform(
                items(n["node"]),
                lambda v, i: child(
                    n, F.concat(F.lit("["), i.cast("string"), F.lit("]")), i, F.lit(""), v
                ),
            ),
            F.array().cast(f"array<{node_type}>"),
        )

    root = F.array(
        F.struct(
            F.array().cast("array<string>").alias("path"),
            F.array().cast(ORD).alias("ord"),
            doc.alias("node"),
        )
    )

    def level(acc: Column, _: Column) -> Column:
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(
            bind(
                F.flatten(F.transform(acc["front"], children)),
                lambda below: F.struct(
                    below.alias("front"), F.concat(acc["seen"], below).alias("seen")
                ),
            )
        )

    start = F.struct(root.alias("front"), root.alias("seen"))
    rounds = F.sequence(F.lit(1), F.greatest(bound, F.lit(1)))
    return F.when(doc.isNotNull(), F.aggregate(rounds, start, level)["seen"])


def print_nodes(nodes: Column) -> Column:
    """JSON text of an array of ``struct<ord, kind, leaf>`` nodes in any order.

    ``leaf`` is the JSON text of a scalar. Nodes may be missing a subtree but never an
    ancestor. Objects come out with sorted keys, arrays by position.
    """
    ordered = F.array_sort(F.transform(nodes, lambda n: F.struct(n["ord"], n["kind"], n["leaf"])))

    def piece(ns: Column) -> Callable[[Column, Column], Column]:
        def render(n: Column, i: Column) -> Column:
            depth = F.size(n["ord"])
            last = at(n["ord"], -1)
            prev = F.when(i > 0, F.get(ns, i - 1))
            nxt = F.get(ns, i + 1)
            sibling = F.size(prev["ord"]) >= depth
            has_child = F.coalesce(F.size(nxt["ord"]) > depth, F.lit(False))
            opener = (
                F.when(n["kind"] == "object", "{").when(n["kind"] == "array", "[").otherwise(n["leaf"])
            )
            own_end = F.when(
                ~has_child,
                F.when(n["kind"] == "object", "}").when(n["kind"] == "array", "]").otherwise(""),
            ).otherwise("")
            # after the last node of a subtree, close its ancestors up to the next node's parent
            next_depth = F.when(nxt.isNull(), 0).otherwise(F.size(nxt["ord"]))
            return F.concat(
                F.when(sibling, ",").otherwise(""),
                F.when(
                    (depth > 0) & (last["pos"] < 0), F.concat(json_string(last["key"]), F.lit(":"))
                ).otherwise(""),
                opener,
                own_end,
                F.when(has_child, "").otherwise(_ancestor_closers(n["ord"], depth, next_depth)),
            )

        return render

    def whole(ns: Column) -> Column:
        return F.array_join(F.transform(ns, piece(ns)), "")

    # bind the sorted array once
    return at(F.transform(F.array(ordered), whole), 1)


def _ancestor_closers(ord_: Column, depth: Column, next_depth: Column) -> Column:
    """Closing brackets of the ancestors that end after a node without children.

    The node at ``depth`` has ancestors at depths 0..depth-1; those at ``next_depth`` and
    deeper end. The step below an ancestor at depth d is ``ord_[d]`` and tells its kind.
    """
    n = depth - next_depth
    return F.when(
        n > 0,
        F.array_join(
            F.transform(
                F.reverse(F.slice(ord_, next_depth + 1, n)),
                lambda o: F.when(o["pos"] < 0, "}").otherwise("]"),
            ),
            "",
        ),
    ).otherwise("")


def json_string(value: Column) -> Column:
    """A string as JSON text, quotes included."""
    return F.to_json(value.cast("variant"))


# ---------------------------------------------------------------- top-level edits


def has(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def put(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(without(m, key), F.create_map(F.lit(key), value))


def rename(m: Column, old: str, new: str) -> Column:
    return bind(
        m,
        lambda x: F.when(
            has(x, old),
            F.map_concat(
                without(x, old, new), F.create_map(F.lit(new), F.try_element_at(x, F.lit(old)))
            ),
        ).otherwise(x),
    )


def overlay(base: Column, patch: Column) -> Column:
    """Top-level replace: every key of ``patch`` wins, JSON null included."""
    return F.map_zip_with(base, patch, lambda _k, old, new: F.coalesce(new, old))


def drop_null_fields(m: Column) -> Column:
    return F.map_filter(m, lambda _k, v: ~F.is_variant_null(v))


# ---------------------------------------------------------------- upgrade to version 1.1


def upgrade_security(m: Column) -> Column:
    """Rewrite legacy security definitions.

    A definition named ``@none`` becomes ``nosec_sc`` with only its scheme; ``td:scheme`` loses
    its prefix elsewhere.
    """

    def definition(name: Column, d: Column) -> Column:
        only_scheme = lambda parts: F.create_map(
            F.lit("scheme"), F.try_element_at(parts, F.lit("scheme"))
        )
        return F.to_variant_object(
            bind(
                fields(d),
                lambda parts: F.when(name == "@none", only_scheme(parts)).otherwise(
                    rename(parts, "td:scheme", "scheme")
                ),
            )
        )

    def rewritten(defs: Column) -> Column:
        # @none takes the name nosec_sc, so a definition already called that gives way
        kept = F.map_filter(defs, lambda k, _: (k != "nosec_sc") | ~has(defs, "@none"))
        return F.map_from_entries(
            F.transform(
                F.map_entries(kept),
                lambda e: F.struct(
                    F.when(e["key"] == "@none", "nosec_sc").otherwise(e["key"]).alias("key"),
                    definition(e["key"], e["value"]).alias("value"),
                ),
            )
        )

    return bind(
        fields(F.try_element_at(m, F.lit("securityDefinitions"))),
        lambda defs: F.when(
            defs.isNotNull(),
            put(m, "securityDefinitions", F.to_variant_object(rewritten(defs))),
        ).otherwise(m),
    )


def upgrade_security_list(m: Column) -> Column:
    """Rename ``hasSecurityConfiguration`` and wrap a single ``security`` in an array."""

    def wrap(x: Column) -> Column:
        current = F.try_element_at(x, F.lit("security"))
        wrapped = F.to_variant_object(F.array(current))
        return F.when(
            has(x, "security") & items(current).isNull(), put(x, "security", wrapped)
        ).otherwise(x)

    return bind(rename(m, "hasSecurityConfiguration", "security"), wrap)


def upgrade_context(m: Column, old: str = CONTEXT_V10, new: str = CONTEXT_V11) -> Column:
    """Point ``@context`` at version 1.1: absent, text, array of texts, or object keyed by it."""

    def rewrite(current: Column) -> Column:
        swapped = F.transform(
            items(current), lambda v: F.when(text_of(v) == old, text_variant(new)).otherwise(v)
        )
        return (
            F.when(~has(m, "@context"), put(m, "@context", text_variant(new)))
            .when(text_of(current) == old, put(m, "@context", text_variant(new)))
            .when(items(current).isNotNull(), put(m, "@context", F.to_variant_object(swapped)))
            .when(
                has(fields(current), old),
                put(m, "@context", F.to_variant_object(put(fields(current), old, text_variant(new)))),
            )
            .otherwise(m)
        )

    return bind(F.try_element_at(m, F.lit("@context")), rewrite)


def upgrade_registration(m: Column) -> Column:
    """Drop the node name inside ``registration``."""
    return bind(
        fields(F.try_element_at(m, F.lit("registration"))),
        lambda reg: F.when(
            has(reg, "id"), put(m, "registration", F.to_variant_object(without(reg, "id")))
        ).otherwise(m),
    )


def upgrade_title(m: Column) -> Column:
    return rename(m, "td:title", "title")


def upgrade_version(m: Column) -> Column:
    return put(m, "@version", text_variant("1.1"))


def is_current(m: Column) -> Column:
    """A document that states ``@version`` is taken as it is."""
    return has(m, "@version")


UPGRADE_STEPS = [
    upgrade_security,
    upgrade_security_list,
    upgrade_context,
    upgrade_registration,
    upgrade_title,
    upgrade_version,
]


def upgrade(m: Column) -> Column:
    """All upgrade steps in order, skipped for a document that states its version."""
    out = m
    for step in UPGRADE_STEPS:
        out = bind(out, step)
    return F.when(is_current(m), m).otherwise(out)


# ---------------------------------------------------------------- decoration


def types_of(m: Column) -> Column:
    """``@type`` as an array of strings, a single type wrapped."""
    none = F.array().cast("array<string>")
    return bind(
        F.try_element_at(m, F.lit("@type")),
        lambda t: F.coalesce(
            F.filter(F.transform(items(t), text_of), lambda x: x.isNotNull()),
            F.when(text_of(t).isNotNull(), F.array(text_of(t))),
            none,
        ),
    )


def has_thing_type(types: Column) -> Column:
    return F.arrays_overlap(types, F.array(F.lit("Thing"), F.lit(TD + "Thing")))


def decorate_types(m: Column) -> Column:
    """Make sure the document is a ``Thing``; a document that already is one keeps its types."""
    return bind(
        types_of(m),
        lambda types: F.when(has_thing_type(types), m).otherwise(
            put(m, "@type", F.to_variant_object(F.array_append(types, F.lit("Thing"))))
        ),
    )


def decorate_registration(m: Column, now: Column) -> Column:
    """Stamp ``registration``: created only where the block is absent, modified always; without an instant
    the document stays as it is."""
    stamp = text_variant(instant_text(now))
    fresh = F.create_map(F.lit("created"), stamp, F.lit("modified"), stamp)
    stamped = bind(
        fields(F.try_element_at(m, F.lit("registration"))),
        lambda reg: put(
            m,
            "registration",
            F.to_variant_object(F.when(reg.isNull(), fresh).otherwise(put(reg, "modified", stamp))),
        ),
    )
    return F.when(now.isNull(), m).otherwise(stamped)


def decorate(m: Column, now: Column) -> Column:
    return bind(bind(m, decorate_types), lambda x: decorate_registration(x, now))


def instant_text(ts: Column) -> Column:
    """ISO-8601 text of an instant in UTC, whatever the session's time zone."""
    micros = F.unix_micros(ts.cast("timestamp"))
    rest = F.pmod(micros, F.lit(86_400_000_000))
    day = F.date_add(
        F.lit("1970-01-01").cast("date"), ((micros - rest) / F.lit(86_400_000_000)).cast("int")
    )
    part = lambda unit, size: (F.floor(rest / F.lit(unit)) % size).cast("int")
    text = F.format_string(
        "%sT%02d:%02d:%02d.%06dZ",
        day.cast("string"),
        part(3_600_000_000, 24),
        part(60_000_000, 60),
        part(1_000_000, 60),
        (rest % 1_000_000).cast("int"),
    )
    return F.when(ts.isNotNull(), text)


# ---------------------------------------------------------------- null removal


#: Levels of objects that :func:`remove_nulls` prints directly; what nests deeper is walked.
DIRECT_LEVELS = 4


def remove_nulls(doc: Column, bound: Column) -> Column:
    """JSON text without null members, at every depth below objects but not inside arrays.

    Only a document whose text has the word in it is taken apart: member by member for the first levels of
    objects, by :func:`walk` below them.
    """

    def printed(v: Column, levels: int) -> Column:
        if not levels:
            return _walked_without_nulls(v, bound)

        def whole(m: Column) -> Column:
            kept = F.filter(F.map_entries(m), lambda e: ~F.is_variant_null(e["value"]))
            members = F.transform(
                kept,
                lambda e: F.struct(
                    e["key"].alias("key"),
                    F.concat(json_string(e["key"]), F.lit(":"), printed(e["value"], levels - 1)).alias("text"),
                ),
            )
            text = F.array_join(F.transform(F.array_sort(members), lambda e: e["text"]), ",")
            return F.when(m.isNull(), F.to_json(v)).otherwise(F.concat(F.lit("{"), text, F.lit("}")))

        return bind(fields(v), whole)

    text = F.to_json(doc)
    return F.when(text.contains("null"), printed(doc, DIRECT_LEVELS)).otherwise(text)


def _walked_without_nulls(doc: Column, bound: Column) -> Column:
    """The same for any value at any depth, from its nodes."""
    nodes = F.transform(
        walk(doc, bound),
        lambda n: F.struct(
            n["ord"].alias("ord"),
            kind_of(n["node"]).alias("kind"),
            n["node"].alias("node"),
        ),
    )
    in_array = lambda n: F.exists(n["ord"], lambda o: o["pos"] >= 0)
    kept = F.filter(nodes, lambda n: (n["kind"] != "null") | in_array(n))
    printed = print_nodes(
        F.transform(
            kept,
            lambda n: F.struct(
                n["ord"].alias("ord"),
                n["kind"].alias("kind"),
                F.when(~n["kind"].isin("object", "array"), F.to_json(n["node"])).alias("leaf"),
            ),
        )
    )
    text = F.to_json(doc)
    return F.when(text.contains("null"), printed).otherwise(text)


# ---------------------------------------------------------------- path search


class Path:
    """Steps into a document, built one by one and applied to a VARIANT column.

    ``Path().child("properties").any().child("type")`` yields the nodes the steps reach as
    ``array<variant>``. The steps run inside the row: a search is a filter, never a join.
    """

    def __init__(self, steps: tuple = ()):
        self._steps = steps

    def _then(self, step: Callable[[Column, Column], Column]) -> Path:
        return Path((*self._steps, step))

    def child(self, *names: str) -> Path:
        """The members with the given names."""
        if not names:
            raise ValueError("a child step needs a name")

        def step(nodes: Column, _bound: Column) -> Column:
            per_node = F.transform(
                nodes,
                lambda n: F.filter(
                    F.array(*[F.try_element_at(fields(n), F.lit(name)) for name in names]),
                    lambda v: v.isNotNull(),
                ),
            )
            return F.flatten(per_node)

        return self._then(step)

    def any(self) -> Path:
        """Every member or item."""
        return self._then(lambda nodes, _bound: _all_children(nodes))

    def deep(self, name: str | None = None) -> Path:
        """Descendants at any depth: those called ``name``, or all of them."""

        def step(nodes: Column, bound: Column) -> Column:
            def round_(acc: Column, _: Column) -> Column:
                return F.when(F.size(acc["front"]) == 0, acc).otherwise(
                    bind(
                        _all_children(acc["front"]),
                        lambda below: F.struct(
                            below.alias("front"), F.concat(acc["seen"], below).alias("seen")
                        ),
                    )
                )

            start = F.struct(nodes.alias("front"), nodes.alias("seen"))
            rounds = F.sequence(F.lit(1), F.greatest(bound, F.lit(1)))
            return F.aggregate(rounds, start, round_)["seen"]

        found = self._then(step)
        return found.child(name) if name else found

    def having(self, test: Callable[[Column], Column]) -> Path:
        """The nodes reached so far that pass a test of their own."""
        return self._then(lambda nodes, _bound: F.filter(nodes, lambda v: F.coalesce(test(v), F.lit(False))))

    def index(self, *positions: int) -> Path:
        """Items by position, negative ones from the end."""

        def pick(n: Column) -> Column:
            arr = items(n)
            at = [F.get(arr, F.lit(p)) if p >= 0 else F.get(arr, F.size(arr) + p) for p in positions]
            return F.filter(F.array(*at), lambda v: v.isNotNull())

        return self._then(lambda nodes, _bound: F.flatten(F.transform(nodes, pick)))

    def slice(self, start: int = 0, stop: int | None = None) -> Path:
        """Items from ``start`` up to, not including, ``stop``."""

        def pick(n: Column) -> Column:
            arr = items(n)
            size = F.size(arr)
            lo = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
            hi = size if stop is None else (F.lit(stop) if stop >= 0 else size + stop)
            kept = F.filter(arr, lambda _v, i: (i >= lo) & (i < hi))
            return F.coalesce(kept, F.array().cast(ITEMS))

        return self._then(lambda nodes, _bound: F.flatten(F.transform(nodes, pick)))

    def where(self, test: Callable[[Column], Column]) -> Path:
        """Members or items for which ``test`` holds; an unknown outcome does not."""
        return self._then(
            lambda nodes, _bound: F.filter(
                _all_children(nodes), lambda v: F.coalesce(test(v), F.lit(False))
            )
        )

    def nodes(self, doc: Column, bound: Column | None = None) -> Column:
        """The nodes reached from ``doc``; ``bound`` as for :func:`walk`, needed by ``deep``."""
        bound = nesting_depth(F.to_json(doc)) if bound is None else bound
        out = F.array(doc)
        for step in self._steps:
            out = step(out, bound)
        return F.when(doc.isNotNull(), out)

    def found(self, doc: Column, bound: Column | None = None) -> Column:
        """True when the steps reach at least one node."""
        return F.coalesce(F.size(self.nodes(doc, bound)) > 0, F.lit(False))


def _all_children(nodes: Column) -> Column:
    return F.flatten(
        F.transform(
            nodes,
            lambda n: F.coalesce(F.map_values(fields(n)), items(n), F.array().cast(ITEMS)),
        )
    )


def member(v: Column, name: str, as_type: str = "string") -> Column:
    """A member of ``v`` as a typed value, NULL when absent or of another type."""
    inner = F.try_element_at(fields(v), F.lit(name))
    return text_of(inner) if as_type == "string" else F.try_variant_get(inner, "$", as_type)


def path_function(name: str, nodes: Column, argument: Column | None = None) -> Column:
    """Functions at the end of a path: over the numbers, texts or members of its nodes."""
    numbers = F.filter(
        F.transform(nodes, lambda v: F.try_variant_get(v, "$", "double")), lambda x: x.isNotNull()
    )
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    n = F.size(numbers)
    mean = F.when(n > 0, total / n)
    if name == "min":
        return F.array_min(numbers)
    if name == "max":
        return F.array_max(numbers)
    if name == "sum":
        return total
    if name == "avg":
        return mean
    if name == "stddev":
        squares = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x * x)
        spread = squares / n - mean * mean
        return F.when(n > 0, F.sqrt(F.greatest(spread, F.lit(0.0))))
    if name == "length":
        return F.size(nodes)
    if name == "concat":
        texts = F.transform(nodes, lambda v: F.try_variant_get(v, "$", "string"))
        return F.array_join(texts, "")
    if name == "append":
        if argument is None:
            raise ValueError("append needs a value")
        return F.array_append(nodes, argument)
    if name == "keys":
        return F.array_sort(F.array_distinct(F.flatten(F.transform(nodes, lambda v: F.coalesce(
            F.map_keys(fields(v)), F.array().cast("array<string>"))))))
    if name == "first":
        return F.get(nodes, F.lit(0))
    if name == "last":
        return F.get(nodes, F.size(nodes) - 1)
    if name == "index":
        if argument is None:
            raise ValueError("index needs a position")
        return F.get(nodes, F.when(argument < 0, F.size(nodes) + argument).otherwise(argument))
    raise ValueError(f"unknown path function {name}")

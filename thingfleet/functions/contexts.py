"""Terms and prefixes that a document defines itself, in the objects of its ``@context``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import PREFIXES
from . import documents as D

#: Name -> address and, where the definition has one, the type of its values.
TERM_MAP = "map<string, struct<iri: string, type: string>>"
VOCAB = "@vocab"


def _prefix_base(own: Column, prefix: Column) -> Column:
    fixed = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))
    return F.coalesce(F.try_element_at(own, prefix)["iri"], F.try_element_at(fixed, prefix))


def _expanded(own: Column, word: Column) -> Column:
    """``prefix:rest`` as an address; anything else, and what looks like an address, as it is."""
    head = F.substring_index(word, ":", 1)
    rest = F.substr(word, F.length(head) + 2)
    base = _prefix_base(own, head)
    return F.when(word.contains(":") & ~rest.startswith("//") & base.isNotNull() & (head != word), F.concat(base, rest)).otherwise(word)


def own_terms(doc: Column) -> Column:
    """The definitions of a VARIANT document as a ``TERM_MAP``; NULL without any.

    Objects are read in their order, and of one name the last definition counts: a NULL one takes the name away.
    Addresses of other contexts are not fetched. Prefixes may be used in definitions after or before their own.
    """
    given = F.coalesce(
        F.try_variant_get(doc, "$['@context']", "array<variant>"), F.array(F.try_variant_get(doc, "$['@context']", "variant"))
    )
    maps = F.filter(F.transform(given, lambda c: F.try_variant_get(c, "$", "map<string,variant>")), lambda m: m.isNotNull())

    def definition(e: Column) -> Column:
        value = e["value"]
        address = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(
            F.try_variant_get(value, "$['@id']", "string")
        )
        kind = F.try_variant_get(value, "$['@type']", "string")
        return F.struct(e["key"].alias("key"), F.struct(address.alias("iri"), kind.alias("type")).alias("value"))

    told = F.transform(F.flatten(F.transform(maps, F.map_entries)), definition)
    expanded = lambda own, change: F.transform_values(own, lambda _, v: change(own, v))
    once = lambda own, v: F.struct(_expanded(own, v["iri"]).alias("iri"), v["type"].alias("type"))
    twice = lambda own, v: F.struct(_expanded(own, v["iri"]).alias("iri"), _expanded(own, v["type"]).alias("type"))

    # what a lambda names is worked out again for each of its calls, so every step is bound to a value first
    def last(all_: Column) -> Column:
        return F.filter(
            all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"])
        )

    def whole(entries: Column) -> Column:
        raw = F.map_from_entries(F.filter(entries, lambda e: e["value"]["iri"].isNotNull()))
        return F.when(F.size(entries) > 0, D.bind(D.bind(raw, lambda m: expanded(m, once)), lambda m: expanded(m, twice)))

    return D.bind(D.bind(told, last), whole)


def expand_key(own: str, key: str) -> str:
    """SQL text: the address a member's ``key`` stands for by the document's terms ``own``, NULL for none."""
    return (
        f"CASE WHEN startswith({key}, '@') THEN NULL "
        f"WHEN try_element_at({own}, {key}) IS NOT NULL THEN try_element_at({own}, {key}).iri "
        f"WHEN rlike({key}, '^(https?://|urn:)') THEN {key} "
        f"WHEN contains({key}, ':') THEN "
        f"concat(try_element_at({own}, substring_index({key}, ':', 1)).iri, substr({key}, instr({key}, ':') + 1)) "
        f"ELSE concat(try_element_at({own}, '{VOCAB}').iri, {key}) END"
    )


def value_type(own: str, key: str) -> str:
    """SQL text: the type that the term of a member's ``key`` gives its values."""
    return f"try_element_at({own}, {key}).type"


def compact(own: Column, address: Column) -> Column:
    """The shortest name that the terms ``own`` give an address: a term, else ``prefix:rest``, else the address."""
    entries = F.map_entries(own)
    terms = F.filter(entries, lambda e: (e["value"]["iri"] == address) & (e["key"] != VOCAB))
    prefixes = F.filter(
        entries,
        lambda e: address.startswith(e["value"]["iri"])
        & e["value"]["iri"].rlike(r"[/#:?]$")
        & ~e["key"].startswith("@")
        & (F.length(address) > F.length(e["value"]["iri"])),
    )
    short = F.transform(prefixes, lambda e: F.concat(e["key"], F.lit(":"), F.substr(address, F.length(e["value"]["iri"]) + 1)))
    by_length = lambda names: F.get(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))), F.lit(0))["n"]
    return F.coalesce(by_length(F.transform(terms, lambda e: e["key"])), by_length(short), address)

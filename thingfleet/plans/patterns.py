"""Basic graph patterns as DataFrame plans.

A triple is ``triple("?s", predicate, "?o")``: names that start with ``?`` are variables, other
strings are constants. ``num("?x")``, ``time("?x")`` and ``lang("?x")`` bind the number, the
instant or the language tag of an object instead of its text. The result has one column per
variable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.algebra import product

ANY = "any"


@dataclass(frozen=True)
class Bound:
    """A variable and the part of the object it takes."""

    name: str
    part: str


def num(name: str) -> Bound:
    return Bound(name, "o_num")


def time(name: str) -> Bound:
    return Bound(name, "o_ts")


def lang(name: str) -> Bound:
    return Bound(name, "o_lang")


@dataclass(frozen=True)
class Triple:
    s: str
    p: str
    o: str | Bound

    def variables(self) -> set[str]:
        return {t for t in (self.s, self.p, _name(self.o)) if _is_var(t)}


def triple(s: str, p: str, o: str | Bound) -> Triple:
    return Triple(s, p, o)


def _is_var(term: str) -> bool:
    return term.startswith("?")


def _name(o: str | Bound) -> str:
    return o.name if isinstance(o, Bound) else o


def _part(o: str | Bound) -> str:
    return o.part if isinstance(o, Bound) else "o"


def _bind(rows: DataFrame, terms: list[tuple[str, Column]], g: str | None) -> DataFrame:
    """Constants become filters, repeated variables equalities, variables columns."""
    bound: dict[str, Column] = {}
    for term, column in terms:
        if not _is_var(term):
            rows = rows.where(column == term)
        elif term in bound:
            rows = rows.where(bound[term] == column)
        else:
            bound[term] = column
    if g is not None and g != ANY:
        if not _is_var(g):
            rows = rows.where(F.col("g") == g)
        elif g in bound:
            rows = rows.where(bound[g] == F.col("g"))
        else:
            bound[g] = F.col("g")
    # a bound variable has a value
    for column in bound.values():
        rows = rows.where(column.isNotNull())
    return rows.select(*[column.alias(term[1:]) for term, column in bound.items()])


def _one(graph, t: Triple, g: str | None) -> DataFrame:
    rows = graph.match(None if _is_var(t.p) else t.p)
    if g is None:
        rows = rows.where(F.col("g").isNull())
    elif g != ANY:
        rows = rows.where(F.col("g").isNotNull())
    terms = [(t.s, F.col("s")), (_name(t.o), F.col(_part(t.o)))]
    if _is_var(t.p):
        terms.insert(1, (t.p, F.col("p")))
    return _bind(rows, terms, g)


def _stars(graph, triples: list[Triple], g: str | None) -> list[tuple[set[str], DataFrame]]:
    """Answer triples that share a subject together where the graph can, others one by one."""
    groups: dict[str, list[Triple]] = {}
    for t in triples:
        groups.setdefault(t.s, []).append(t)
    out = []
    for subject, members in groups.items():
        fusable = [t for t in members if not _is_var(t.p)]
        predicates = [t.p for t in fusable]
        wide = None
        if len(fusable) > 1 and len(set(predicates)) == len(predicates) and g is not None:
            wide = graph.star(predicates, any_graph=g == ANY)
        if wide is None:
            out += [(t.variables(), _one(graph, t, g)) for t in members]
            continue
        if g != ANY:
            wide = wide.where(F.col("g").isNotNull())
        terms = [(subject, F.col("s"))]
        terms += [(_name(t.o), F.col(f"v{i}.{_part(t.o)}")) for i, t in enumerate(fusable)]
        used = set().union(*[t.variables() for t in fusable])
        out.append((used, _bind(wide, terms, g)))
        out += [(t.variables(), _one(graph, t, g)) for t in members if _is_var(t.p)]
    return out


def bgp(graph, triples: list[Triple], g: str | None = ANY) -> DataFrame:
    """Solutions of a basic graph pattern.

    ``g`` names where to look: ``"?name"`` one named graph for the whole pattern, bound to the
    variable; an IRI that named graph; ``ANY`` each triple in any graph; None the default graph,
    which holds the quads without a graph name (none, unless somebody put them there).

    Triples join where they share variables, connected ones first, beginning with the one of the most
    constants; unconnected groups are multiplied last (see :func:`product`).
    """
    if not triples:
        raise ValueError("a pattern needs at least one triple")
    parts = _stars(graph, triples, g)
    if g is not None and g != ANY and _is_var(g):
        parts = [(used | {g}, rows) for used, rows in parts]
    # fewer variables, more constants: the likely most selective one to begin with
    seen, rows = parts.pop(min(range(len(parts)), key=lambda i: len(parts[i][0])))
    while parts:
        best = max(range(len(parts)), key=lambda i: len(parts[i][0] & seen))
        used, nxt = parts.pop(best)
        shared = sorted(v[1:] for v in used & seen)
        rows = rows.join(nxt, shared, "inner") if shared else product(rows, nxt)
        seen = seen | used
    return rows

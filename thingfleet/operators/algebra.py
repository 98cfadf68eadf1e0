"""Graph-pattern algebra on solution tables: one column per variable, NULL means unbound."""

from __future__ import annotations

from functools import reduce
from itertools import product as combinations_of

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.term_order import sort_key
from ..session import cut

def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equi-join on all shared variables, which must be bound on both sides."""
    keys = shared(a, b)
    return a.join(b, keys, "inner") if keys else product(a, b)


def _rows_hash(df: DataFrame) -> Column:
    """A hash of the whole row, also where a column has a type that hashes don't take."""
    return F.xxhash64(F.to_json(F.struct("*"))) if df.columns else F.xxhash64(F.lit(0))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` with every row of ``b``.

    Each side is dealt into as many blocks as the square root of the shuffle partitions, and each block
    goes to the tasks of all blocks of the other side: an equi-join on the two block numbers. A task
    holds a block of either side, whatever their sizes; the result is as large as it has to be.
    """
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(2, round(parts**0.5))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.withColumn("__i", F.pmod(_rows_hash(a), F.lit(n)).cast("int")).withColumn("__j", every)
    right = b.withColumn("__j", F.pmod(_rows_hash(b), F.lit(n)).cast("int")).withColumn("__i", every)
    return left.join(right, ["__i", "__j"]).select(*a.columns, *b.columns)


def _on(a: DataFrame, b: DataFrame, keys: list[str], cond: Column | None):
    """Right side with its shared variables renamed, and the join condition."""
    right = reduce(lambda d, k: d.withColumnRenamed(k, f"__r_{k}"), keys, b)
    tests = [F.col(k) == F.col(f"__r_{k}") for k in keys] + ([cond] if cond is not None else [])
    return right, reduce(Column.__and__, tests)


def optional(
    a: DataFrame,
    b: DataFrame,
    cond: Column | None = None,
    left_unbound: list[str] | None = None,
    right_unbound: list[str] | None = None,
) -> DataFrame:
    """Left join; ``cond`` is a filter inside the optional part, so it is part of the join.

    A shared variable that is unbound on either side agrees with every value. The lists say which may be
    unbound (by default all): with none it is one left join, else the joined rows and the rows of ``a``
    that agree with nothing.
    """
    keys = shared(a, b)
    if not keys:
        raise ValueError("an optional part must share a variable with the rest")
    left, right_ = _maybe(keys, left_unbound), _maybe(keys, right_unbound)
    if left or right_:
        met = compat_join(a, b, left, right_)
        met = met if cond is None else met.where(cond)
        return met.unionByName(not_exists(a, b, cond, left, right_), allowMissingColumns=True)
    if cond is None:
        return a.join(b, keys, "left")
    right, on = _on(a, b, keys, cond)
    return a.join(right, on, "left").drop(*[f"__r_{k}" for k in keys])


def _maybe(keys: list[str], unbound: list[str] | None) -> list[str]:
    return keys if unbound is None else [k for k in keys if k in unbound]


def theta(a: DataFrame, b: DataFrame, cond: Column) -> DataFrame:
    """Join on the shared variables and any further comparison between the two sides."""
    keys = shared(a, b)
    if not keys:
        return product(a, b).where(cond)
    right, on = _on(a, b, keys, cond)
    return a.join(right, on, "inner").drop(*[f"__r_{k}" for k in keys])


def exists(
    a: DataFrame,
    b: DataFrame,
    cond: Column | None = None,
    left_unbound: list[str] | None = None,
    right_unbound: list[str] | None = None,
) -> DataFrame:
    """Rows of ``a`` that agree with some row of ``b``; an unbound shared variable agrees with any value."""
    return _semi(a, b, cond, left_unbound, right_unbound)[0]


def not_exists(
    a: DataFrame,
    b: DataFrame,
    cond: Column | None = None,
    left_unbound: list[str] | None = None,
    right_unbound: list[str] | None = None,
) -> DataFrame:
    return _semi(a, b, cond, left_unbound, right_unbound)[1]


def _semi(
    a: DataFrame, b: DataFrame, cond: Column | None, left_unbound: list[str] | None, right_unbound: list[str] | None
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``a`` that agree with a row of ``b``, and those that agree with none.

    One equi-join per choice of unbound variables; each looks only at the rows that the choices before it
    left without a match.
    """
    keys = shared(a, b)
    if not keys and cond is not None:
        raise ValueError("an existence test with a filter must share a variable with the rest")
    left, right = _maybe(keys, left_unbound), _maybe(keys, right_unbound)
    found, missed = [], []
    for lmask in _null_masks(left):
        rest = _with_mask(a, left, lmask)
        for rmask in _null_masks(right):
            on = [k for k in keys if k not in lmask and k not in rmask]
            other = _with_mask(b, right, rmask)
            if cond is not None:
                other, tests = _on(a, other, keys, cond)
                test = reduce(Column.__and__, [F.col(k) == F.col(f"__r_{k}") for k in on] + [cond])
                if not on:  # the filter alone connects the two sides: pairs are made block by block
                    numbered = cut(rest.withColumn("__row", F.monotonically_increasing_id()))
                    hit = product(numbered, other).where(cond).select("__row").distinct()
                    found.append(numbered.join(hit, "__row", "left_semi").select(*a.columns))
                    rest = numbered.join(hit, "__row", "left_anti").select(*a.columns)
                    continue
                found.append(rest.join(other, test, "left_semi"))
                rest = rest.join(other, test, "left_anti")
            elif on:
                other = other.select(*on).distinct()
                found.append(rest.join(other, on, "left_semi").select(*a.columns))
                rest = rest.join(other, on, "left_anti").select(*a.columns)
            else:  # any row agrees: all of them if there is one
                one = F.broadcast(other.limit(1).select(F.lit(1).alias("__one")))
                rest = rest.withColumn("__one", F.lit(1))
                found.append(rest.join(one, "__one", "left_semi").select(*a.columns))
                rest = rest.join(one, "__one", "left_anti").select(*a.columns)
        missed.append(rest)
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, missed)


def _null_masks(variables: list[str]) -> list[frozenset[str]]:
    """Every choice of which of ``variables`` are unbound."""
    return [
        frozenset(v for v, off in zip(variables, choice) if off)
        for choice in combinations_of((False, True), repeat=len(variables))
    ]


def _with_mask(df: DataFrame, variables: list[str], unbound: frozenset[str]) -> DataFrame:
    for v in variables:
        df = df.where(F.col(v).isNull() if v in unbound else F.col(v).isNotNull())
    return df


def compat_join(
    a: DataFrame,
    b: DataFrame,
    left_unbound: list[str] | None = None,
    right_unbound: list[str] | None = None,
) -> DataFrame:
    """Join where an unbound variable is compatible with every value.

    ``left_unbound`` and ``right_unbound`` say which shared variables may be NULL on each side;
    by default all of them. The join splits into one equi-join per combination of bound
    variables, so no condition with OR reaches the planner. A combination with no variable
    bound on both sides is a :func:`product`.
    """
    keys = shared(a, b)
    left, right = _maybe(keys, left_unbound), _maybe(keys, right_unbound)
    out = []
    for lmask in _null_masks(left):
        for rmask in _null_masks(right):
            la, rb = _with_mask(a, left, lmask), _with_mask(b, right, rmask)
            on = [k for k in keys if k not in lmask and k not in rmask]
            renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__r_{k}"), keys, rb)
            if on:
                tests = [F.col(k) == F.col(f"__r_{k}") for k in on]
                part = la.join(renamed, reduce(Column.__and__, tests), "inner")
            else:
                part = product(la, renamed)
            merged = [
                F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if c in keys else F.col(c)
                for c in a.columns
            ]
            rest = [F.col(c) for c in b.columns if c not in keys]
            out.append(part.select(*merged, *rest))
    return reduce(DataFrame.unionByName, out)


def minus(
    a: DataFrame,
    b: DataFrame,
    left_unbound: list[str] | None = None,
    right_unbound: list[str] | None = None,
) -> DataFrame:
    """Drop solutions of ``a`` that agree with one of ``b`` on a variable bound in both."""
    keys = shared(a, b)
    if not keys:
        return a
    left, right = _maybe(keys, left_unbound), _maybe(keys, right_unbound)
    out = []
    for lmask in _null_masks(left):
        rows = _with_mask(a, left, lmask)
        for rmask in _null_masks(right):
            on = [k for k in keys if k not in lmask and k not in rmask]
            if on:
                gone = _with_mask(b, right, rmask).select(*on).distinct()
                rows = rows.join(gone, on, "left_anti").select(*a.columns)
        out.append(rows)
    return reduce(DataFrame.unionByName, out)


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; a variable one side lacks is unbound there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def values(
    a: DataFrame, names: list[str], rows: list[tuple], left_unbound: list[str] | None = None
) -> DataFrame:
    """Join with inline data written in the query; None is an undefined value.

    Variables of ``a`` may be unbound too, by default all; without a common variable it is a product.
    """
    schema = ", ".join(f"`{n}` {dict(a.dtypes).get(n, 'string')}" for n in names)
    data = a.sparkSession.createDataFrame(rows, schema)
    keys = shared(a, data)
    if not keys:
        return product(a, data)
    gaps = [n for i, n in enumerate(names) if any(r[i] is None for r in rows)]
    return compat_join(a, data, left_unbound=_maybe(keys, left_unbound), right_unbound=gaps)


def federate(a: DataFrame, remote: DataFrame) -> DataFrame:
    """Join local solutions with solutions computed over another table."""
    return join(a, remote)


def ask(rows: DataFrame) -> bool:
    return not rows.limit(1).isEmpty()


def ask_rows(rows: DataFrame) -> DataFrame:
    """The answer as a one-row table, computed without reading everything."""
    return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def construct(rows: DataFrame, template: list[tuple[Column, Column, Column, str]]) -> DataFrame:
    """A triple per template entry and solution; incomplete ones are dropped, each kept once.

    A template entry is ``(subject, predicate, object, kind of object)``.
    """
    built = [
        F.struct(
            s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind")
        )
        for s, p, o, kind in template
    ]
    triples = rows.select(F.explode(F.array(*built)).alias("t")).select("t.*")
    return triples.dropna(subset=["s", "p", "o"]).distinct()


def describe(quads: DataFrame, resources: DataFrame, rounds_cut: bool = True) -> DataFrame:
    """Quads about the resources in column ``s``, following blank nodes to their quads.

    Only blank nodes not seen before enter the next round, so the loop ends when a round finds
    none, however deep the nesting.
    """
    found = quads.join(resources.select("s").distinct(), "s", "left_semi")
    nodes = found.where("o_kind = 'bnode'").select("g", F.col("o").alias("s")).distinct()
    seen = None
    if rounds_cut:
        nodes = cut(nodes)
    parts = [found]
    while not nodes.isEmpty():
        nxt = quads.join(nodes, ["g", "s"], "left_semi")
        parts.append(nxt)
        seen = nodes if seen is None else seen.unionByName(nodes)
        nodes = nxt.where("o_kind = 'bnode'").select("g", F.col("o").alias("s")).distinct()
        nodes = nodes.join(seen, ["g", "s"], "left_anti")
        if rounds_cut:
            nodes = cut(nodes)
    return reduce(DataFrame.unionByName, parts).select(*quads.columns).distinct()


def order_solutions(rows: DataFrame, *terms: Column | tuple) -> DataFrame:
    """Sort by terms: a column as it is, or the parts of a term, ``(value, kind)`` or ``(value, kind, datatype,
    language)``, sorted by :func:`thingfleet.functions.term_order.sort_key`; a last part ``"desc"`` turns the order."""
    keys: list[Column] = []
    for t in terms:
        if isinstance(t, tuple):
            down = isinstance(t[-1], str) and t[-1] == "desc"
            key = sort_key(*(t[:-1] if down else t))
            keys.append(key.desc() if down else key)
        else:
            keys.append(t)
    return rows.orderBy(*keys)


def slice_solutions(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


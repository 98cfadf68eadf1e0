"""What two loads of graphs differ in, whatever their blank nodes are called and in which order they come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import QUAD_COLS, QUAD_KEY
from ..session import kept, passing


def _table(df: DataFrame) -> DataFrame:
    return kept(df, "graph-diff")


def _blank(c: str) -> Column:
    return F.col(c).startswith("_:") if c == "s" else (F.col("o_kind") == "bnode")


def _value() -> Column:
    """A hash of all that a quad says but for its graph, subject and the name of a blank object."""
    # a hash passes over nulls, so a type and a language of the same text need a mark each
    marked = [c for k in ("o_dt", "o_lang") for c in (F.col(k).isNull(), F.col(k))]
    return F.xxhash64("p", "o_kind", F.when(~_blank("o"), F.col("o")), *marked)


def _halves(h: Column) -> list[Column]:
    """Two numbers whose sums stand for the sum of ``h`` and overflow only beyond 2**31 rows."""
    return [F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


#: Bits of the filter of graphs; what it keeps by mistake costs time and changes nothing.
FILTER_BITS = 1 << 25


def unequal(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The quads of both sides of all graphs that may differ: equal ones are left out by a signature.

    A blank node is signed by what it says and where it hangs, a graph by its nodes and its other quads. Where no
    blank node leads to another one, equal signatures are equal graphs; the other graphs all stay. Only numbers are
    shuffled. The graphs to keep become a bitmap of fixed size, so the quads themselves pass without a shuffle.
    """
    row = lambda node, h, deep: F.struct(node.alias("node"), h.alias("h"), deep.alias("deep"))
    s, o, no = _blank("s"), _blank("o"), F.lit(False)
    rows = F.array(
        F.when(s, row(F.xxhash64("s"), F.xxhash64(F.lit("says"), _value()), o)),
        F.when(o, row(F.xxhash64("o"), F.xxhash64(F.lit("hangs"), F.when(~s, F.col("s")), "p"), s)),
        F.when(~s & ~o, row(F.lit(None).cast("long"), F.xxhash64(F.col("s"), _value()), no)),
    )
    signed = None
    for sign, quads in ((1, old), (-1, new)):
        told = quads.select(F.xxhash64("g").alias("g"), F.explode(rows).alias("r")).where("r is not null")
        told = told.select("g", "r.node", "r.deep", *(x.alias(f"h{i}") for i, x in enumerate(_halves(F.col("r.h")))))
        nodes = told.groupBy("g", "node").agg(F.sum("h0").alias("h0"), F.sum("h1").alias("h1"), F.max("deep").alias("deep"))
        whole = _halves(F.xxhash64(F.col("node").isNull(), "h0", "h1"))
        part = nodes.select("g", "deep", *((x * sign).alias(f"h{i}") for i, x in enumerate(whole)))
        signed = part if signed is None else signed.unionByName(part)
    differ = signed.groupBy("g").agg(F.sum("h0").alias("h0"), F.sum("h1").alias("h1"), F.max("deep").alias("deep")).where("deep or h0 <> 0 or h1 <> 0")
    place = F.pmod("g", F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = differ.select(word, place.alias("place")).groupBy("word").agg(F.bit_or(bit).alias("bits"))
    words = F.broadcast(_table(words))

    def kept_of(quads: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("g"), F.lit(FILTER_BITS))
        asked = quads.select(*QUAD_COLS, place.alias("place")).withColumn("word", F.shiftright("place", 6))
        return _table(asked.join(words, "word").where(F.col("bits").bitwiseAND(bit) != 0).select(*QUAD_COLS))

    return kept_of(old), kept_of(new)


def _coloured(quads: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """:func:`colours` with ``called``, a hash of the least value of the predicates ``names``."""
    is_bnode = _blank("o")
    named = F.when(F.col("p").isin(*names), F.struct("p", "o")) if names else F.lit(None).cast("struct<p:string,o:string>")
    row = lambda node, said, deep, called: F.struct(node.alias("node"), said.alias("said"), deep.alias("deep"), called.alias("called"))
    none, empty = F.lit(None).cast("long"), F.lit(None).cast("struct<p:string,o:string>")
    rows = F.array(
        F.when(_blank("s"), row(F.col("s"), F.when(~is_bnode, _value()), is_bnode, named)),
        F.when(is_bnode, row(F.col("o"), none, F.lit(False), empty)),
    )
    told = quads.select(*by, F.explode(rows).alias("r")).where("r is not null").select(*by, "r.*")
    total = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    flat = _table(
        told.groupBy(*by, "node").agg(
            F.xxhash64(total(F.col("said"))).alias("colour"),
            F.max("deep").alias("deep"),
            F.xxhash64(F.min("called")).alias("called"),
        )
    )
    deep = flat.where("deep").select(*by, "node", "colour")
    if deep.isEmpty():
        return flat.drop("deep")
    # only nodes above other blank nodes change their colour
    said = _table(quads.where(_blank("s") & is_bnode).select(*by, F.col("s").alias("node"), _value().alias("said"), F.col("o").alias("to")))
    still = flat.where("not deep").select(*by, "node", "colour")
    now, seen = deep, deep.select(*by, "colour").distinct().count()
    while True:
        other = still.unionByName(now).select(*by, F.col("node").alias("to"), F.col("colour").alias("seen"))
        parts = said.join(other, [*by, "to"]).select(*by, "node", F.xxhash64("said", "seen").alias("h"))
        own = now.select(*by, "node", F.xxhash64("colour", F.lit("own")).alias("h"))
        now = _table(parts.unionByName(own).groupBy(*by, "node").agg(F.xxhash64(total(F.col("h"))).alias("colour")))
        apart = now.select(*by, "colour").distinct().count()
        if apart <= seen:
            break
        seen = apart
    return _table(still.unionByName(now).join(flat.select(*by, "node", "called"), [*by, "node"]))


def colours(quads: DataFrame, by: list[str]) -> DataFrame:
    """``*by, node, colour`` of every blank node: equal for nodes of equal content, within each group of ``by``.

    Colour refinement: a node's colour is a hash of its own last one and of the sum over its quads of what each says
    and its object's colour. What it says itself is summed once; rounds over the quads between blank nodes go on
    while they tell more nodes apart. Sums combine before the shuffle, so a node of very many quads is spread.
    Rounds are cut with written tables.
    """
    return _coloured(quads, by, []).drop("called")


def _paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``g, old, new``: nodes of both sides of equal ``keys``, first with first, second with second."""
    order = Window.partitionBy("g", *keys).orderBy("colour", "node")
    numbered = lambda d, name: d.select("g", *keys, F.row_number().over(order).alias("no"), F.col("node").alias(name))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("g", *keys, "no")]
    met = numbered(old, "old").alias("a").join(numbered(new, "new").alias("b"), reduce(lambda x, y: x & y, same))
    return met.select("a.g", "old", "new")


def matched(old: DataFrame, new: DataFrame, names: list[str]) -> DataFrame:
    """``g, old, new``: which blank node of the new graphs stands for which of the old ones.

    From the named nodes down: objects of one predicate of nodes that stand for each other are paired, first those
    of equal colour, then those of equal values of the predicates ``names``, then the rest in the order of their
    colours. Blank nodes that no named node leads to are paired by colour alone. A node is paired once.
    """
    both = old.select(F.lit("old").alias("v"), *QUAD_COLS).unionByName(new.select(F.lit("new").alias("v"), *QUAD_COLS))
    known = _coloured(both, ["v", "g"], names)
    links = both.where(_blank("o")).select("v", "g", F.col("s").alias("up"), "p", F.col("o").alias("node"))
    links = _table(links.join(known, ["v", "g", "node"]))
    pairs: DataFrame | None = None
    # nodes on the level above, by their old and new names
    roots = links.where(~F.col("up").startswith("_:")).select("g", F.col("up").alias("old"), F.col("up").alias("new")).distinct()
    front = _table(roots)
    while True:
        side = {}
        for v in ("old", "new"):
            above = front.select("g", F.col(v).alias("up"), F.col("old").alias("place"))
            below = links.where(F.col("v") == v).join(above, ["g", "up"]).drop("v", "up")
            if pairs is not None:
                below = below.join(pairs.select("g", F.col(v).alias("node")), ["g", "node"], "left_anti")
            # a node below several is looked at below one of them
            side[v] = _table(below.groupBy("g", "node", "colour", "called").agg(F.min(F.struct("place", "p")).alias("w")).select("g", "node", "colour", "called", "w.*"))
        found = None
        for keys in (["place", "p", "colour"], ["place", "p", "called"], ["place", "p"]):
            left = {v: d if found is None else d.join(found.select("g", F.col(v).alias("node")), ["g", "node"], "left_anti") for v, d in side.items()}
            more = _table(_paired(left["old"], left["new"], keys))
            found = more if found is None else found.unionByName(more)
        if found.isEmpty():
            break
        pairs, front = found if pairs is None else _table(pairs.unionByName(found)), found
    rest = {v: known.where(F.col("v") == v).drop("v") for v in ("old", "new")}
    if pairs is None:
        return _table(_paired(rest["old"], rest["new"], ["colour"]))
    rest = {v: d.join(pairs.select("g", F.col(v).alias("node")), ["g", "node"], "left_anti") for v, d in rest.items()}
    return pairs.unionByName(_table(_paired(rest["old"], rest["new"], ["colour"])))


#: Quads of a side that are compared in one turn.
QUADS_A_TURN = 50_000_000


def graph_diff(old: DataFrame, new: DataFrame, names: list[str] | None = None, turns: int | None = None) -> DataFrame:
    """``change`` (``removed`` or ``added``) and the quad, for every quad of only one of two sets of quads.

    Blank nodes count by what they say and where they hang (:func:`matched`), not by their names; a removed quad
    bears the names of ``old``, an added one those of ``old`` where its nodes have a partner there. One changed value
    in a nested node is one quad removed and one added. Graphs that only one side has differ whole. Predicates of
    ``names`` tell sibling nodes apart whose content has changed.

    Graphs are independent, so they are dealt into ``turns`` (by default one for every ``QUADS_A_TURN`` quads), each of
    which reads both sides, writes its differences and leaves nothing else on disk. All graphs are compared.
    """
    if turns is None:
        turns = max(1, -(-max(old.count(), new.count()) // QUADS_A_TURN))
    found = None
    for turn in range(turns):
        mine = F.pmod(F.hash("g"), F.lit(turns)) == turn
        sides = (old, new) if turns == 1 else (old.where(mine), new.where(mine))
        with passing(old.sparkSession):
            part = kept(_difference(*sides, names or []), "graph-diff", stay=True)
        found = part if found is None else found.unionByName(part)
    return found


def _difference(old: DataFrame, new: DataFrame, names: list[str]) -> DataFrame:
    """:func:`graph_diff` in one turn."""
    old, new = unequal(old, new)
    pairs = matched(old, new, names)

    def renamed(rows: DataFrame, c: str) -> DataFrame:
        by_new = pairs.select("g", F.col("new").alias(c), F.col("old").alias("__same"))
        own = F.concat(F.lit("_:new-"), F.substr(F.col(c), F.lit(3)))
        return rows.join(by_new, ["g", c], "left").withColumn(c, F.coalesce("__same", own)).drop("__same")

    # only what bears a blank node is shuffled to find its other name
    at = [F.coalesce(_blank(c), F.lit(False)) for c in ("s", "o")]
    told = None
    for blank in ((False, False), (False, True), (True, False), (True, True)):
        part = new.where((at[0] == blank[0]) & (at[1] == blank[1]))
        for c in (c for c, b in zip(("s", "o"), blank) if b):
            part = renamed(part, c)
        told = part.select(*QUAD_COLS) if told is None else told.unionByName(part.select(*QUAD_COLS))
    new = _table(told)
    # one join finds both: what is met by nothing on the other side stands alone
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in QUAD_KEY))
    here = lambda d, side: d.select(*QUAD_COLS, F.lit(True).alias("here")).alias(side)
    alone = here(old, "a").join(here(new, "b"), same, "full").where("a.here IS NULL OR b.here IS NULL")
    gone = F.col("a.here").isNotNull()
    return alone.select(
        F.when(gone, "removed").otherwise("added").alias("change"),
        *[F.when(gone, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in QUAD_COLS],
    )

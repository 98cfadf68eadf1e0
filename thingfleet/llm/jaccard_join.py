"""Exact Jaccard join of word n-gram sets that skips by block and by what similar sets have answered."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bloom_of, by_batch, components, grams, is_empty, rows_of, stored, text_word_hashes

#: A pair is linked when ``100 * common >= PERCENT * union``.
PERCENT = 85
#: Classes, and shingles of them, in a block; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Neighbours a set is compared with in a round.
NEIGHBOURS = 8
#: Lists of more entries carry the sketches of their sets, so that pairs that cannot be linked never leave the join.
SHORT_LIST = 8
#: 64-bit words of a sketch.
SKETCH = 8


def shingle_sets(texts: list[str | None], k: int = 4) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its ``k``-word shingles; the whole sequence as one
    when it is shorter, nothing without words."""
    words = text_word_hashes(texts)
    flat = grams(np.concatenate(words), k)
    out, at = [], 0
    for w in words:
        n = len(w)
        if n >= k:
            out.append(np.unique(flat[at : at + n - k + 1]))
        else:
            out.append(grams(w, n) ^ np.uint64(n) if n else w)
        at += n
    return out


class Frequent:
    """A mergeable summary (after Misra and Gries) of shingle counts: ``size`` counters, whatever the input;
    a shingle of more than one in ``size`` of all is never missed."""

    def __init__(self, size: int = 1 << 16):
        self.size = size
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([self.counts, counts])).astype(np.int64)
        if len(keys) > self.size:
            counts = counts - np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def frequent_shingles(docs: DataFrame, k: int = 4, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent shingles over all documents.

    They only set the order in which shingles are looked up; any order gives the same result, so the bound
    ``most`` on what is sent to the tasks drops nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Frequent()
        for b in batches:
            if b.num_rows:
                words = text_word_hashes(b.column(0).to_pylist())
                # the few runs over the border of two texts are next to nothing among the frequent ones
                keys, counts = np.unique(grams(np.concatenate(words), k), return_counts=True)
                top.add(keys[counts > 1], counts[counts > 1])
        if len(top.keys):
            yield pa.RecordBatch.from_arrays([pa.array(top.keys.view(np.int64)), pa.array(top.counts)], names=["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = counts.where("n >= 4").orderBy(F.desc("n"), "token").limit(most).toArrow()
    keys = got.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("n").to_numpy()[order]


def prefix_lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """How many of its first shingles a set of ``n`` must look up (as the larger one) and offer (as the smaller).

    Two linked sets share at least ``percent`` of the larger one, and of two equal sizes a share of
    ``2 * percent / (100 + percent)`` of the smaller one, so one common shingle lies in both prefixes.
    """
    probe = n - -(-percent * n // 100) + 1
    offer = n - -(-2 * percent * n // (100 + percent)) + 1
    return probe, offer


def parities(s: np.ndarray) -> bytes:
    """For each of two to four bits a shingle, a power of two of them, whether an odd number of shingles falls on it."""
    size = max(64, 2 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of a set in a fixed number of bits."""
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def odd_bits(a: bytes, b: bytes) -> int:
    """In how many bits two parities differ, the longer one folded to the shorter: two sets differ in as many shingles at least."""
    size, x, y = 8 * min(len(a), len(b)), int.from_bytes(a, "little"), int.from_bytes(b, "little")
    width = 8 * max(len(a), len(b))
    if len(a) < len(b):
        x, y = y, x
    while width > size:
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return (x ^ y).bit_count()


def signatures(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], k: int = 4, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, set_key`` (128 bits of the set), ``prefix``, rare shingles first, ``parities`` and ``sketch``."""

    keys, counts = order

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, set_keys, prefixes, odd, short = [], [], [], [], []
            sets = shingle_sets(rows_of(b, "text"), k)
            flat = np.concatenate(sets)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                seen = np.where(keys[at] == flat, counts[at], 0)
            at = 0
            for s in sets:
                n.append(len(s))
                set_keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                odd.append(parities(s))
                short.append(sketch(s))
                own = seen[at : at + len(s)] if len(keys) else s
                at += len(s)
                if len(keys) and own.any():
                    s = s[np.argsort(own, kind="stable")]
                prefixes.append(s[: prefix_lengths(len(s), percent)[0] if len(s) else 0].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    *(b.column(0), pa.array(n, pa.int64()), pa.array(set_keys, pa.binary())),
                    *(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(odd, pa.binary())),
                    pa.array(short, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "prefix", "parities", "sketch"],
            )

        return one

    read = docs.select(F.col("doc_id").cast("long"), "text")
    return by_batch(read, make, "doc_id long, n_shingles long, set_key binary, prefix array<long>, parities binary, sketch array<long>")


def _possible(nx: Column, i: Column, ny: Column, j: Column, percent: int) -> Column:
    """Whether sets of ``nx <= ny`` shingles whose first common one stands at ``i`` and ``j`` can be linked."""
    most = F.least(nx - i, ny - j)
    return (100 * nx >= percent * ny) & ((100 + percent) * most >= percent * (nx + ny))


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs(x, y)`` whose parities leave a link possible: no linked pair is lost, and few others are left."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            both = b.column(2).to_numpy()
            odd = np.fromiter(map(odd_bits, rows_of(b, "px"), rows_of(b, "py")), dtype=np.int64, count=b.num_rows)
            return b.select(["x", "y"]).filter(pa.array((100 + percent) * (both - odd) >= 2 * percent * both))

        return one

    x, y = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("parities").alias(f"p{c}")) for c in ("x", "y"))
    return by_batch(pairs.join(x, "x").join(y, "y").select("x", "y", (F.col("nx") + F.col("ny")).alias("both"), "px", "py"), make, "x long, y long")


def verified(pairs: DataFrame, docs: DataFrame, k: int = 4, percent: int = PERCENT) -> DataFrame:
    """The linked ones of ``pairs(x, y)`` of documents with ``common`` and ``union`` counts.

    Only texts that a filter of fixed size lets through are shuffled.
    """
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    wanted = bloom_of(ids, "id")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = b.column(0).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            return b.filter(pa.array(keep & wanted.has(at)))

        return one

    texts = by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, text string")

    def compare() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            xs, ys = (shingle_sets(rows_of(b, c), k) for c in ("tx", "ty"))
            for x, y, sx, sy in zip(rows_of(b, "x"), rows_of(b, "y"), xs, ys):
                both = np.concatenate([sx, sy])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                union = len(both) - common
                if union and 100 * common >= percent * union:
                    rows.append({"x": x, "y": y, "common": common, "union": union})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        return one

    schema = pa.schema([(c, pa.int64()) for c in ("x", "y", "common", "union")])
    tx, ty = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
    return by_batch(pairs.join(tx, "x").join(ty, "y").select("x", "y", "tx", "ty"), compare, "x long, y long, common long, union long")


def similar_sets(docs: DataFrame, k: int = 4, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``members``: ``doc_id, n_shingles, class_id`` of every row; ``links(x, y, common, union)``: all links
    between classes; ``counts(node, n_links)``: of each class that has any, their exact number;
    ``groups(node, component)``. Links and counts are worked out when they are read.

    * Equal sets are one class, named by its smallest ``doc_id``.
    * Shingles are looked up rare first; the index holds, for every shingle, the classes that offer it,
      dealt by blocks of size, with the position in the set. A probe reads only the blocks whose sizes can
      match and skips entries whose positions leave too few shingles for a link.
    * Answers come in rounds. In each, a set is compared with a few neighbours of other groups in its lists, so
      linked sets grow together in few rounds however many there are. A set has the answers of the sets it is
      linked with: pairs whose link is known from them are not compared again. When a round finds few links,
      the last one compares every remaining pair the index gives, so no link between groups is lost.
    * A pair is compared by the parities of its sets first (:func:`near_enough`), some bits a shingle; the texts
      are read only of those that may still be linked.
    * All links lie inside the groups then. A group whose pairs are all answered has them; the others are
      compared block by block, each set as what it differs in from one of its block (:func:`overlaps`).

    Null ``doc_id`` and rows without words link with nothing. Rows of one ``doc_id`` with different texts
    should not occur; each row keeps the class of its own text.
    """
    sets = stored(signatures(docs, frequent_shingles(docs, k), k, percent), "shingle-sets")
    usable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("prefix", "parities", "sketch")))
    classes = stored(classes, "shingle-classes")
    members = sets.join(classes.select("set_key", "rep"), "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("class_id")
    )
    entries = classes.select("rep", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "token"))
    order = Window.partitionBy("token").orderBy("n", "rep")
    listed = (
        entries.withColumn("before", F.lag("rep").over(order))
        .withColumn("after", F.lead("rep").over(order))
        .where("before is not null or after is not null")
        .drop("after")
    )
    listed = stored(listed, "shingle-lists")

    lists = listed.drop("before").withColumn("g", F.col("rep"))
    links = tried = known = None
    for turn in itertools.count():
        near = stored(_neighbours(lists, percent, tried, turn), "pairs")
        got = stored(verified(stored(near_enough(near, classes, percent), "near-pairs"), docs, k, percent), "links")
        tried = near if tried is None else tried.unionByName(near)
        links = got if links is None else links.unionByName(got)
        known = stored(_groups(links), "groups")
        placed = lists.drop("g", "entries").join(known.withColumnRenamed("node", "rep"), "rep", "left")
        placed = stored(placed.withColumn("g", F.coalesce("component", "rep")).drop("component"), "placed-lists")
        mixed = placed.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("entries")).where("lo <> hi").select("token", "entries")
        lists = stored(placed.join(stored(mixed, "mixed-tokens"), "token"), "mixed-lists")
        # few new links: the rest is for the last round
        if 20 * got.count() <= near.count():
            break
    # sizes of a link differ by one block at most; the margin covers rounding of the logarithm
    size = F.log(F.col("n")) / F.log(F.lit(100 / percent))
    # in a long list most sets cannot be linked with most others, and their sketches tell
    lists = lists.join(classes.select("rep", "sketch"), "rep").withColumn("s", F.when(F.col("entries") > SHORT_LIST, F.col("sketch"))).drop("sketch", "entries")
    offers = lists.where((100 + percent) * (F.col("n") - F.col("i")) >= 2 * percent * F.col("n")).select(
        "token", F.floor(size).alias("block"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("g").alias("gx"), F.col("s").alias("sx")
    )
    probes = lists.withColumn("block", F.explode(F.sequence(F.floor(size - 1 - 1e-6), F.floor(size + 1e-6))))
    odd = sum((F.bit_count(F.get("sx", F.lit(k)).bitwiseXOR(F.get("s", F.lit(k)))) for k in range(1, SKETCH)), F.bit_count(F.get("sx", F.lit(0)).bitwiseXOR(F.get("s", F.lit(0)))))
    pairs = (
        offers.join(probes, ["token", "block"])
        .where(
            ((F.col("nx") < F.col("n")) | ((F.col("nx") == F.col("n")) & (F.col("x") < F.col("rep"))))
            & (F.col("gx") != F.col("g"))
            & _possible(F.col("nx"), F.col("ix"), F.col("n"), F.col("i"), percent)
            & (F.col("s").isNull() | ((100 + percent) * (F.col("nx") + F.col("n") - odd) >= 2 * percent * (F.col("nx") + F.col("n"))))
        )
        .select("x", F.col("rep").alias("y"))
        .distinct()
    )
    pairs = stored(near_enough(pairs, classes, percent), "pairs")
    if not is_empty(pairs):
        links = links.unionByName(stored(verified(pairs, docs, k, percent), "links"))
        known = stored(_groups(links), "groups")
    answered, pairs_of = _blocks(classes, links, known, docs, k, percent)
    every = answered.unionByName(_compared(pairs_of, k, percent))
    ends = answered.select(F.explode(F.array("x", "y")).alias("node"), F.lit(1).cast("long").alias("n_links"))
    counts = ends.unionByName(_compared(pairs_of, k, percent, only_counts=True)).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return members, every, counts, known


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """``[i, j]``: how many elements ``left[i]`` and ``right[j]`` (sorted, distinct) share.

    Each set is taken as its difference from the first one: what two sets differ in follows from their own
    differences and what these share, so similar sets cost what tells them apart, not what they hold.
    """
    lead, same = left[0], left is right
    off = [[np.setxor1d(s, lead, assume_unique=True) for s in side] for side in ([left] if same else [left, right])]
    if same:
        values, times = np.unique(np.concatenate(off[0]), return_counts=True)
        tokens = values[times > 1]
        off.append(off[0])
    else:
        tokens = np.intersect1d(*(np.unique(np.concatenate(side)) for side in off))

    def marks(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, rows = np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.searchsorted(tokens, flat)
        hit = tokens[np.minimum(at, len(tokens) - 1)] == flat
        at, rows = at[hit], rows[hit]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    both = np.zeros((len(left), len(right)), dtype=np.int64)
    if len(tokens):
        found = [marks(off[0])]
        found.append(found[0] if same else marks(off[1]))
        for a in range(0, len(tokens), width):
            parts = []
            for (at, rows), n in zip(found, both.shape):
                lo, hi = np.searchsorted(at, [a, a + width])
                part = np.zeros((n, min(width, len(tokens) - a)), dtype=np.float32)
                part[rows[lo:hi], at[lo:hi] - a] = 1
                parts.append(part)
            both += (parts[0] @ parts[1].T).astype(np.int64)
    own, other = (np.array([len(s) - len(d) for s, d in zip(side, ds)], dtype=np.int64) for side, ds in zip((left, right), off))
    return (own[:, None] + other[None, :] + 2 * both) // 2


UNIT = ("component", "c1", "p1", "c2", "p2")


def _blocks(classes: DataFrame, links: DataFrame, groups: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The links of the groups whose every pair is a known link, and of all other groups the pairs of blocks
    that can hold links, with the texts of their classes: ``UNIT``, ``side``, ``node``, ``text``.

    A group is cut into cells by size, whose neighbours alone can be linked, and cells into blocks by hash,
    so a group of any size is many pairs of blocks.
    """
    links = links.dropDuplicates(["x", "y"]).join(groups.withColumnRenamed("node", "x"), "x")
    sized = groups.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    have = links.groupBy("component").agg(F.count("*").alias("have"))
    state = sized.groupBy("component").agg(F.count("*").alias("of")).join(have, "component", "left")
    state = state.select("component", (2 * F.coalesce("have", F.lit(0)) == F.col("of") * (F.col("of") - 1)).alias("answered"))
    state = stored(state, "group-states")
    answered = links.join(state.where("answered"), "component").select("x", "y", "common", "union")

    # linked sizes differ by less than one cell
    cell = F.floor(F.log("n") / F.log(F.lit(100 / percent)) * 0.999999)
    sized = sized.join(state.where("not answered"), "component").select("component", "node", "n", cell.alias("cell"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    cells = stored(sized.groupBy("component", "cell").agg(parts.alias("parts")), "group-cells")
    placed = sized.join(cells, ["component", "cell"]).select(
        "component", "cell", F.pmod(F.xxhash64("node", F.lit("block")), "parts").alias("part"), "node"
    )
    blocks = cells.select("component", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    one = blocks.withColumnsRenamed({"cell": "c1", "part": "p1"})
    two = blocks.withColumnsRenamed({"cell": "c2", "part": "p2"})
    same = (F.col("c1") == F.col("c2")) & (F.col("p1") <= F.col("p2"))
    units = one.join(two, "component").where(same | (F.col("c2") == F.col("c1") + 1))
    sides = units.select(*UNIT, F.col("c1").alias("cell"), F.col("p1").alias("part"), F.lit(0).alias("side")).unionByName(
        units.where("c1 <> c2 or p1 <> p2").select(*UNIT, F.col("c2").alias("cell"), F.col("p2").alias("part"), F.lit(1).alias("side"))
    )
    placed = stored(placed, "group-blocks")
    here = placed.join(stored(sides, "block-pairs"), ["component", "cell", "part"]).select(*UNIT, "side", "node")
    wanted = bloom_of(placed, "node")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = b.column(0).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            return b.filter(pa.array(keep & wanted.has(at)))

        return one

    texts = by_batch(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")), make, "node long, text string")
    return answered, here.join(texts, "node").select(*UNIT, "side", "node", "text")


def _compared(pairs_of: DataFrame, k: int, percent: int, only_counts: bool = False) -> DataFrame:
    """All links of the pairs of blocks, or how many each class has in each of them."""

    def answer(sides: list[dict[int, np.ndarray]]) -> pa.RecordBatch:
        nodes = [np.array(list(s), dtype=np.int64) for s in sides if s]
        sets = [list(s.values()) for s in sides if s]
        ids, sizes = [nodes[0], nodes[-1]], [np.array([len(s) for s in x], dtype=np.int64) for x in (sets[0], sets[-1])]
        common = overlaps(sets[0], sets[-1])
        union = sizes[0][:, None] + sizes[1][None, :] - common
        linked = 100 * common >= percent * union
        if len(sets) == 1:
            linked = np.triu(linked, 1)
        if only_counts:
            n = [linked.sum(1), linked.sum(0)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(n).astype(np.int64))], names=["node", "n_links"])
        i, j = np.nonzero(linked)
        x, y, nx, ny = ids[0][i], ids[1][j], sizes[0][i], sizes[1][j]
        turn = (nx > ny) | ((nx == ny) & (x > y))
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x, y, common[i, j], union[i, j])], names=["x", "y", "common", "union"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, [{}, {}]
        for b in batches:
            sets = shingle_sets(rows_of(b, "text"), k) if b.num_rows else []
            for *key, side, node, s in zip(*(rows_of(b, c) for c in (*UNIT, "side", "node")), sets):
                if key != unit:
                    if len(sides[0]) + len(sides[1]) > 1:
                        yield answer(sides)
                    unit, sides = key, [{}, {}]
                sides[side][node] = s
        if len(sides[0]) + len(sides[1]) > 1:
            yield answer(sides)

    schema = "node long, n_links long" if only_counts else "x long, y long, common long, union long"
    dealt = pairs_of.repartition(*UNIT).sortWithinPartitions(*UNIT)
    out = dealt.mapInArrow(run, schema)
    return out.where("n_links > 0") if only_counts else out


def _neighbours(lists: DataFrame, percent: int, tried: DataFrame | None, turn: int) -> DataFrame:
    """``x, y``: for each class the ``NEIGHBOURS`` of other groups that most often stand just before it in the lists,
    among those that can be linked and were not compared yet. A list gives four candidates an entry at most;
    sets of one size stand in another order at each turn, so that all of a large group get to stand near each other."""
    order = Window.partitionBy("token").orderBy("n", F.xxhash64("rep", F.lit(turn)))
    here = F.struct("rep", "n", "i", "g")
    before = [F.lag(here, k).over(order).alias(f"b{k}") for k in (1, 2, 4, 8)]
    seen = lists.select("rep", "n", "i", "g", *before).select("rep", "n", "i", "g", F.explode(F.array("b1", "b2", "b4", "b8")).alias("b"))
    met = seen.where(
        F.col("b").isNotNull() & (F.col("b.g") != F.col("g")) & _possible(F.col("b.n"), F.col("b.i"), F.col("n"), F.col("i"), percent)
    )
    best = F.slice(F.sort_array(F.collect_list(F.struct("count", "x")), asc=False), 1, NEIGHBOURS)
    counted = met.groupBy(F.col("b.rep").alias("x"), F.col("rep").alias("y")).count()
    if tried is not None:
        counted = counted.join(tried, ["x", "y"], "left_anti")
    return counted.groupBy("y").agg(best.alias("best")).select(F.explode("best.x").alias("x"), "y")


def _groups(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))


def grouped(docs: DataFrame, k: int = 4, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row of ``docs``, and ``n_links``: with how many
    classes its own is linked."""
    members, _, counts, groups = similar_sets(docs, k, percent)
    placed = groups.join(stored(counts, "link-counts"), "node", "left")
    return members.join(placed, members.class_id == placed.node, "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )

"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

The universe of shingles is the numbers of 32 bits. One permutation of it is applied to a shingle's hash; a second
one, shifted circularly by ``k``, gives coordinate ``k`` of a set's signature: the least value over its shingles.
So two permutations make any number of coordinates, and two sets agree in each with the probability of their
Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, by_batch, components, is_empty, mixed, rows_of, stored
from .jaccard_join import shingle_sets

#: A pair is linked when ``100 * common >= PERCENT * union``.
PERCENT = 80
#: With 32 bands of 4 coordinates a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, WIDTH = 32, 4
_AT_ONCE = 1 << 16
#: Bits of a parity sketch.
PARITY = 1024


def _permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: odd factors and folded shifts can be undone."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """``[set, coordinate]`` of sets of 64-bit hashes; all ones for an empty set. A few thousand shingles are worked
    on at a time, so a set of any size takes little memory."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((coordinates, len(sets)), 0xFFFFFFFF, dtype=np.uint32)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    flat = _permuted((flat >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    for at in range(0, len(flat), _AT_ONCE):
        part, own = flat[at : at + _AT_ONCE], owner[at : at + _AT_ONCE]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        here = slice(own[0], own[-1] + 1)
        full = len(starts) == own[-1] + 1 - own[0]
        for k in range(coordinates):
            least = np.minimum.reduceat(_permuted(part + np.uint32(k), 0x21F0AAAD, 0x735A2D97), starts)
            if full:
                np.minimum(out[k, here], least, out=out[k, here])
            else:  # an empty set lies between
                out[k, own[starts]] = np.minimum(out[k, own[starts]], least)
    return out.T


def band_keys(signature: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One 64-bit key per set and band, of its number and coordinates."""
    parts = signature[:, : bands * width].reshape(len(signature), bands, width).astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(width):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys


def parities(sets: list[np.ndarray], bits: int = PARITY) -> np.ndarray:
    """Of each set, for each of ``bits`` classes of shingles, whether it holds an odd number of them, as 64-bit words.

    What two sketches differ in is at most what the sets differ in.
    """
    out = np.zeros((len(sets), bits), dtype=np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def _list_column(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def signed(docs: DataFrame, k: int = 4, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands`` of every row: 128 bits of its set, and its band keys (none when empty)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(rows_of(b, "text"), k)
            keys = band_keys(signatures(sets, bands * width), bands, width).view(np.int64)
            lists = _list_column([keys[i] if len(s) else keys[i][:0] for i, s in enumerate(sets)])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

        return one

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return by_batch(read, make, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``rep, n, key, shingles, parity`` of the documents ``ids(rep)``, and of some more that a filter of fixed size lets
    through. ``key`` tells apart different texts under one id."""
    wanted = bloom_of(ids, "rep")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
            at = b.column(0).fill_null(0).to_numpy().astype(np.int64)
            keep = b.column(0).is_valid().to_numpy(zero_copy_only=False) & wanted.has(at.view(np.uint64))
            if not keep.any():
                return None
            b = b.filter(pa.array(keep))
            sets = shingle_sets(rows_of(b, "text"), k)
            keys = [xxhash.xxh3_64_intdigest(s.tobytes(), seed=d & 0xFFFFFFFF) for s, d in zip(sets, rows_of(b, "doc_id"))]
            return pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                    _list_column([s.view(np.int64) for s in sets]),
                    _list_column(list(parities(sets))),
                ],
                names=["rep", "n", "key", "shingles", "parity"],
            )

        return one

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return by_batch(read, make, "rep long, n long, key long, shingles array<long>, parity array<long>").where("n > 0")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs(x, y)``, on their full sets."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            sides = []
            for c in ("sx", "sy"):
                column = b.column(b.schema.get_field_index(c))
                sides.append((column.values.to_numpy(), column.offsets.to_numpy()))
            (vx, ox), (vy, oy) = sides
            linked = []
            for i in range(b.num_rows):
                both = np.concatenate([vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            return b.select(["x", "y"]).filter(pa.array(linked))

        return one

    right = sets.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("shingles").alias("sy"))
    left = sets.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("shingles").alias("sx"))
    met = pairs.join(right, "y").join(left, "x").where(_sizes_fit(F.col("nx"), F.col("ny"), percent))
    return by_batch(met.select("x", "y", "sx", "sy"), make, "x long, y long").distinct()


def _sizes_fit(nx: Column, ny: Column, percent: int) -> Column:
    return (100 * nx >= percent * ny) & (100 * ny >= percent * nx)


def _with_leaders(near: DataFrame, turn: int, tried: DataFrame | None, percent: int) -> DataFrame:
    """``x, y``: each set with the leader of a band that it shares most bands with, among those of other groups
    that it was not compared with. A band's leader changes with every turn; a set is in one pair of its own."""
    by_turn = F.xxhash64("rep", F.lit(turn))
    lead = near.groupBy("band").agg(
        F.min_by(F.struct("rep", "n", "g"), by_turn).alias("lead"), F.min("g").alias("low"), F.max("g").alias("high")
    )
    met = (
        near.join(lead.where("low <> high").select("band", "lead"), "band")
        .where((F.col("g") != F.col("lead.g")) & _sizes_fit(F.col("n"), F.col("lead.n"), percent))
        .select("rep", F.least("rep", "lead.rep").alias("x"), F.greatest("rep", "lead.rep").alias("y"))
        .groupBy("rep", "x", "y")
        .count()
    )
    if tried is not None:
        met = met.join(tried, ["x", "y"], "left_anti")
    best = met.groupBy("rep").agg(F.max_by(F.struct("x", "y"), F.struct("count", "x", "y")).alias("p"))
    return best.select("p.x", "p.y").distinct()


def _by_rare_shingles(sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """``x, y`` of different groups that can be linked by their rarest shingles: all links are among them.

    ``sets(key, rep, n, g, private, parity)`` and ``shared(token, key, many)``, the shingles that more than one set
    holds and how many do. Of two linked sets the rare-first prefixes meet, and the place of the shingle bounds what
    they can have in common. Shingles of one set alone come first and meet nothing. The sketches bound from below
    what two sets differ in, so of a large group of copies few pairs that are not linked leave the join.
    """
    listed = shared.join(sets, "key").select("key", "rep", "n", "g", "private", F.struct("many", "token").alias("t"))
    ordered = listed.groupBy("key", "rep", "n", "g", "private").agg(F.sort_array(F.collect_set("t")).alias("t"))
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = F.slice("t", 1, F.greatest(probe - F.col("private"), F.lit(0)).cast("int"))
    entries = ordered.select("rep", "n", "g", "private", "key", F.posexplode(prefix).alias("i", "t")).select(
        "key", F.col("t.token").alias("token"), F.col("rep"), F.col("n"), F.col("g"), (F.col("i") + F.col("private")).alias("i")
    )
    entries = stored(entries, "rare-shingles")
    mixed_lists = entries.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("token")
    entries = stored(entries.join(mixed_lists, "token").join(sets.select("key", "parity"), "key").drop("key"), "rare-lists")
    other = entries.select("token", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "g", "i", "parity")))
    most = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    enough = (100 + percent) * most >= percent * (F.col("n") + F.col("n2"))
    words = (F.bit_count(F.get("parity", w).bitwiseXOR(F.get("parity2", w))) for w in range(PARITY // 64))
    differ = reduce(lambda a, b: a + b, words)
    like = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n2"))
    pairs = entries.join(other, "token").where((F.col("rep") < F.col("rep2")) & (F.col("g") != F.col("g2")) & _sizes_fit(F.col("n"), F.col("n2"), percent) & enough & like)
    return pairs.select(F.col("rep").alias("x"), F.col("rep2").alias("y")).distinct()


def grouped(docs: DataFrame, k: int = 4, percent: int = PERCENT, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row of ``docs``.

    * Equal sets are one class, named by its smallest ``doc_id``; copies meet in that aggregate alone.
    * Sets that share a band with another one are candidates; all others link with nothing (a link of similarity
      ``percent`` is overlooked with the probability given at ``BANDS``).
    * A candidate with too many shingles of its own can't be linked and leaves.
    * In turns every candidate is compared with one leader of another group, which joins large groups in work that
      grows with their members. When turns find few links, the pairs left are those of different groups whose
      rarest shingles meet; each is compared. Every link is confirmed on the full sets.

    A null ``doc_id`` and a row without words link with nothing and are their own class and component. Rows of
    one ``doc_id`` are one document: all of them are in the group of any of their texts. Other columns are not
    read. An empty table gives an empty one. Texts are hashed by batches, so a very long one only costs its own
    shingles.
    """
    sets = stored(signed(docs, k, bands, width), "signed-sets")
    usable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "set-classes")
    lone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    members = sets.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left").select(
        "doc_id", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id")
    )
    entries = classes.select("rep", "n", F.explode("bands").alias("band"))
    busy = entries.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    near = stored(entries.join(busy, "band").withColumn("g", F.col("rep")), "band-lists")
    # texts of one document are linked, whatever they say
    several = members.where("class_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y"), F.min("doc_id").alias("d"))
    same_doc = members.where("class_id is not null").join(several.where("x <> y").select("doc_id", "x"), "doc_id").select("x", F.col("class_id").alias("y"))
    links = stored(same_doc.where("x <> y").distinct(), "links")

    if not is_empty(near):
        active = stored(_sets_of(docs, near.select("rep").distinct(), k), "candidate-sets")
        tokens = active.select("key", F.explode("shingles").alias("token"))
        held = stored(tokens.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("many")), "candidate-shingles")
        own = held.where("low = high").groupBy(F.col("low").alias("key")).agg(F.count("*").alias("private"))
        placed = active.join(own, "key", "left").withColumn("private", F.coalesce("private", F.lit(0).cast("long")))
        chosen = stored(placed.where(100 * (F.col("n") - F.col("private")) >= percent * F.col("n")), "sets-to-compare")
        near = near.drop("g").join(chosen.select("rep").distinct(), "rep", "left_semi")
        groups, tried, turn = _groups(links), None, 0
        while True:
            placed = stored(_in_groups(near, groups), "grouped-bands")
            pairs = stored(_with_leaders(placed, turn, tried, percent), "leader-pairs")
            found = stored(verified(pairs, chosen, percent), "links")
            links = links.unionByName(found)
            tried = pairs if tried is None else tried.unionByName(pairs)
            groups = _groups(links)
            turn += 1
            if 25 * found.count() <= pairs.count():
                break
        light = _in_groups(chosen.drop("shingles").dropDuplicates(["key"]), groups)  # a row may be there twice
        shared = tokens.join(held.where("low <> high").select("token", "many"), "token")
        rest = _by_rare_shingles(light, shared, percent).join(tried, ["x", "y"], "left_anti")
        links = links.unionByName(stored(verified(stored(rest, "rare-pairs"), chosen, percent), "links"))
    groups = _groups(links)
    return members.join(groups, members.class_id == groups.node, "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )


def _groups(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, rows.rep == groups.node, "left").withColumn("g", F.coalesce("component", "rep")).drop("node", "component")

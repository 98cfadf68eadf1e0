"""Removal of long repeated byte strings by suffix sorting in two stages, over blocks that share their middle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Bloom, bloom_of, by_batch, is_empty, mixed, rows_of, stored

LENGTH = 400
GRAM = 32
#: Ends every string in a joint text: no byte of UTF-8, larger than any.
STOP = 0xFF


# Suffix sorting -------------------------------------------------------------------------------


def small_suffixes(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; in a run of one byte the end of the run decides,
    and the last suffix is larger than the empty one."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(change, np.arange(n - 1))
    less = np.zeros(n, dtype=bool)
    inside = at < len(change)
    ends = change[np.minimum(at, max(len(change) - 1, 0))] if len(change) else np.zeros(n - 1, dtype=np.int64)
    less[:-1][inside] = (t[ends] < t[np.minimum(ends + 1, n - 1)])[inside]
    return less


def sorted_directly(text: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes: all by 16 bytes at once, then those that tie among themselves."""
    w = np.frombuffer(text + bytes(24), dtype=np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        w = (w[:-width] << np.uint64(8 * width)) | w[width:]
    first, second = w[at], w[at + 8]
    order = np.lexsort((second, first))
    at, first, second = at[order], first[order], second[order]
    tied = np.concatenate([[False], (first[1:] == first[:-1]) & (second[1:] == second[:-1]), [False]])
    edges = np.flatnonzero(np.diff(tied.astype(np.int8)))
    out = at.tolist()
    for a, b in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
        out[a:b] = sorted(out[a:b], key=lambda i: text[i + 16 : i + depth])
    return np.array(out, dtype=np.int64)


def suffix_array(text: bytes, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes.

    Stage one sorts the suffixes smaller than their successors directly. Stage two scans the buckets of first
    bytes upwards: a suffix before a sorted one that is larger than its successor takes the next place of
    its bucket, runs of one byte wave by wave.
    """
    t = np.frombuffer(text, dtype=np.uint8)
    if len(t) < 2:
        return np.arange(len(t))
    direct = sorted_directly(text, np.flatnonzero(small_suffixes(t)), depth)
    of_byte = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([len(t) - 1]))
    out = []
    for c in range(256):
        large = []
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        while len(wave):
            large.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
        bucket = np.concatenate([*large, direct[of_byte[c] : of_byte[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = t[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length, up to ``depth``, of what each suffix of ``order`` shares with the next one."""
    padded = np.frombuffer(text + b"\0" * (depth + 16), dtype=np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(max(len(order) - 1, 0), dtype=np.int64)
    live = np.arange(len(out))
    for at in range(0, depth, 8):
        same = (words[order[live] + at] == words[order[live + 1] + at]).astype(np.uint8)
        stop = same.argmin(axis=1)
        whole = same.all(axis=1)
        out[live] += np.where(whole, 8, stop)
        live = live[whole]
        if not len(live):
            break
    return np.minimum(out, depth)


def repeated_starts(pieces: list[tuple[bytes, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each ``(bytes, number of starts)``, which of its first starts begin a ``length``-byte string that
    also begins elsewhere in the pieces."""
    text = b"".join(p + bytes([STOP]) for p, _ in pieces)
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p, _ in pieces])])
    valid = np.zeros(len(text), dtype=bool)
    for (_, n), at in zip(pieces, first):
        valid[at : at + n] = True
    order = suffix_array(text, length)
    order = order[valid[order]]
    equal = common_prefixes(text, order, length) >= length
    found = np.zeros(len(text), dtype=bool)
    found[order[:-1][equal]] = True
    found[order[1:][equal]] = True
    return [found[at : at + n] for (_, n), at in zip(pieces, first)]


# Blocks ---------------------------------------------------------------------------------------


def _words8(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one integer."""
    w = t.astype(np.uint64)
    for shift in (1, 2, 4):
        w = w[: len(w) - shift] | (w[shift:] << np.uint64(8 * shift))
    return w


def anchors(t: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """For each start of a ``length``-byte string the place of its smallest gram hash, the last of equal ones."""
    w = _words8(t)
    n = len(t) - gram + 1
    h = w[:n].copy()
    for k in range(8, gram, 8):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    place = np.uint64((1 << 26) - 1)
    h = (mixed(h) & ~place) | (place - np.arange(n, dtype=np.uint64))
    size = length - gram + 1
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - size + 1
    best = np.minimum(behind[:starts], ahead[size - 1 : size - 1 + starts])
    return (place - (best & place)).astype(np.int64)


def blocks(t: np.ndarray, length: int, block: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that belong together: their first start, their number, and the first byte of the core,
    the bytes that every string of the block holds. Which starts these are and where the core lies depends
    on the content of each string alone, so equal strings lie in blocks with equal cores."""
    if len(t) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    p = anchors(t, length, gram)
    s = np.arange(len(p))
    part = (p - s) // block
    cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(part) != 0)) + 1
    first = np.concatenate([[0], cut])
    number = np.diff(np.concatenate([first, [len(p)]]))
    return first, number, p[first] - part[first] * block


PLACES = "array<struct<doc_id: long, row_key: long, at: int>>"


def segments(docs: DataFrame, length: int, block: int) -> DataFrame:
    """``key, seg, n, places``: blocks of starts; ``key`` hashes the core, ``seg`` all bytes of the block's
    strings and where the core lies in them. Equal blocks of some thousand rows are one row already, so a
    very common block is few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64, size = xxhash.xxh3_64_intdigest, length - block + 1
        key: list[int] = []
        seg: list[int] = []
        docs_: list[int | None] = []
        rows_: list[int] = []
        at: list[int] = []
        n: list[int] = []

        def flush() -> pa.RecordBatch:
            keys, segs = np.array(key, dtype=np.uint64).view(np.int64), np.array(seg, dtype=np.uint64).view(np.int64)
            order = np.lexsort((segs, keys))
            keys, segs = keys[order], segs[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (segs[1:] != segs[:-1])]))
            ends = np.append(first, len(keys)).astype(np.int32)
            take = pa.array(order)
            places = pa.StructArray.from_arrays(
                [pa.array(docs_, pa.int64()).take(take), pa.array(rows_, pa.int64()).take(take), pa.array(at, pa.int32()).take(take)],
                names=["doc_id", "row_key", "at"],
            )
            numbers = np.array(n, dtype=np.int32)[order][first]
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys[first]), pa.array(segs[first]), pa.array(numbers), pa.ListArray.from_arrays(pa.array(ends), places)],
                names=["key", "seg", "n", "places"],
            )
            for column in (key, seg, docs_, rows_, at, n):
                column.clear()
            return out

        for b in batches:
            for doc, row, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                view = memoryview(raw)
                firsts, numbers, cores = (x.tolist() for x in blocks(np.frombuffer(raw, dtype=np.uint8), length, block))
                key += [h64(view[c : c + size]) for c in cores]
                seg += [h64(view[a : a + k + length - 1], seed=(c - a) & 0xFFFF) for a, k, c in zip(firsts, numbers, cores)]
                docs_ += [doc] * len(firsts)
                rows_ += [row] * len(firsts)
                at += firsts
                n += numbers
                if len(key) > 100_000:
                    yield flush()
        if key:
            yield flush()

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string"))
    return read.mapInArrow(run, f"key long, seg long, n int, places {PLACES}")


def _piece_schema(text: str) -> str:
    return f"key long, seg long, copies long, n int, {text}"


def repeated_in_blocks(pieces: DataFrame, length: int, chunk: int) -> DataFrame:
    """``seg, key, spans``: of every distinct block its starts (half-open runs) that begin a repeated string.

    ``pieces`` has one row per distinct block with its bytes and how many copies it stands for. All blocks
    of a key lie in one partition, sorted; whole keys are joined into texts of about ``chunk`` bytes, each
    sorted by its suffixes. A block standing for several copies repeats in all its starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = repeated_starts([(p[4], p[3]) for p in held], length)
            spans = []
            for p, f in zip(held, found):
                if p[2] > 1:
                    f = np.ones(p[3], dtype=bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
                spans.append(edge.tolist())
            out = pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in held], pa.int64()), pa.array([p[1] for p in held], pa.int64()), pa.array(spans, pa.list_(pa.int32()))],
                names=["key", "seg", "edges"],
            )
            held.clear()
            return out

        for b in batches:
            for row in zip(*(rows_of(b, c) for c in ("key", "seg", "copies", "n", "piece"))):
                if size >= chunk and row[0] != held[-1][0]:
                    yield flush()
                    size = 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield flush()

    dealt = pieces.repartition("key").sortWithinPartitions("key", "seg")
    return dealt.mapInArrow(run, "key long, seg long, edges array<int>")


def repeated_by_hash(starts: DataFrame) -> DataFrame:
    """``key, seg, edges`` as :func:`repeated_in_blocks`, of ``starts`` with one row per start of a piece and the
    128-bit hash of its string: equal strings are counted, so a key of any size needs no task of its own."""
    counted = starts.groupBy("key", "h1", "h2").agg(F.sum("copies").alias("times")).where("times > 1").select("key", "h1", "h2")
    twice = starts.join(stored(counted, "suffix-hot-strings"), ["key", "h1", "h2"])
    found = twice.groupBy("key", "seg").agg(F.sort_array(F.collect_list("start")).alias("starts"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            edges = []
            for found_ in rows_of(b, "starts"):
                s = np.array(found_, dtype=np.int64)
                cut = np.flatnonzero(np.diff(s) != 1)
                edges.append(np.stack([s[np.append(0, cut + 1)], s[np.append(cut, len(s) - 1)] + 1], axis=1).ravel().tolist())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(edges, pa.list_(pa.int32()))], names=["key", "seg", "edges"])

        return one

    return by_batch(found, make, "key long, seg long, edges array<int>")


def chosen_rows(wanted: Bloom, keep: bool = True) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """A batch function that passes the rows whose ``row_key`` (the second column) the filter has, or the others."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array(wanted.has(b.column(1).to_numpy().astype(np.int64).view(np.uint64)) == keep))

        return one

    return make


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string"))


KEYED = "doc_id long, row_key long, text string"


def same_row() -> Column:
    return F.col("row_key").eqNullSafe(F.col("row2")) & F.col("doc_id").eqNullSafe(F.col("doc2"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, block: int = 128, chunk: int = 1 << 20, hot: int = 1 << 23) -> DataFrame:
    """``doc_id, row_key, spans``: the runs of bytes that repeated strings cover, sorted, as ``start * 2**32 + end``,
    of each document that has any; they may overlap.

    1. Starts of ``length``-byte strings are cut into blocks by content, and blocks meet by the hash of
       their core; a core met once has no repeat and leaves the data as a few bytes of hash.
    2. Equal blocks are one piece with its number of copies, so thousands of copies sort as one. The bytes
       of the pieces are taken from the texts that have them.
    3. The pieces of each core are sorted by their suffixes; neighbours that share ``length`` bytes repeat.
       A core whose blocks have more than ``hot`` bytes, as of a passage with different text around it in very
       many documents, fits no sort: each of its strings is dealt and counted by its hash instead.
    4. Runs of repeated starts go back to all copies and join into runs of bytes.
    """
    by_key = Window.partitionBy("key").orderBy("seg")
    found = segments(docs, length, block)
    found = found.withColumn("before", F.lag("n").over(by_key)).withColumn("after", F.lead("n").over(by_key))
    met = found.where("before is not null or after is not null or size(places) > 1").drop("before", "after")
    met = stored(met, "suffix-blocks")
    one = F.min(F.struct(F.array_min("places").alias("p"), "n")).alias("one")

    def asked(blocks_: DataFrame, name: str) -> DataFrame:
        pieces = blocks_.groupBy("key", "seg").agg(F.sum(F.size("places")).alias("copies"), one).select("key", "seg", "copies", "one.p.*", "one.n")
        work = pieces.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("key", "seg", "copies", "at", "n")).alias("todo"))
        work = stored(work.select(F.col("doc_id").alias("doc2"), F.col("row_key").alias("row2"), "todo"), name)
        texts = by_batch(_keyed(docs), chosen_rows(bloom_of(work, "row2")), KEYED).dropDuplicates(["doc_id", "row_key"])
        return texts.join(work, same_row()).select("text", "todo")

    heavy = met.groupBy("key").agg(F.sum(F.col("n") + F.lit(length)).alias("bytes")).where(F.col("bytes") > hot)
    heavy = stored(heavy.select("key"), "suffix-hot")
    any_heavy = not is_empty(heavy)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, todo in zip(rows_of(b, "text"), rows_of(b, "todo")):
                raw = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(todo), 20_000):
                    rows = todo[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array([r[c] for r in rows], pa.int64()) for c in ("key", "seg", "copies")),
                            pa.array([r["n"] for r in rows], pa.int32()),
                            pa.array([raw[r["at"] : r["at"] + r["n"] + length - 1] for r in rows], pa.binary()),
                        ],
                        names=["key", "seg", "copies", "n", "piece"],
                    )

    def take_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("key", "seg", "copies", "h1", "h2")), ("start", pa.int32())])
        for b in batches:
            for text, todo in zip(rows_of(b, "text"), rows_of(b, "todo")):
                view = memoryview(text.encode("utf-8", "surrogatepass"))
                for at in range(0, len(todo), 500):
                    rows = todo[at : at + 500]
                    n = [r["n"] for r in rows]
                    digests = b"".join(xxhash.xxh3_128_digest(view[a : a + length]) for r in rows for a in range(r["at"], r["at"] + r["n"]))
                    h = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                    columns = [np.repeat(np.array([r[c] for r in rows], dtype=np.int64), n) for c in ("key", "seg", "copies")]
                    start = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (*columns, h[:, 0], h[:, 1], start))], schema=schema)

    cold = met.join(heavy, "key", "left_anti") if any_heavy else met
    cut = asked(cold, "suffix-work").mapInArrow(take, _piece_schema("piece binary"))
    repeats = stored(repeated_in_blocks(cut, length, chunk).where(F.size("edges") > 0), "suffix-repeats")
    if any_heavy:
        strings = asked(met.join(heavy, "key", "left_semi"), "suffix-hot-work").mapInArrow(take_strings, "key long, seg long, copies long, h1 long, h2 long, start int")
        repeats = repeats.unionByName(stored(repeated_by_hash(stored(strings, "suffix-hot-starts")), "suffix-hot-repeats"))
    # a run of bytes as one number, so that it sorts as a number
    pair = F.transform(
        F.sequence(F.lit(0), F.size("edges") - 2, F.lit(2)),
        lambda i: F.shiftleft((F.col("p.at") + F.get("edges", i)).cast("long"), 32)
        + (F.col("p.at") + F.get("edges", i + 1) + F.lit(length - 1)).cast("long"),
    )
    runs = met.join(repeats, ["key", "seg"]).select("edges", F.explode("places").alias("p")).select("p.doc_id", "p.row_key", pair.alias("runs"))
    by_doc = runs.groupBy("doc_id", "row_key").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("spans"))
    return stored(by_doc, "suffix-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = 128) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of every row of ``docs``: the runs of bytes removed (half-open,
    apart and sorted) and the remaining bytes.

    A byte goes when a ``length``-byte string over it also begins anywhere else, in another row or in the
    same text. Matches never cross rows. Null text is empty; shorter texts stay; repeated rows are each
    other's copies and lose all they share. Bytes are those of UTF-8, so ``kept`` may begin inside a
    character. Only the texts that lose something are shuffled.
    """
    spans = repeated_spans(docs, length, block)
    touched = bloom_of(spans, "row_key")
    marks = spans.select(F.col("doc_id").alias("doc2"), F.col("row_key").alias("row2"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            todo = rows_of(b, "spans") if "spans" in b.schema.names else [None] * b.num_rows
            for text, spans_ in zip(rows_of(b, "text"), todo):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for s in spans_ or []:
                    a, z = s >> 32, s & 0xFFFFFFFF
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([a, z])
                parts, at = [], 0
                for a, z in runs:
                    parts.append(raw[at:a])
                    at = z
                n.append(len(raw))
                removed.append([{"start": a, "end": z} for a, z in runs])
                kept.append(b"".join([*parts, raw[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    schema = "doc_id long, n_bytes long, removed array<struct<start: int, end: int>>, kept binary"
    hit = by_batch(_keyed(docs), chosen_rows(touched), KEYED).join(marks, same_row(), "left").select("doc_id", "text", "spans")
    rest = by_batch(_keyed(docs), chosen_rows(touched, keep=False), KEYED).select("doc_id", "text")
    return hit.mapInArrow(cut, schema).unionByName(rest.mapInArrow(cut, schema))

"""Benchmark passages in documents, found by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, bloom_of, by_batch, grams, rows_of, stored, utf8, word_hashes

#: Words are runs of digits, letters and bytes outside ASCII; A to Z become a to z, all else parts words.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
WINDOW = 13


def only_words(text: str | None) -> bytes:
    return utf8(text).translate(WORD_BYTES)


def words_of(text: str | None) -> list[bytes]:
    return only_words(text).split()


def shape(span: int) -> tuple[int, int]:
    """Words per gram and grams per window such that two equal runs of ``span`` words always select one
    fingerprint in common: the window of a run of ``span`` words holds all its grams."""
    k = span // 2 + 1
    return k, span - k + 1


def winnow(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams chosen for a run of words: in every window of grams the one with the
    smallest hash, the last of equal ones. Depends on the window alone, so equal runs choose alike."""
    k, w = shape(span)
    g = grams(hashes, k)
    if len(g) < w:
        return np.zeros(0, dtype=np.int64), g[:0]
    best, at = g.copy()[: len(g) - w + 1], np.arange(len(g) - w + 1)
    for i in range(1, w):
        other = g[i : i + len(best)]
        less = other <= best
        best = np.where(less, other, best)
        at = np.where(less, np.arange(i, i + len(best)), at)
    at = np.unique(at)
    return at, g[at] ^ np.uint64(span * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


FOUND = "array<struct<fp: long, at: int, span: int, before: array<string>, after: array<string>>>"


def _context(words: list[bytes], at: int, span: int) -> dict:
    """The words around a gram that windows through it can reach, the ones before it nearest first."""
    k, w = shape(span)
    text = [x.decode("utf-8", "surrogatepass") for x in words[max(0, at - w + 1) : at + k + w - 1]]
    here = min(at, w - 1)
    return {"at": at, "span": span, "before": text[:here][::-1], "after": text[here:]}


def fingerprints(docs: DataFrame, spans: list[int], known: Bloom | None = None) -> DataFrame:
    """``doc_id, n_words, row_key, found``: the chosen fingerprints of each row for each length of window.

    With ``known``, only those that a filter of fixed size lets through, which leaves few rows to shuffle.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, found = [], []
            texts = rows_of(b, "text")
            for text, hashes in zip(texts, word_hashes([only_words(t) for t in texts])):
                rows, words = [], None
                for span in spans:
                    at, fps = winnow(hashes, span)
                    if known is not None and len(fps):
                        keep = known.has(fps)
                        at, fps = at[keep], fps[keep]
                    if len(fps) and words is None:
                        words = words_of(text)
                    rows += [{"fp": int(f), **_context(words, int(a), span)} for a, f in zip(at, fps.view(np.int64))]
                n.append(len(hashes))
                found.append(rows)
            kind = pa.list_(
                pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("span", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
            )
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(found, kind)], names=["doc_id", "row_key", "n_words", "found"]
            )

        return one

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return by_batch(read, make, f"doc_id long, row_key long, n_words long, found {FOUND}")


def benchmark_fingerprints(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``fp, span, before, after, items``: what each item chooses, equal contexts of several items as one row.

    An item of fewer words than ``window``, but not none, is a window of its own length.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for item, text in zip(rows_of(b, "item_id"), rows_of(b, "text")):
                words = words_of(text)
                if words:
                    span = min(window, len(words))
                    at, fps = winnow(word_hashes([only_words(text)])[0], span)
                    rows += [{"item": item, "fp": int(f), **_context(words, int(a), span)} for a, f in zip(at, fps.view(np.int64))]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        return one

    schema = pa.schema(
        [("item", pa.string()), ("fp", pa.int64()), ("at", pa.int32()), ("span", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]
    )
    read = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    made = by_batch(read, make, "item string, fp long, at int, span int, before array<string>, after array<string>")
    return made.groupBy("fp", "span", "before", "after").agg(F.collect_set("item").alias("items"))


def _equal_from(a: str, b: str) -> Column:
    """How many words two lists share from their first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop == 0, F.size(same)).otherwise(stop.cast("int") - 1)


def _covered(runs: Column) -> Column:
    """Number of positions that sorted half-open ``(a, b)`` runs cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], r["b"]).alias("end")
    )
    return F.aggregate(runs, start, step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, hits, item_ids, n_hit, row_key``.

    ``hits`` are the runs of words (half-open, may overlap) that benchmark windows cover, ``item_ids`` the
    items, sorted as strings, with a window in the text. Winnowing on both sides chooses a common
    fingerprint inside every shared window; the two tables meet on fingerprints, and each hit is extended
    word by word on both sides, which also rules out equal hashes of different words. Null texts have no
    words; null ``item_id`` are no items; repeated rows of either table count once in ``item_ids``;
    an empty benchmark leaves all clean. Columns besides the ones named are left out.

    Hot passages: the join is a plain equi-join, which Spark may split; items with the same words around a
    fingerprint are one row, so documents do not multiply by copies of an item.
    """
    tests = stored(benchmark_fingerprints(items, window), "benchmark-fingerprints")
    spans = sorted(r["span"] for r in tests.select("span").distinct().collect())
    known = bloom_of(tests, "fp", 1 << 22)
    rows = stored(fingerprints(docs, spans, known), "document-fingerprints")
    ours = rows.where(F.size("found") > 0).select("doc_id", "row_key", F.explode("found").alias("f")).select("doc_id", "row_key", "f.*")
    theirs = tests.select("fp", "span", F.col("before").alias("b2"), F.col("after").alias("a2"), "items")
    left, right = _equal_from("before", "b2"), _equal_from("after", "a2")
    k = F.floor(F.col("span") / 2).cast("int") + 1
    hit = (
        ours.join(theirs, ["fp", "span"])
        .withColumn("l", left)
        .withColumn("r", right)
        .where((F.col("r") >= k) & (F.col("l") + F.col("r") >= F.col("span")))
        .select("doc_id", "row_key", (F.col("at") - F.col("l")).alias("a"), (F.col("at") + F.col("r")).alias("b"), "items")
    )
    per_row = hit.groupBy("doc_id", "row_key").agg(
        F.sort_array(F.collect_set(F.struct("a", "b"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    per_row = per_row.select(F.col("doc_id").alias("doc2"), F.col("row_key").alias("row2"), "hits", "item_ids")
    on = F.col("row_key").eqNullSafe(F.col("row2")) & F.col("doc_id").eqNullSafe(F.col("doc2"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    return (
        rows.select("doc_id", "row_key", "n_words")
        .join(per_row, on, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("hits", none).alias("hits"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            "row_key",
        )
        .withColumn("n_hit", _covered(F.col("hits")))
    )


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))

"""Quality rules whose cutoffs are certified on labelled holdouts: few good documents rejected in every stratum."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, by_batch, grams, rows_of, stored, utf8, word_hashes

SYMBOLS = "#*$%&|<>"
#: Rules, each a share or score put into bins 0 to 63; a document falls when one of them reaches its cutoff.
RULES = ("bad_words", "symbols", "repeated_lines", "repeated_words", "odd_word_length")
BINS = 64
#: Distances from the wished cutoffs, tried from the safest down until one can't be certified.
SLACK = (32, 16, 8, 4, 2, 1, 0)
EDGE = ".,;:!?\"'()[]{}" + SYMBOLS
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _marks(word: str) -> list[str]:
    """A word and its beginnings, which catch families of words."""
    return [word, *("^" + word[:n] for n in range(3, 9) if len(word) > n)]


def _plain(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass").strip(EDGE).lower()


def _plain_words(text: str | None) -> set[str]:
    return {w for w in map(_plain, set(utf8(text).split())) if w}


def fit_word_weights(texts: DataFrame, most_marks: int = 65_536) -> dict[str, float]:
    """Weights of words and word beginnings that are met in bad documents (``bad`` 1) and hardly in good ones.

    The weight is the log ratio of the two document rates less one standard error, so rare marks weigh
    little; marks are counted in tasks, and the model keeps at most ``most_marks`` of them.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            hit: list[Counter] = [Counter(), Counter()]
            for text, bad in zip(rows_of(b, "text"), rows_of(b, "bad")):
                hit[bad].update({m for w in _plain_words(text) for m in _marks(w)})
            marks = list(hit[0].keys() | hit[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(marks), pa.array([hit[0][m] for m in marks], pa.int64()), pa.array([hit[1][m] for m in marks], pa.int64())],
                names=["mark", "good", "bad"],
            )

        return one

    total = {r["bad"]: r["count"] for r in texts.groupBy("bad").count().collect()}
    if not total.get(0) or not total.get(1):
        return {}
    counts = by_batch(texts.select("text", "bad"), make, "mark string, good long, bad long")
    counts = counts.groupBy("mark").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where("bad >= 3")
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    weight = F.log(a / (total[1] + 1)) - F.log(b / (total[0] + 1)) - F.sqrt(1 / a + 1 / b)
    kept = counts.select("mark", weight.alias("w")).where("w > 1").orderBy(F.desc("w"), "mark").limit(most_marks)
    return {r["mark"]: r["w"] for r in kept.collect()}


class _Weights(dict):
    """Word to its weight, forgotten all at once when there are too many."""

    def __init__(self, marks: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.marks, self.limit = marks, limit

    def __missing__(self, raw: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        word = _plain(raw)
        made = self[raw] = max((self.marks.get(m, 0.0) for m in _marks(word)), default=0.0) if word else 0.0
        return made


def text_measures(text: str, hashes: np.ndarray) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words, and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text, whose words
    have the given hashes."""
    words = utf8(text).split()
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line.strip(SPACES):
                dup += line in seen
                seen.add(line)
    repeat = 0
    if len(words) > 3:
        three = grams(hashes, 3)
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        if same.any():
            twice = np.zeros(len(three), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, np.flatnonzero(twice), 1)
            np.add.at(step, np.flatnonzero(twice) + 3, -1)
            repeat = int((np.cumsum(step)[:-1] > 0).sum())
    return words, (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat)


def measured(docs: DataFrame, marks: dict[str, float]) -> DataFrame:
    """``doc_id, lang``, the base measures and the bin of each rule, one row per row of ``docs``."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        weights = _Weights(marks)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            base, bins = [], []
            texts = rows_of(b, "text")
            for text, hashes in zip(texts, word_hashes([utf8(t) for t in texts])):
                words, row = text_measures(text or "", hashes)
                n, chars, symbols, dup, repeat = row
                worst = sorted(filter(None, map(weights.__getitem__, set(words))))[-3:]
                mean = chars / n if n else 0.0
                scores = (
                    sum(worst) * 4,
                    symbols / max(chars, 1) * 128,
                    dup / max(text.count("\n") + 1 if text else 1, 1) * 63,
                    repeat / max(n, 1) * 63,
                    abs(math.log2(max(mean, 0.5) / 5)) * 16,
                )
                base.append(row)
                bins.append([min(BINS - 1, int(x)) for x in scores])
            columns = [pa.array(c, pa.int64()) for c in zip(*base)]
            names = [c.split()[0] for c in BASE.split(", ")]
            key = [b.column(0), b.column(1), b.column(2)]
            return pa.RecordBatch.from_arrays(
                [*key, *columns, pa.array(bins, pa.list_(pa.int32()))], names=["doc_id", "lang", "row_key", *names, "bins"]
            )

        return one

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    read = docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return by_batch(read, make, f"doc_id long, lang string, row_key long, {BASE}, bins array<int>")


def upper_bound(errors: int, n: int, delta: float) -> float:
    """The exact one-sided binomial upper bound of a rate, of confidence ``1 - delta``, by bisection."""
    if errors >= n:
        return 1.0

    def at_most(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(errors + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = errors / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid in (0.0, 1.0):
            break
        low, high = (mid, high) if at_most(mid) > delta else (low, mid)
    return high


def wished_cutoffs(bad: np.ndarray, good: np.ndarray, price: float) -> list[int]:
    """Per rule the cutoff with the most bad documents caught less ``price`` times the good ones lost, on the
    rows the fit may see; 64 (never) where nothing pays. ``bad[r, bin]`` and ``good[r, bin]`` are counts."""
    out = []
    for b, g in zip(bad, good):
        caught, lost = np.cumsum(b[::-1])[::-1], np.cumsum(g[::-1])[::-1]
        gain = caught - price * lost
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            out.append(BINS)
            continue
        # the middle of the range that gives the same: neither close to the good nor to the bad
        same = [k for k in range(1, BINS) if gain[k] == gain[best] and caught[k] == caught[best]]
        out.append(max(1, (same[0] + same[-1] + 1) // 2 if same else best))
    return out


def certified_cutoffs(
    scored: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, price: float = 20.0
) -> dict[str, list[int]]:
    """Cutoffs per stratum (language) such that, with confidence ``1 - delta`` for all strata together, at most
    a share ``alpha`` of the good documents of each stratum is rejected by the rules.

    Labelled rows are parted by the hash of their id: one half fits, the other certifies. Wished cutoffs come
    from the fitting half. On the certifying half they are approached from the safe side in fixed steps
    (``SLACK``); each step is tested by the exact binomial bound at ``delta`` over the number of strata, and
    the first that fails ends the sequence, so steps need no further correction. Every stratum is
    tested by its own rows alone, however few. Where not even the safest step can be certified, or no good
    row is in the certifying half, the stratum has no cutoffs and the rules reject nothing. Only counts
    reach the driver.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = stored(
        scored.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
        .join(known, "doc_id")
        .select(F.coalesce("lang", F.lit("")).alias("lang"), "bins", good.alias("good"), fits("doc_id").alias("fits")),
        "labelled-scores",
    )
    counts = np.zeros((2, len(RULES), BINS))
    seen = rows.where("fits").select("good", F.posexplode("bins").alias("rule", "bin"))
    for r in seen.groupBy("good", "rule", "bin").count().collect():
        counts[int(r["good"]), r["rule"], r["bin"]] = r["count"]
    wish = wished_cutoffs(counts[0], counts[1], price)

    def falls(step: int) -> Column:
        return reduce(lambda a, b: a | b, [F.col("bins")[k] >= min(BINS, w + step) for k, w in enumerate(wish)])

    tests = rows.where("good and not fits").groupBy("lang")
    tested = tests.agg(F.count("*").alias("n"), *[F.sum(falls(s).cast("long")).alias(f"lost_{s}") for s in SLACK]).collect()
    out: dict[str, list[int]] = {}
    for r in tested:
        passed = None
        for s in SLACK:
            if upper_bound(r[f"lost_{s}"], r["n"], delta / len(tested)) > alpha:
                break
            passed = s
        if passed is not None:
            out[r["lang"]] = [min(BINS, w + passed) for w in wish]
    return out


def fits(doc_id: str) -> Column:
    """Whether a labelled row may be seen by the fit; all others only certify."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit("fit")), F.lit(2)) == 0


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, **certify: float) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measures, ``base_failed``, ``kept`` and the rule that fell.

    ``fit_rows`` bounds the labelled documents the word weights are fitted on, taken by hash from the fitting
    half, so their ids are a list of proven size; all labels of the other half certify. Null text has no
    words and fails the base. Null ``lang`` is a stratum by itself. Repeated rows are
    judged alike. Without labels, only the base rules reject. Other columns are left out.
    """
    chosen = (
        labels.where(fits("doc_id") & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("bad"))
        .where("bad in (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    marks = fit_word_weights(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id"))
    scored = stored(measured(docs, marks), "quality-measures")
    cutoffs = certified_cutoffs(scored, labels, **certify)
    stratum = F.coalesce("lang", F.lit(""))
    fell = F.lit(None).cast("string")
    for name, cut in cutoffs.items():
        for k, c in reversed(list(enumerate(cut))):
            if c < BINS:
                fell = F.when((stratum == name) & (F.col("bins")[k] >= c), F.lit(RULES[k])).otherwise(fell)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = scored.withColumn("base_failed", failed).withColumn("fell_by", F.when(failed, F.lit("base")).otherwise(fell))
    names = [c.split()[0] for c in BASE.split(", ")]
    return out.select("doc_id", *names, "base_failed", F.col("fell_by").isNull().alias("kept"), "fell_by", "row_key")

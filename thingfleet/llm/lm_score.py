"""Document scores of a gated recurrent language model and of smoothed word counts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, rows_of, stored, text_word_hashes

#: The end of a text: a number of its own beside the hashes of words.
END = 0x6A09E667F3BCC908
#: The model's own numbers of the end and of all words outside its vocabulary.
END_ID, OUT_ID = 0, 1


def tokens_of(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its words, then the end."""
    return [np.append(h, np.uint64(END)) for h in text_word_hashes(texts)]


def with_part(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, held_out, text``; a null ``doc_id`` counts as the empty text."""
    doc = F.col("doc_id").cast("long")
    held = F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return docs.select(doc.alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), held.alias("held_out"), F.col("text").cast("string"))


# Counts ---------------------------------------------------------------------------------------


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: how often each token stands in the training documents."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(tokens_of(b.column(0).to_pylist())), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        return one

    return by_batch(docs.where(~F.col("held_out")).select("text"), make, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent tokens: a list of fixed size; all others are looked up by a join."""

    h: np.ndarray
    c: np.ndarray
    total: int
    distinct: int

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the tokens, 0 where not in the list, and whether they are in it."""
        if not len(self.h):
            return np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
        at = np.minimum(np.searchsorted(self.h, tokens), len(self.h) - 1)
        there = self.h[at] == tokens
        return np.where(there, self.c[at], 0), there


def head_of(counts: DataFrame, size: int) -> Head:
    n = counts.agg(F.sum("c"), F.count("*")).first()
    got = counts.orderBy(F.desc("c"), "h").limit(size).toArrow()
    h, c = got.column("h").to_numpy().astype(np.int64).view(np.uint64), got.column("c").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return Head(h[order], c[order], int(n[0] or 0), int(n[1]))


# The network ----------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Numbers of the model's words: 0 the end, 1 all others, then the most frequent ones; ``width`` words to a class."""

    h: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    width: int

    @staticmethod
    def of(head: Head, classes: int, width: int) -> Vocabulary:
        words = np.flatnonzero(head.h != np.uint64(END))
        top = words[np.argsort(-head.c[words], kind="stable")][: classes * width - 2]
        ids = np.arange(2, 2 + len(top))
        counts = np.zeros(classes * width)
        counts[ids] = head.c[top]
        counts[END_ID] = head.find(np.array([END], dtype=np.uint64))[0][0]
        counts[OUT_ID] = head.total - counts.sum()
        order = np.argsort(head.h[top])
        return Vocabulary(head.h[top][order], ids[order].astype(np.int16), counts, width)

    def number(self, tokens: np.ndarray) -> np.ndarray:
        out = np.full(len(tokens), OUT_ID, dtype=np.int16)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, tokens), len(self.h) - 1)
            out = np.where(self.h[at] == tokens, self.ids[at], out)
        out[tokens == np.uint64(END)] = END_ID
        return out


class Network:
    """A gated recurrent unit over word numbers with a softmax over classes and one inside each class."""

    NAMES = ("wx", "u", "wc", "bc", "ww", "bw")

    def __init__(self, counts: np.ndarray, width: int, hidden: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        v, classes = len(counts), len(counts) // width
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.hidden, self.width, self.classes = hidden, width, classes
        # output biases start at the frequencies, so the untrained model is the unigram one
        by_class = counts.reshape(classes, width) + 0.5
        self.p = {
            "wx": draw(v, 3 * hidden),
            "u": draw(hidden, 3 * hidden),
            "wc": np.zeros((hidden, classes), dtype=np.float32),
            "bc": np.log(by_class.sum(1) / by_class.sum()).astype(np.float32),
            "ww": np.zeros((classes, hidden, width), dtype=np.float32),
            "bw": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        }

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = flat[at : at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size
        return self

    def run(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states of a window ``x[step, lane]`` from the state ``h`` carried into it."""
        k, u = self.hidden, self.p["u"]
        wx = self.p["wx"][x]
        out, tape = np.empty((len(x), len(h), k), dtype=wx.dtype), []
        for t in range(len(x)):
            h = h * keep[t][:, None]
            a = h @ u
            g = wx[t, :, : 2 * k] + a[:, : 2 * k]  # the logistic function, as a tanh of the half
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r, an = g[:, :k], g[:, k:], a[:, 2 * k :]
            n = r * an
            n += wx[t, :, 2 * k :]
            np.tanh(n, out=n)
            tape.append((h, z, r, n, an))
            np.subtract(h, n, out=out[t])
            out[t] *= z
            out[t] += n
            h = out[t]
        return out, tape

    def _softmax(self, states: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of ``y`` and the gradient of their negative sum by the logits."""
        logits = states @ w
        logits += b
        np.clip(logits, -60, 60, out=logits)
        rows = np.arange(len(y))
        out = logits[rows, y]
        np.exp(logits, out=logits)
        s = logits.sum(1)
        out -= np.log(s)
        if not gradient:
            return out, None
        logits /= s[:, None]
        logits[rows, y] -= 1
        return out, logits

    def log_likelihood(self, states: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of targets ``y``; with ``grads`` also the gradient of their negative sum."""
        cls, word = np.divmod(y, self.width)
        out, d = self._softmax(states, self.p["wc"], self.p["bc"], cls, grads is not None)
        back = None
        if grads is not None:
            grads["wc"] += states.T @ d
            grads["bc"] += d.sum(0)
            back = d @ self.p["wc"].T
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            at = order[cuts[c] : cuts[c + 1]]
            if not len(at):
                continue
            st = states[at]
            got, d = self._softmax(st, self.p["ww"][c], self.p["bw"][c], word[at], grads is not None)
            out[at] += got
            if grads is not None:
                grads["ww"][c] += st.T @ d
                grads["bw"][c] += d.sum(0)
                back[at] += d @ self.p["ww"][c].T
        return out, back

    def back(self, x: np.ndarray, keep: np.ndarray, tape: list, d_states: np.ndarray, grads: dict) -> None:
        """Back-propagation through one window; nothing flows into the window before."""
        k, u = self.hidden, self.p["u"]
        dx = np.empty((len(x), x.shape[1], 3 * k), dtype=np.float32)
        dh = np.zeros((x.shape[1], k), dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, an = tape[t]
            dh = dh + d_states[t]
            dn = dh * (1 - z) * (1 - n * n)
            dx[t, :, :k] = dh * (h - n) * z * (1 - z)
            dx[t, :, k : 2 * k] = dn * an * r * (1 - r)
            dx[t, :, 2 * k :] = dn
            da = dx[t].copy()
            da[:, 2 * k :] *= r
            grads["u"] += h.T @ da
            dh = (dh * z + da @ u.T) * keep[t][:, None]
        flat, rows = x.ravel(), dx.reshape(-1, 3 * k)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grads["wx"][flat[order][first]] += np.add.reduceat(rows[order], first, axis=0)


class Adam:
    def __init__(self, network: Network, rate: float):
        self.net, self.rate, self.t = network, rate, 0
        self.m = {n: np.zeros_like(v) for n, v in network.p.items()}
        self.v = {n: np.zeros_like(v) for n, v in network.p.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        scale = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for n, g in grads.items():
            self.m[n] += 0.1 * (g - self.m[n])
            self.v[n] += 0.001 * (g * g - self.v[n])
            self.net.p[n] -= scale * self.m[n] / (np.sqrt(self.v[n]) + 1e-8)


@dataclass
class Lanes:
    """Texts laid end to end in lanes of alike length, so that many are read at once: each text lies whole in
    one lane, and the state starts anew at its beginning (``keep`` 0). Longer lanes stand first, so the
    lanes still open at any step are the first ones.

    Tokens lie flat, lane after lane (``y``, with their inputs ``x``, beginnings ``keep`` and texts), and only
    a window of each lane is laid out at a time, so memory follows the tokens and not the longest lane.
    """

    x: np.ndarray
    y: np.ndarray
    keep: np.ndarray
    text: np.ndarray
    loads: np.ndarray

    @staticmethod
    def of(texts: list[np.ndarray], lanes: int) -> Lanes:
        lanes = max(1, min(lanes, len(texts)))
        load, rows = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
            n, at = load[0]
            rows[at].append(k)
            heapq.heapreplace(load, (n + len(texts[k]), at))
        full = sorted(((n, at) for n, at in load), reverse=True)
        ks = [k for _, at in full for k in rows[at]]
        sizes = np.array([len(texts[k]) for k in ks])
        y = np.concatenate([texts[k] for k in ks]).astype(np.int16, copy=False)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        x, keep = np.roll(y, 1), np.ones(len(y), dtype=bool)
        x[starts], keep[starts] = END_ID, False
        return Lanes(x, y, keep, np.repeat(np.array(ks, dtype=np.int32), sizes), np.array([n for n, _ in full]))

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``x, y, keep, text`` of each window, ``[step, lane]`` over the lanes open in it; ``text`` is -1 where
        a lane has ended."""
        first = np.cumsum(self.loads) - self.loads
        for a in range(0, int(self.loads[0]), size):
            n = int((self.loads > a).sum())
            step = np.arange(a, min(a + size, int(self.loads[0])))[:, None]
            there = step < self.loads[:n]
            at = np.where(there, first[:n] + step, 0)
            x, y = (np.where(there, v[at], np.int16(END_ID)) for v in (self.x, self.y))
            yield x, y, np.where(there, self.keep[at], True).astype(np.float32), np.where(there, self.text[at], np.int32(-1))


def train(net: Network, texts: list[np.ndarray], adam: Adam, s: Settings) -> int:
    """One pass over the texts by truncated back-propagation; returns the number of tokens read. Texts longer
    than ``s.stretch`` tokens are read as several, so that no lane runs on alone."""
    parts = [t[a : a + s.stretch] for t in texts for a in range(0, len(t), s.stretch)]
    laid = Lanes.of(parts, s.lanes)
    h = np.zeros((len(laid.loads), net.hidden), dtype=np.float32)
    for x, y, keep, text in laid.windows(s.window):
        there = text.ravel() >= 0
        states, tape = net.run(x, keep, h[: x.shape[1]])
        h = states[-1]
        flat = states.reshape(-1, net.hidden)
        grads = {k: np.zeros_like(v) for k, v in net.p.items()}
        _, got = net.log_likelihood(flat[there], y.ravel()[there], grads)
        d = np.zeros_like(flat)
        d[there] = got
        net.back(x, keep, tape, d.reshape(states.shape), grads)
        adam.step({k: g / len(got) for k, g in grads.items()})
    return sum(map(len, texts))


def likelihoods(net: Network, texts: list[np.ndarray], s: Settings) -> np.ndarray:
    """Log10 probability of each whole text, its state carried over all windows."""
    laid = Lanes.of(texts, s.lanes)
    h = np.zeros((len(laid.loads), net.hidden), dtype=np.float32)
    out = np.zeros(len(texts))
    for x, y, keep, text in laid.windows(s.window):
        states, _ = net.run(x, keep, h[: x.shape[1]])
        h = states[-1]
        text = text.ravel()
        there = text >= 0
        got, _ = net.log_likelihood(states.reshape(-1, net.hidden)[there], y.ravel()[there])
        out += np.bincount(text[there], weights=got, minlength=len(texts))
    return out / math.log(10)


@dataclass
class Settings:
    """Sizes of the model; none depends on the size of the corpus."""

    head: int = 1 << 18
    classes: int = 48
    width: int = 48
    hidden: int = 16
    window: int = 48
    lanes: int = 512
    rate: float = 0.01
    stretch: int = 1024
    #: Tokens that a task lays out at a time.
    held: int = 1 << 22


def trained(docs: DataFrame, head: Head, s: Settings) -> tuple[Network, Vocabulary]:
    """The model after one pass over all training documents: each task trains its own copy on the documents it
    reads, and the copies are averaged, weighted by tokens, first in a few tasks and then on the driver."""
    vocabulary = Vocabulary.of(head, s.classes, s.width)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(vocabulary.counts, s.width, s.hidden)
        adam, n = Adam(net, s.rate), 0
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for t in tokens_of(b.column(0).to_pylist()):
                held.append(vocabulary.number(t))
                size += len(t)
            if size >= s.held:
                n += train(net, held, adam, s)
                held, size = [], 0
        if held:
            n += train(net, held, adam, s)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([net.vector().tobytes()], pa.binary())], names=["n", "w"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for b in batches:
            for n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(w, dtype=np.float32).astype(np.float64) * n
                total, weight = own if total is None else total + own, weight + n
        if weight:
            yield pa.RecordBatch.from_arrays(
                [pa.array([weight], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"]
            )

    copies = stored(docs.where(~F.col("held_out")).select("text").mapInArrow(learn, "n long, w binary"), "lm-copies")
    few = copies.repartition(8).mapInArrow(average, "n long, w binary").collect()
    net = Network(vocabulary.counts, s.width, s.hidden)
    if few:
        n = sum(r["n"] for r in few)
        net.load(sum(np.frombuffer(r["w"], dtype=np.float32).astype(np.float64) * (r["n"] / n) for r in few))
    return net, vocabulary


def score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` adds log10((c + 1) / (N + V + 1)) over all tokens of the text with its end. ``score`` is the
    model's log10 probability of the text: of the class, the word in it and, for words outside the
    model's vocabulary, of the word among those by smoothed counts. Counts are exact over all training
    documents: the most frequent tokens (a list of fixed size) are known to every task, all others of a
    text meet their counts in a join. Null text is empty: its only token is the end. Repeated rows are scored
    alike and all count; an empty training part gives counts of 0. Other columns are left out.
    """
    s = settings or Settings()
    keyed = with_part(docs)
    counts = stored(token_counts(keyed), "lm-counts")
    head = head_of(counts, s.head)
    net, vocabulary = trained(keyed, head, s)
    inside = head.find(np.append(vocabulary.h, np.uint64(END)))
    out_total, out_distinct = head.total - int(inside[0].sum()), head.distinct - int(inside[1].sum())
    weights = net.vector()

    def scored(keys: pa.RecordBatch, texts: list[np.ndarray], own: Network) -> pa.RecordBatch:
        flat = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        c, there = head.find(flat)
        numbers = vocabulary.number(flat)
        logs, outside = np.log10(c + 1.0), numbers == OUT_ID
        sums = [np.add.reduceat(v, first) for v in (there.astype(np.int64), outside.astype(np.int64), logs, np.where(outside, logs, 0.0))]
        model = likelihoods(own, np.split(numbers, first[1:]), s)
        tails = [np.unique(t[~k], return_counts=True) for t, k in zip(texts, np.split(there, first[1:]))]
        ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in tails])]).astype(np.int32)
        hashes, times = (np.concatenate(x) for x in zip(*tails))
        pairs = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times.astype(np.int32))], names=["h", "k"])
        return pa.RecordBatch.from_arrays(
            [
                *(keys.column(k) for k in range(3)),
                pa.array(sizes.astype(np.int64)),
                *(pa.array(x) for x in sums),
                pa.array(model),
                pa.ListArray.from_arrays(pa.array(ends), pairs),
            ],
            names=["doc_id", "row_key", "held_out", "n_tokens", "known", "n_out", "logs", "out_logs", "model", "tail"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(vocabulary.counts, s.width, s.hidden).load(weights)
        keys: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        size = 0
        for b in batches:
            if b.num_rows:
                keys.append(b.select(["doc_id", "row_key", "held_out"]))
                got = tokens_of(rows_of(b, "text"))
                texts += got
                size += sum(map(len, got))
                if size >= s.held:
                    yield scored(pa.concat_batches(keys), texts, own)
                    keys, texts, size = [], [], 0
        if keys:
            yield scored(pa.concat_batches(keys), texts, own)

    schema = (
        "doc_id long, row_key long, held_out boolean, n_tokens long, known long, n_out long, logs double, out_logs double, "
        "model double, tail array<struct<h: long, k: int>>"
    )
    rows = stored(keyed.mapInArrow(run, schema), "lm-scores")
    # equal rows have equal tails: one of them asks
    asked = rows.where(F.size("tail") > 0).select("doc_id", "row_key", "tail").dropDuplicates(["doc_id", "row_key"])
    asked = asked.select("doc_id", "row_key", F.explode("tail").alias("t")).select("doc_id", "row_key", "t.h", "t.k")
    found = asked.join(counts, "h").groupBy("doc_id", "row_key")
    found = found.agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("tail_logs"))
    found = found.select(F.col("doc_id").alias("doc2"), F.col("row_key").alias("row2"), "tail_known", "tail_logs")
    on = F.col("row_key").eqNullSafe(F.col("row2")) & F.col("doc_id").eqNullSafe(F.col("doc2"))
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    return rows.drop("tail").join(found, on, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * math.log10(head.total + head.distinct + 1)).alias("base_score"),
        (F.col("model") + F.col("out_logs") + tail_logs - F.col("n_out") * math.log10(out_total + out_distinct + 1)).alias("score"),
    )

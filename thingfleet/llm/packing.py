"""Hierarchical packing of token sequences over several context sizes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .token_ids import path, shared_ids

#: Context sizes; all are powers of two, so a full window of any tier needs no padding.
TIERS = (256, 512, 1024, 2048)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier long, step_group long, ids array<int>"
)

Piece = tuple[int, int, int]


class Waiting:
    """Pieces by length. The bits of one integer say which lengths wait, so the best fit is one look."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths, self.tokens = 0, 0

    def add(self, piece: Piece) -> None:
        n = piece[2]
        self.by_length.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.tokens += n

    def _pop(self, n: int) -> Piece:
        stack = self.by_length[n]
        piece = stack.pop()
        if not stack:
            self.lengths &= ~(1 << n)
        self.tokens -= n
        return piece

    def longest(self, most: int) -> Piece | None:
        fit = self.lengths & ((1 << (most + 1)) - 1)
        return self._pop(fit.bit_length() - 1) if fit else None

    def shortest(self) -> Piece | None:
        return self._pop((self.lengths & -self.lengths).bit_length() - 1) if self.lengths else None


    def window(self, size: int) -> list[Piece]:
        """Pieces of ``size`` tokens together; at least as many have to wait."""
        out = []
        while size:
            piece = self.longest(size)
            if piece is None:
                doc, at, n = self.shortest()
                self.add((doc, at + size, n - size))
                piece = (doc, at, size)
            out.append(piece)
            size -= piece[2]
        return out


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """``(tier, pieces)`` of every sequence; a piece is ``(index of the document, start, length)``.

    Whole windows of the longest tier are cut from long documents; what is left of a document goes to the
    smallest tier that holds it. From the longest tier down, each window is opened by the longest piece of
    its tier and its gap filled with the longest shorter pieces that fit; when none fits whole, the
    shortest one is cut. The last pieces, too few for a window, are cut into sequences of powers of two.
    """
    sizes, done, waiting = sorted(tiers), [], Waiting()
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= sizes[-1]:
            done.append((sizes[-1], [(doc, at, sizes[-1])]))
            at += sizes[-1]
        if n > at:
            waiting.add((doc, at, n - at))
    for size in reversed(sizes):
        while waiting.tokens >= size and waiting.lengths >> (size // 2 + 1):
            done.append((size, waiting.window(size)))
    while waiting.tokens:
        size = min(sizes[-1], 1 << (waiting.tokens.bit_length() - 1))
        done.append((size, waiting.window(size)))
    return done


def step_groups(sizes: list[int], tokens: int) -> list[int]:
    """Groups of at most ``tokens`` padded tokens, filled with the large sequences first, so that the
    steps of training carry alike loads."""
    out, group, room = [0] * len(sizes), -1, 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if sizes[k] > room:
            group, room = group + 1, max(tokens, sizes[k])
        out[k] = group
        room -= sizes[k]
    return out


def pack(
    docs: DataFrame,
    file: str | None = None,
    end: int = 1,
    vocabulary: str = "word_bpe_49k.json",
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = 1 << 16,
    flush_tokens: int = 1 << 22,
) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``, see ``SCHEMA``; columns besides the two are left out.

    Null and empty texts are one id, ``end``. Rows of equal ids or texts are packed each for itself. A task
    packs what it reads, ``flush_tokens`` at a time, so it needs no shuffle and bounded memory; a sequence
    never spans two tasks, and its id joins the task's number with a count. A re-run task reads the same
    rows and makes the same pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = shared_ids(file or path(vocabulary)), np.array([end], dtype="<u4").tobytes()
        first, groups = TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        keys: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, groups, held
            windows = pack_lengths([len(t) // 4 for t in texts], tiers)
            grouped = step_groups([size for size, _ in windows], group_tokens)
            for at in range(0, len(windows), 512):
                rows: list[tuple] = []
                parts: list[bytes] = []
                for k in range(at, min(at + 512, len(windows))):
                    tier, pieces = windows[k]
                    total, offset = sum(p[2] for p in pieces), 0
                    for doc, start, n in pieces:
                        raw = texts[doc][4 * start : 4 * (start + n)]
                        parts.append(raw)
                        rows.append(
                            (keys[doc], start, n, zlib.crc32(raw), len(texts[doc]) // 4, first + k, offset, total, tier, groups + grouped[k])
                        )
                        offset += n
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"), pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])
            first, groups, held = first + len(windows), groups + max(grouped, default=0) + 1, 0
            keys.clear()
            texts.clear()

        for b in batches:
            made = ids.encode([t or "" for t in rows_of(b, "text")])
            for key, x in zip(rows_of(b, "doc_id"), made):
                keys.append(key)
                texts.append(x + last)
                held += len(x) // 4 + 1
                if held >= flush_tokens:
                    yield from flush()
        if texts:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)

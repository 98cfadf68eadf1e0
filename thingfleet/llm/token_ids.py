"""Token ids of whole texts, encoded by the chunks between which the tokenizer never merges."""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers

#: White space that Python's patterns and the tokenizers' patterns may see differently: such texts go through whole.
ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")
#: White space besides the space and the line end.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Chunks that a line end before and behind leaves as they are.
PLAIN = re.compile(r" ?\S+")
#: A byte-level pre-tokenizer keeps one space with the word behind it.
BYTE_CHUNK = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
#: Letters, then ASCII signs; what follows decides nothing about what stands before.
WORD_AND_SIGNS = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-`{-~]*)")
#: Stands before a chunk that has no space of its own in front.
BARE = "\0"


#: Texts that look up their chunks together.
BATCH = 32


def _single_spaced(text: str) -> bool:
    """Whether single spaces and line ends stand between words, and nothing else that is white space."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not OTHER_SPACE.search(text)


class Ids:
    """``encode(texts)``: the ids of each text as little-endian unsigned 32-bit integers.

    Texts are cut where the tokenizer always cuts (white space); chunks met before are looked up, the new
    ones of a batch go to the tokenizers library in one call. The memory of chunks keeps those used lately:
    two generations of ``limit`` chunks. A text with white space outside ASCII is encoded as one piece.
    """

    def __init__(self, file: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.keeps_space = self.tokenizer.normalizer is None
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.keeps_space else []
        self.limit, self.old = limit, {}
        self.new: dict[str, bytes] = {"": b""}

    def _name(self, chunk: str) -> str:
        if not self.keeps_space:
            return chunk
        return chunk[1:] if chunk[0] == " " and chunk[1:].strip() else BARE + chunk

    def _chunk(self, name: str) -> str:
        if not self.keeps_space:
            return name
        return name[1:] if name[0] == BARE else " " + name

    def _cut(self, text: str) -> list[str] | None:
        """The names of the chunks of a text, or None when it has to be encoded as one piece."""
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        if BARE in text:
            return None
        if _single_spaced(text):
            return (BARE + text).replace("\n", f" {BARE}\n {BARE}").split(" ")
        return None if ODD.search(text) else [self._name(c) for c in BYTE_CHUNK.findall(text)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in made]

    def _each(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk: where the tokenizer keeps line ends as one id, of many chunks as lines of one text."""
        if len(self.line_end) != 1:
            return self._whole(chunks)
        out: list[bytes] = [b""] * len(chunks)
        plain = [k for k, c in enumerate(chunks) if PLAIN.fullmatch(c)]
        groups = [plain[at : at + 64] for at in range(0, len(plain), 64)]
        made = self.tokenizer.encode_batch_fast(["\n".join([chunks[k] for k in g]) for g in groups], add_special_tokens=False)
        left = sorted(set(range(len(chunks))).difference(plain))
        for g, x in zip(groups, made):
            ids = np.array(x.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end[0])
            if len(ends) != len(g) - 1:
                left += g
                continue
            raw, at = ids.tobytes(), 0
            for k, end in zip(g, [*(ends * 4).tolist(), len(raw)]):
                out[k] = raw[at:end]
                at = end + 4
        for k, b in zip(left, self._whole([chunks[k] for k in left])):
            out[k] = b
        return out

    def _parts(self, chunk: str) -> tuple[str, str] | None:
        """A word and the ASCII signs behind it, between which the tokenizer always cuts; None for other chunks.

        Where the tokenizer normalises and lower-cases, only letters are taken that stay one letter.
        """
        m = WORD_AND_SIGNS.fullmatch(chunk)
        if not m or not m[1].lstrip(" ").isalpha():
            return None
        word = m[1]
        if not self.keeps_space:
            if max(word) >= "\u0130":  # normalisation may make a letter a letter and a mark
                return None
            word = word.lower()
        return None if word == chunk else (word, m[2])

    def _learn(self, chunks: set[str]) -> None:
        unknown, made_of = [], {}
        for c in chunks:
            if (known := self.old.get(c)) is not None:
                self.new[c] = known
            elif parts := self._parts(self._chunk(c)):
                made_of[c] = tuple(self._name(p) if p else p for p in parts)
            else:
                unknown.append(c)
        words = {p for parts in made_of.values() for p in parts if p}.difference(self.new, unknown)
        for w in words:
            if (known := self.old.get(w)) is not None:
                self.new[w] = known
            else:
                unknown.append(w)
        for at in range(0, len(unknown), 4096):
            part = unknown[at : at + 4096]
            self.new.update(zip(part, self._each([self._chunk(c) for c in part])))
        for c, (word, signs) in made_of.items():
            self.new[c] = self.new[word] + (self.new[signs] if signs else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            cut = [self._cut(t) for t in part]
            if len(self.new) > self.limit:
                self.old, self.new = self.new, {"": b""}
            met = set().union(*(c for c in cut if c is not None))
            self._learn(met.difference(self.new))
            # a small dictionary for the many look-ups, the large one only once a chunk
            get = dict(zip(met, map(self.new.__getitem__, met))).__getitem__
            out += [self._whole([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(part, cut)]
        return out


_KEPT: dict[str, Ids] = {}


def shared_ids(file: str) -> Ids:
    """One per Python worker: the chunks that earlier tasks of the worker have met stay known."""
    if file not in _KEPT:
        _KEPT[file] = Ids(file)
    return _KEPT[file]


def path(name: str) -> str:
    """Where the public vocabulary file of that name lies on this machine."""
    return public_tokenizers.path(name)

"""Plain versions of what the operators compute, for small inputs."""

import collections
import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def hits(text, items, window=13):
    """Words, words hit and sorted items of one text."""
    words = PLAIN_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, said in items:
        own = PLAIN_WORD.findall((said or "").translate(LOWER))
        n = min(window, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def cut_repeats(texts, length=400):
    """Bytes, bytes removed, runs and kept bytes of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        out.append((len(b), int(mask.sum()), len(runs) // 2, sha(np.frombuffer(b, np.uint8)[~mask].tobytes())))
    return out


def shingles(text, k=4):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def line_dedup(docs, least=20, min_docs=3):
    """Lines before, lines dropped and the new text of each document."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = collections.defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                where[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(where[key(x)]) < min_docs or max(where[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def measures(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    three = list(zip(words, words[1:], words[2:]))
    count = collections.Counter(three)
    repeat = {p for i, g in enumerate(three) if count[g] > 1 for p in (i, i + 1, i + 2)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(repeat), failed


def repaired_turns(rows):
    """Counts, cost, letters and repaired lines of one conversation of ``(turn, role, text)``, by the cheapest and
    then least word over all edits, row by row from the end."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    space = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(space)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heads = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    wants = {"": "su", "s": "u", "u": "a", "a": "u"}
    # best[state]: cost, letters, lines of all that follows
    best = {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", ("assistant:",)), "s": (6, "II", ("user:", "assistant:"))}
    for (_, role, text), fault, head in zip(rows[::-1], faults[::-1], heads[::-1]):
        more = 3 if fault == "t" else 0
        after, own = best, {}
        for q in wants:
            options = [(after[q][0] + 4, "D" + after[q][1], after[q][2])]
            if fault in ("", "t"):
                if head and head in wants[q]:
                    c, a, t = after[head]
                    options.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in wants[q]:
                        c, a, t = after[to]
                        options.append((c + more + 3, "R" + a, (f"{name}:{text}", *t)))
            own[q] = min(options)
        # turns inserted before the row: two lead back to the same state and never pay, but one or two may open it
        best = dict(own)
        for _ in range(2):
            for q in wants:
                to, name = ("a", "assistant:") if q == "u" else ("u", "user:")
                c, a, t = best[to]
                best[q] = min(best[q], (c + 3, "I" + a, (name, *t)))
    cost, letters, lines = best[""]
    counts = tuple(faults.count(f) for f in "bdt")
    return (gaps, *counts, illegal, cost, letters, sha("\n".join(lines)))


def damage(rows):
    """Rows ``(conv_id, turn, role, text)`` by conversation, damaged by their checksum."""
    import zlib

    one = lambda x: " " if x is None else x
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if case == 1:
            text = ""
        if case == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if case == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out

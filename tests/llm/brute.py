"""Plain loops that say what the operators must give."""

from __future__ import annotations

import re
from collections import Counter

BASE_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return BASE_WORDS.findall((text or "").encode().lower())


def removed_bytes(rows, window=50):
    """Kept bytes and removed runs of each (id, text)."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - window + 1):
                s = raw[k : k + window]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - window + 1):
                if first[raw[k : k + window]] < i:
                    gone[k : k + window] = b"\1" * window
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, t, bytes(b for b, g in zip(raw, gone) if not g), runs))
    return out


def shingles(text, n=5):
    own = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def groups(rows, percent=80):
    """Smallest linked id of each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if (sets[a] and 100 * common >= percent * len(sets[a] | sets[b])) or (same_id and sets[a] and sets[b]):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(s), least.get(find(x))) for x, ((i, _), s) in enumerate(zip(rows, sets))]


def windows_hit(text, items, n=10):
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        other = words(passage)
        size = min(n, len(other))
        inside = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in inside:
                hit.update(range(i, i + size))
                found.add(item)
    return len(own), len(hit), found


def phrase_places(text, phrases):
    own = words(text)
    return [
        (i, label) for i in range(len(own)) for phrase, label in phrases.items()
        if own[i : i + len(phrase.split())] == phrase.encode().split()
    ]


def quality_counts(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0d]+", text)
    triples = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    counts = Counter(triples)
    repeated = {i + k for i, t in enumerate(triples) if counts[t] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]

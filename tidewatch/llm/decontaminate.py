"""Benchmark passages in documents, found by a broadcast hash set of their windows.

Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII.
Each benchmark item gives its windows of ``n`` words; an item with fewer words,
but not none, is one window. Windows are hashed; a task slides over the whole text
of a document, looks every window up in the set, and compares the words of each hit
with the benchmark's, so equal hashes of different words count for nothing.

The set is broadcast in blocks of ``BLOCK_WORDS`` benchmark words: a benchmark of any
size is scanned block by block, the documents carrying what earlier blocks hit, so
that no broadcast is larger than a block. Documents are not shuffled.

Null and empty texts have no words and no hits; so do documents where the benchmark
is empty. Repeated documents are judged each for itself; items with equal texts are
all named.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import col, unused, with_columns

N = 10
BLOCK_WORDS = 2_000_000
#: Bytes that are no part of a word become spaces, A-Z become a-z.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word ids."""
    total = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        total = (total ^ ids[i : len(ids) - n + 1 + i].astype(np.uint64)) * STEP
        total ^= total >> np.uint64(31)
    return total


class WindowSet:
    """Windows of a block of benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            size = min(n, len(own))
            if size:
                found = self.windows.setdefault(size, {})
                for i in range(len(own) - size + 1):
                    found.setdefault(tuple(own[i : i + size]), set()).add(item)
        self.hashes = {
            size: np.unique(_hashes(np.array([x for w in found for x in w], np.int64), size)[::size])
            for size, found in self.windows.items()
        }

    def hits(self, text_words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window, and the items of the windows found."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in text_words], np.int64)
        hit, items = np.zeros(len(ids) + 1, np.int64), set()
        missing = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, hashes in self.hashes.items():
            if size > len(ids):
                continue
            whole = np.flatnonzero(missing[size:] == missing[:-size])
            if not len(whole):
                continue
            own = _hashes(ids, size)[whole]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for i in whole[hashes[at] == own].tolist():
                found = self.windows[size].get(tuple(ids[i : i + size].tolist()))
                if found:  # verified word by word
                    hit[i] += 1
                    hit[i + size] -= 1
                    items |= found
        return np.cumsum(hit[:-1]) > 0, items


def blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``size`` words; the driver holds one block at a time."""
    own, total = [], 0
    for i, t in benchmark.select(col(item).cast("string"), col(text)).toLocalIterator():
        if t is None:
            continue
        own.append(("null" if i is None else i, t))
        total += len(words(t))
        if total >= size:
            yield own
            own, total = [], 0
    if own:
        yield own


def scan(
    docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", item: str = "item_id",
    benchmark_text: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The kept columns, ``n_words``, ``hit_words`` (places of hit words) and ``items`` (sorted ids as text)."""
    fields = [
        ("n_words", T.LongType()), ("hit_words", T.ArrayType(T.IntegerType())), ("items", T.ArrayType(T.StringType())),
    ]
    context = docs.sparkSession.sparkContext
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {f for f, _ in fields}]
    out, earlier = docs, 0
    source = blocks(benchmark, item, benchmark_text, block_words)
    # an empty benchmark is one empty block
    for block in chain([next(source, [])], source):
        shared = context.broadcast(WindowSet(block, n))

        def make(shared=shared):
            windows = shared.value

            def one(t):
                own = words(t)
                hit, items = windows.hits(own)
                return len(own), np.flatnonzero(hit).astype(np.int32), sorted(items)

            return lambda texts: list(zip(*map(one, texts)))

        carried = [unused(out.columns, f"{f}_{earlier}") for f, _ in fields] if earlier else []
        if earlier:
            out = out.withColumnsRenamed({f: c for (f, _), c in zip(fields, carried)})
        # the text stays as long as another block may follow
        out = with_columns(out, make, fields, text, [*kept, *([text] if text not in kept else []), *carried])
        if earlier:
            out = out.withColumns({
                f: F.array_sort(F.array_union(f, col(c))) for (f, _), c in list(zip(fields, carried))[1:]
            }).drop(*carried)
        earlier += 1
    return out.select(*[col(c) for c in kept], *[f for f, _ in fields])


def without_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", spans: bool = False) -> DataFrame:
    """Documents without benchmark passages, all columns as they are.

    With ``spans`` a document stays and its hit words are cut out; otherwise a
    document with any hit goes.
    """
    found = scan(docs, benchmark, n, text)
    if not spans:
        return found.where(F.size("hit_words") == 0).select(*[col(c) for c in docs.columns])

    @F.pandas_udf(T.StringType())
    def cut(texts, hits):
        import pandas as pd

        return pd.Series([cut_words(t, h) for t, h in zip(texts, hits)], dtype=object)

    return found.withColumn(
        text, F.when(F.size("hit_words") == 0, col(text)).otherwise(cut(col(text), "hit_words"))
    ).select(*[col(c) for c in docs.columns])


def cut_words(text: str | None, hit: list[int]) -> str | None:
    """The text without the given words; what stood between two of them goes too."""
    import re

    if text is None or not len(hit):
        return text
    raw, gone = text.encode(), set(int(i) for i in hit)
    out, end, before = [], 0, False
    for i, m in enumerate(re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))):
        if i in gone:
            if not before:
                out.append(raw[end : m.start()])
            end, before = m.end(), True
        else:
            out.append(raw[m.start() if before else end : m.end()] if not before else b" " + raw[m.start() : m.end()])
            end, before = m.end(), False
    out.append(raw[end:])
    return b"".join(out).decode(errors="ignore")

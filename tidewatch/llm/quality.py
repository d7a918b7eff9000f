"""Rule-based counts and a likelihood ratio for the quality of documents.

Two multinomials over hashed word n-grams (one and two words) are counted: one of
a trusted target, one of the whole raw corpus. A document's score is the mean over its
n-grams of the log of their ratio, so that long and short documents compare. Every
document is decided by the same fixed threshold; nothing is drawn at random.

The buckets are a fixed number, so the model has a fixed size whatever the corpus.
Counts of the raw corpus cover every document. The target is a sample of trusted
ids of at most ``TARGET_DOCS``, chosen by the hash of the id.

Null and empty texts have no words: all counts 0, score 0. Repeated rows count as
often as they occur. With an empty target or corpus every score is 0 and only the
rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import col, slices, with_columns

BUCKETS = 1 << 16
TARGET_DOCS = 20_000
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "
REMEMBERED = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def n_repeat_words(words: list[bytes]) -> int:
    """Words inside a three-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    own = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    k = len(ids)
    # pairs are numbered first, as three word numbers may not fit 64 bits
    _, pairs = np.unique(own[:-1] * k + own[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * k + own[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= again
    return int(hit.sum())


def n_dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return again


class Grams:
    """Buckets of a text's one- and two-word n-grams."""

    def __init__(self, buckets: int):
        self.buckets, self.known = np.uint64(buckets), {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        pairs = (h[:-1] * ODD) ^ h[1:]
        pairs = (pairs ^ (pairs >> np.uint64(29))) * ODD
        return (np.concatenate([h, pairs ^ (pairs >> np.uint64(32))]) % self.buckets).astype(np.int64)


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def count_grams(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    target_docs: int = TARGET_DOCS,
) -> np.ndarray:
    """Counts [raw, target] by bucket. ``target_ids`` has the trusted ids in its first column."""
    ids = col(target_ids.columns[0])
    chosen = (
        target_ids.select(ids.cast("long").alias("id")).where("id is not null").distinct()
        .orderBy(F.xxhash64("id"), "id").limit(target_docs)
    )
    spark = docs.sparkSession
    trusted = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in chosen.collect()), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, totals, some = Grams(buckets), np.zeros((2, buckets), np.int64), False
        for batch in batches:
            for part in slices(batch, "text"):
                some = True
                mine = np.isin(part.column("id").fill_null(-(2**63)).to_numpy(), trusted.value)
                texts = part.column("text").to_pylist()
                # pairs stay inside documents, so buckets are taken document by document
                for which, docs_ in ((0, texts), (1, [t for t, m in zip(texts, mine) if m])):
                    found = [grams(w) for w in map(_words, docs_) if w]
                    if found:
                        totals[which] += np.bincount(np.concatenate(found), minlength=buckets)
        if some:
            blocks = np.arange(buckets) // 4096
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.unique(blocks), 2), pa.int32()), pa.array([0, 1] * len(np.unique(blocks)), pa.int32()),
                 pa.array([totals[w, blocks == b].astype("<i8").tobytes() for b in np.unique(blocks) for w in (0, 1)], pa.binary())],
                names=["block", "which", "counts"],
            )

    def add(key, group):
        total = sum(np.frombuffer(x, "<i8") for x in group.column("counts").to_pylist())
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int32()), "which": pa.array([key[1].as_py()], pa.int32()),
            "counts": pa.array([total.tobytes()], pa.binary()),
        })

    schema = "block int, which int, counts binary"
    read = docs.select(col(id_col).cast("long").alias("id"), col(text).alias("text"))
    sums = read.mapInArrow(count, schema).groupBy("block", "which").applyInArrow(add, schema)
    out = np.zeros((2, buckets), np.int64)
    for block, which, raw in sums.collect():  # the buckets, whose number is fixed
        part = np.frombuffer(raw, "<i8")
        out[which, block * 4096 : block * 4096 + len(part)] = part
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket; all 0 without a target.

    The target's counts are smoothed towards the raw corpus, so a bucket that neither has seen says nothing.
    """
    buckets = counts.shape[1]
    if not counts[1].sum():
        return np.zeros(buckets)
    raw = (counts[0] + 1.0) / (counts[0].sum() + buckets)
    return np.log((counts[1] + buckets * raw) / (counts[1].sum() + buckets) / raw)


def score(docs: DataFrame, ratios: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, the counts of words, characters, symbols, repeated lines and words, and ``score``.

    The score is the mean log ratio of the text's n-grams, 0 without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        grams, ratio = Grams(len(shared.value)), shared.value

        def one(t):
            words = _words(t)
            if not words:
                return 0, 0, (sum(map(t.count, SYMBOLS)) if t else 0), 0, 0, 0.0
            chars = len(t) - sum(map(t.count, SPACE))
            found = float(ratio[grams(words)].mean())
            return len(words), chars, sum(map(t.count, SYMBOLS)), n_dup_lines(t), n_repeat_words(words), found

        return lambda texts: list(zip(*map(one, texts)))

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return with_columns(docs, make, [*((n, T.LongType()) for n in names), ("score", T.DoubleType())], text, keep)

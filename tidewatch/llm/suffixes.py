"""Removal of repeated byte strings, by suffix arrays built in two stages.

A byte of a document is removed where a string of ``WINDOW`` bytes covers it that also
starts in a document with a smaller id. Strings are judged on the input.

*Dealing.* Every window has a minimizer: of its substrings of ``GRAM`` bytes, the one
of least hash. Neighbouring windows mostly share it, so a text falls into fragments,
each a run of windows with one minimizer. Equal windows have equal minimizers, so
fragments are dealt to buckets by its hash. First only hashes travel, to see which
minimizers occur in two documents at all; only fragments with those travel then, equal
ones of a batch of documents once.

*Sorting.* In a bucket the distinct fragments form one text. Its suffixes are sorted in
two stages: those smaller than their successors directly, by their first bytes; all others are induced by
one scan through the buckets of first bytes, in which every suffix places the one
before it, if that is larger, next in its bucket. Then common prefixes of adjacent suffixes are computed; where they
reach the window, suffixes are equal windows, whose smallest document id is
known. Occurrences in larger documents become intervals, which travel back to the batches.

A batch holds about ``BATCH_BYTES`` of text, a bucket the fragments of a quarter of that; both
are as many as the input needs, and a fragment that very many documents share arrives
once a batch.

Null and empty texts and texts shorter than the window lose nothing. Rows with the same
id do not count as repeating each other. Rows without an id neither lose nor make
others lose bytes. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import col, text_bytes

WINDOW, GRAM = 50, 20
BATCH_BYTES = 4_000_000
BUCKETS_PER_BATCH = 4
STEP = 0xD6E8FEB86659FD93
NO_ID = np.iinfo(np.int64).max
#: Bytes hashed at a time, so that they stay in the cache.
CHUNK = 1 << 17

# --- minimizers --------------------------------------------------------------------


def _rolled(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every substring of so many bytes, by doubling lengths."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    parts, size, power = {}, 1, STEP
    while True:
        parts[size] = h, power
        if size * 2 > gram:
            break
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % 2**64, size * 2
    out, at = parts[size][0], size
    for part in sorted(parts, reverse=True):
        while at + part <= gram:
            other, power = parts[part]
            n = len(other) - at
            out = out[:n] * np.uint64(power) + other[at : at + n]
            at += part
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of so many values."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - width + size], x[width - size :]) if size < width else x


def fragments(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer hash of each fragment of a text."""
    n = len(data) - window + 1
    places, hashes = [], []
    low = np.uint64(0xFFFFFFFF)
    for begin in range(0, max(n, 0), CHUNK):
        h = _rolled(data[begin : begin + CHUNK + window - 1], gram)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = (_least(key, window - gram + 1)[: n - begin][:CHUNK] & low).astype(np.int64)
        hashes.append(h[at])
        places.append(at + begin)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    # least hashes are small ones: mixed again, they fill the range evenly
    own = hashes[starts] * np.uint64(STEP)
    own = (own ^ (own >> np.uint64(32))) * np.uint64(STEP)
    return starts, np.diff(np.append(starts, n)), own ^ (own >> np.uint64(29))


# --- suffix array ------------------------------------------------------------------


def _words_at(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Eight bytes from each place plus 8 k, as a number that orders as they do."""
    rows = np.lib.stride_tricks.sliding_window_view(text, 8)[at + 8 * k]
    return np.ascontiguousarray(rows).view(">u8")[:, 0].astype(np.uint64)


def _sort_directly(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The places in order of the strings of at least ``window`` bytes that start there."""
    if len(at) < 2:
        return at
    first = _words_at(text, at, 0)
    order = np.argsort(first, kind="stable")
    at, key = at[order], first[order]
    new = np.append(True, key[1:] != key[:-1])
    for k in range(1, -(-window // 8)):
        group = np.cumsum(new)
        tied = ~new | np.append(~new[1:], False)
        some = np.flatnonzero(tied)
        if not len(some):
            break
        key = _words_at(text, at[some], k)
        order = np.lexsort((key, group[some]))
        at[some], key, own = at[some][order], key[order], group[some]
        new[some[1:]] |= (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    return at


def suffix_array(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Wanted places of the text in order of the suffixes there, by their first ``window`` bytes.

    ``ends`` are the last places of the text's parts; a suffix ends with its part. The
    text has ``window`` + 8 bytes of padding behind it, and parts have some between them.
    """
    n = len(text) - window - 8
    here, after = text[:n].astype(np.int16), text[1 : n + 1].astype(np.int16)
    last = np.zeros(n, bool)
    last[ends] = True
    after[last[:n]] = -1
    # smaller or larger than the successor; equal bytes take the answer of the next that differ
    differs = here != after
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n, dtype=np.int32), n - 1)[::-1])[::-1]
    smaller = (here < after)[nearest]
    del differs, nearest, here, after

    # a wanted larger suffix is induced from its successor, and so on to a smaller one or the end
    needed = np.zeros(n, bool)
    needed[wanted] = True
    chain = wanted[~smaller[wanted] & ~last[wanted]] + 1
    while len(chain):
        chain = chain[~needed[chain]]
        needed[chain] = True
        chain = chain[~smaller[chain] & ~last[chain]] + 1
    # one-byte suffixes at the ends are larger than nothing: they come first in their bucket
    shortest = np.flatnonzero(needed & last)
    direct = _sort_directly(text, np.flatnonzero(needed & smaller), window)

    def by_byte(places: np.ndarray) -> list[np.ndarray]:
        return np.split(places, np.searchsorted(text[places], np.arange(1, 256)))

    second = by_byte(direct)  # in order already, so buckets are stretches
    induced: list[list[np.ndarray]] = [[x] for x in by_byte(shortest[np.argsort(text[shortest], kind="stable")])]

    def predecessors(places: np.ndarray) -> np.ndarray:
        before = places[places > 0] - 1
        return before[needed[before] & ~smaller[before] & ~last[before]]

    out = []
    for byte in range(256):
        # suffixes placed in this bucket place their equal-byte predecessors behind themselves
        wave = np.concatenate(induced[byte])
        bucket = [wave]
        while len(wave):
            before = predecessors(wave)
            wave = before[text[before] == byte]
            bucket.append(wave)
        bucket = np.concatenate([*bucket, second[byte]])
        out.append(bucket)
        before = predecessors(bucket)
        before = before[text[before] > byte]
        before = before[np.argsort(text[before], kind="stable")]
        for b, places in enumerate(by_byte(before)):
            if len(places):
                induced[b].append(places)
    array = np.concatenate(out)
    want = np.zeros(n, bool)
    want[wanted] = True
    return array[want[array]]


def common_prefixes(text: np.ndarray, array: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Common bytes, ``window`` at most, of each suffix with the one before it in the array; 0 for the first."""
    out = np.zeros(len(array), np.int64)
    open_ = np.arange(1, len(array))
    for k in range(-(-window // 8)):
        a, b = _words_at(text, array[open_ - 1], k), _words_at(text, array[open_], k)
        differ = a ^ b
        same = differ == 0
        # bytes before the first that differs: eight less the bytes the difference needs
        bits = np.frexp(differ[~same].astype(np.float64))[1]
        out[open_[~same]] = np.minimum(8 * k + (64 - np.minimum(bits, 64)) // 8, window)
        open_ = open_[same]
    out[open_] = window
    return out


def earliest(parts: list[bytes], owners: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the parts, the smallest owner of a part with an equal one; and the parts' first windows.

    Windows are numbered through all parts.
    """
    gap = bytes(8)
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(gap.join(parts) + bytes(window + 16), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + len(gap))])[:-1]
    counts = sizes - window + 1
    firsts = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(firsts[-1])
    part = np.repeat(np.arange(len(parts)), counts)
    places = begins[part] + number - firsts[:-1][part]
    array = suffix_array(text, begins + sizes - 1, places, window)
    which = np.searchsorted(places, array)
    new = np.flatnonzero(common_prefixes(text, array, window) < window)
    least = np.minimum.reduceat(owners[part[which]], new) if len(new) else owners[:0]
    out = np.empty(len(places), np.int64)
    out[which] = np.repeat(least, np.diff(np.append(new, len(array))))
    return out, firsts


# --- jobs --------------------------------------------------------------------------


def _batch(group: pa.Table) -> list[tuple[int, bytes]]:
    """Ids and texts of a batch in a fixed order, those with an id and a window only."""
    rows = zip(group.column("id").to_pylist(), group.column("text").to_pylist())
    return sorted((i, t.encode()) for i, t in rows if i is not None and t and len(t) * 4 >= WINDOW)


def _pack(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


HASHES = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("hashes", pa.binary()), ("twice", pa.binary())])
SHARED = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("shared", pa.binary())])
PARTS = pa.schema([
    ("bucket", pa.int32()), ("batch", pa.int32()), ("bytes", pa.binary()), ("sizes", pa.binary()), ("owners", pa.binary()),
    ("place_part", pa.binary()), ("place_id", pa.binary()), ("place_at", pa.binary()),
])
GONE = pa.schema([("batch", pa.int32()), ("ids", pa.binary()), ("begins", pa.binary()), ("ends", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _batch_fragments(texts: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """Text number, first window, windows and hash of all fragments of a batch."""
    found = [fragments(np.frombuffer(t, np.uint8)) for _, t in texts]
    text = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    return text, *(np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64 if i == 2 else np.int64)]) for i in range(3))


def _hash_index(texts: list[tuple[int, bytes]], text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and whether two ids of the batch have each."""
    ids = np.array([i for i, _ in texts], np.int64)[text] if len(text) else np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    sorted_, ids = hashes[order], ids[order]
    new = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, np.int64)
    if not len(new):
        return sorted_, np.zeros(0, bool)
    return sorted_[new], np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's stretch of sorted hashes begins; a bucket is a range of hashes."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, np.uint64)), [len(hashes)]])


def removed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``id``, ``text``, ``kept`` (bytes that stay) and ``spans`` (begin and end of each removed run, in bytes) of every row."""
    total = text_bytes(docs, text)
    batches = max(1, -(-total // batch_bytes))
    buckets = batches * BUCKETS_PER_BATCH
    read = docs.select(
        col(doc_id).cast("long").alias("id"), col(text).alias("text"),
    ).withColumn("batch", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(batches)).cast("int"))
    dealt = read.repartition(min(batches, 100_000), "batch")

    def hashes_of(key, group):
        texts = _batch(group)
        number, _, _, hashes = _batch_fragments(texts)
        distinct, twice = _hash_index(texts, number, hashes)
        cuts = _cuts(distinct, buckets)
        return _pack([
            (b, key[0].as_py(), distinct[x:y].tobytes(), np.packbits(twice[x:y]).tobytes())
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x
        ], HASHES)

    def shared_of(key, group):
        own = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(h)] for x, h in zip(group.column("twice").to_pylist(), own)]
        every, inverse, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared |= np.bincount(inverse, np.concatenate(flags), len(every)) > 0
        at, rows = 0, []
        for h, batch in zip(own, group.column("batch").to_pylist()):
            rows.append((batch, key[0].as_py(), np.packbits(shared[inverse[at : at + len(h)]]).tobytes()))
            at += len(h)
        return _pack(rows, SHARED)

    def parts_of(key, group, answers):
        texts = _batch(group)
        number, first, windows, hashes = _batch_fragments(texts)
        distinct, _ = _hash_index(texts, number, hashes)
        cuts, shared = _cuts(distinct, buckets), np.zeros(len(distinct), bool)
        for b, raw in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist()):
            x, y = cuts[b], cuts[b + 1]
            shared[x:y] = np.unpackbits(np.frombuffer(raw, np.uint8))[: y - x]
        at = np.searchsorted(distinct, hashes)
        some = np.flatnonzero(shared[at]) if len(at) else at
        bucket = np.searchsorted(cuts, at[some], side="right") - 1
        order = np.argsort(bucket, kind="stable")
        some, bucket = some[order], bucket[order]
        rows, ids = [], np.array([i for i, _ in texts], np.int64)
        for b, begin, end in zip(*_stretches(bucket)):
            known: dict[bytes, int] = {}
            own = some[begin:end]
            which = [
                known.setdefault(texts[t][1][f : f + w + WINDOW - 1], len(known))
                for t, f, w in zip(number[own].tolist(), first[own].tolist(), windows[own].tolist())
            ]
            owners = np.full(len(known), NO_ID)
            np.minimum.at(owners, which, ids[number[own]])
            rows.append((
                b, key[0].as_py(), b"".join(known), np.array([len(k) for k in known], np.int32).tobytes(), owners.tobytes(),
                np.array(which, np.int32).tobytes(), ids[number[own]].tobytes(), first[own].astype(np.int32).tobytes(),
            ))
        return _pack(rows, PARTS)

    def gone_of(key, group):
        parts: dict[bytes, int] = {}
        owners: list[int] = []
        places = []
        names = ("batch", "bytes", "sizes", "owners", "place_part", "place_id", "place_at")
        for batch, raw, sizes, own, which, ids, at in zip(*(group.column(n).to_pylist() for n in names)):
            begin, mine = 0, []
            for n, owner in zip(np.frombuffer(sizes, np.int32).tolist(), np.frombuffer(own, np.int64).tolist()):
                i = parts.setdefault(raw[begin : begin + n], len(parts))
                if i == len(owners):
                    owners.append(owner)
                else:
                    owners[i] = min(owners[i], owner)
                mine.append(i)
                begin += n
            places.append((batch, np.array(mine)[np.frombuffer(which, np.int32)], np.frombuffer(ids, np.int64), np.frombuffer(at, np.int32)))
        least, firsts = earliest(list(parts), np.array(owners, np.int64))
        # stretches of windows with one smallest owner
        cut = np.append(True, least[1:] != least[:-1])
        cut[firsts[:-1]] = True
        runs = np.flatnonzero(cut)
        run_end = np.append(runs[1:], len(least))
        run_first = np.searchsorted(runs, firsts)
        rows = []
        for batch, part, ids, at in places:
            n = run_first[part + 1] - run_first[part]
            place = np.repeat(np.arange(len(part)), n)
            run = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + run_first[part][place]
            hit = least[runs[run]] < ids[place]
            place, run = place[hit], run[hit]
            if len(place):
                shift = at[place] - firsts[part[place]]
                rows.append((
                    batch, ids[place].tobytes(), (runs[run] + shift).astype(np.int64).tobytes(),
                    (run_end[run] + shift + WINDOW - 1).astype(np.int64).tobytes(),
                ))
        return _pack(rows, GONE)

    result = pa.schema([("id", pa.int64()), ("text", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int32())))])

    def finish(key, group, gone):
        ids, begins, ends = (
            np.frombuffer(b"".join(gone.column(c).to_pylist()), np.int64) for c in ("ids", "begins", "ends")
        )
        order = np.lexsort((begins, ids))
        ids, begins, ends = ids[order], begins[order], ends[order]
        rows = []
        for i, t in zip(group.column("id").to_pylist(), group.column("text").to_pylist()):
            raw, spans = (t or "").encode(), []
            if i is not None:
                a, b = np.searchsorted(ids, [i, i + 1]) if i < NO_ID else (len(ids), len(ids))
                for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist()):
                    if spans and x <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], y)
                    else:
                        spans.append([x, y])
            at, kept = 0, []
            for x, y in spans:
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            rows.append((i, t, b"".join(kept), spans))
        return _pack(rows, result)

    hashes = dealt.groupBy("batch").applyInArrow(hashes_of, _ddl(HASHES))
    shared = hashes.groupBy("bucket").applyInArrow(shared_of, _ddl(SHARED))
    parts = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(parts_of, _ddl(PARTS))
    gone = parts.groupBy("bucket").applyInArrow(gone_of, _ddl(GONE))
    return dealt.groupBy("batch").cogroup(gone.groupBy("batch")).applyInArrow(
        finish, "id long, text string, kept binary, spans array<array<int>>"
    )


def _stretches(values: np.ndarray) -> tuple[list, list, list]:
    """Value, begin and end of each run of equal values."""
    if not len(values):
        return [], [], []
    cut = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[cut].tolist(), cut.tolist(), np.append(cut[1:], len(values)).tolist()

"""Token ids in flat binary files, with constant-time access by document key.

Writing sorts documents by id over all partitions and streams the ids of each
partition into one shard: a header of 16 bytes, then the raw little-endian ids one
document after another, each closed by an end id. Entries (id, ordinal, shard,
offset, count) are written beside them.

The index maps a key, (id, ordinal among equal ids), to its entry by a minimal
perfect hash. Keys are dealt by hash to buckets; a bucket's keys go through levels
of bit arrays, each key taking the first level where it is alone at its bit; its
slot is the number of set bits before that one. Slots hold a fingerprint of the key,
so unknown keys are recognised, and the shard, offset and count. A lookup is two or
three hashes, a rank and one ranged read.

Null and empty texts have the end id only. Rows with the same id are stored in the
order of their texts and told apart by their ordinal. Rows without an id come first. Rows
of one id may fill many shards; their ordinals go on from shard to shard. Extra columns are not read. A retried task writes its shard anew under a name of its
own and moves it in place, so readers see whole files only.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import col, slices

HEADER, HEADER_BYTES = "<8sII", 16
SHARD_MAGIC, INDEX_MAGIC = b"TOKENIDS", b"TOKENIDX"
KEYS_PER_BUCKET = 8_000
#: Characters of a text by which texts of one id are dealt out.
RANGE_CHARS = 64
REMEMBERED = 700_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

# --- ids of texts ---------------------------------------------------------------

#: Letters whose lower case and composed form are one letter each.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Words of these, digits and punctuation, without what begins a contraction or a special token.
PLAIN = re.compile(rf"[{LETTERS}!-&(-;=-~]*")
PARTS = re.compile(rf"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies (a fixed rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    place = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [place[b] for b in range(256)]


class WordIds:
    """Ids by the tokenizers library, remembered by word.

    No token reaches over a space or a line end, so words are encoded one by one. A
    new word of letters and plain punctuation is cut and lower-cased as the
    vocabulary's rules would, and given to the library's merge model at once;
    any other goes through the whole library.
    """

    def __init__(self, spec: str, dtype: str):
        from tokenizers import Tokenizer

        self.library, self.dtype = Tokenizer.from_str(spec), dtype
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.tokenize = self.library.model.tokenize
        self.known: dict[str, bytes] = {}
        self.plain = self._plain_rules(spec)
        letters = _byte_letters()
        self.shown = {
            c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)
        }

    @staticmethod
    def _plain_rules(spec: str) -> bool:
        """Whether the vocabulary cuts words into letters, digits and the rest, in lower case."""
        import json

        rules = json.loads(spec)
        kinds = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        return (
            kinds == ["NFC", "Replace", "Lowercase"] and rules["model"]["type"] == "BPE"
            and r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in spec
        )

    def _new(self, word: str) -> list[int]:
        if not (self.plain and PLAIN.fullmatch(word)):
            return self.library.encode(word, add_special_tokens=False).ids
        parts = [word] if word.isalpha() else PARTS.findall(word)
        return [t.id for p in parts for t in self.tokenize(p.lower().translate(self.shown))]

    def blob(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, words = self.known, text.replace("\n", " ").split(" ")
        for w in set(words).difference(known):
            known[w] = array(self.code, self._new(w)).tobytes()
        return b"".join([known[w] for w in words])


#: What a worker process has learned, by vocabulary, so that not every task learns it anew.
_LEARNED: dict[tuple[int, str], WordIds] = {}


def word_ids(spec: str, dtype: str) -> WordIds:
    """The worker's own ``WordIds`` of a vocabulary; it keeps one vocabulary's words at a time."""
    key = hash(spec), dtype
    if key not in _LEARNED:
        _LEARNED.clear()
        _LEARNED[key] = WordIds(spec, dtype)
    return _LEARNED[key]


# --- files ----------------------------------------------------------------------


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark reads and writes it by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def _files(folder: str):
    """The file system of a folder given as a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)


def _publish(fs, temporary: str, path: str) -> None:
    """Moves a finished file to its place; an equal file of another attempt gives way."""
    try:
        fs.move(temporary, path)
    except OSError:
        fs.delete_file(path)
        fs.move(temporary, path)


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Writes shards, entries and index below ``folder`` (on storage all executors share); gives the entries."""
    spark = docs.sparkSession
    spec = open(tokenizer_path, encoding="utf-8").read()
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(spec)
    folder = qualified(spark, folder)
    fs, root = _files(folder)
    for part in ("shards", "index"):
        fs.create_dir(f"{root}/{part}", recursive=True)

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text).alias("text"))
    # texts of one id are dealt out by their beginnings
    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(
        F.asc_nulls_first("id"), "text"
    )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        context = TaskContext.get()
        number = context.partitionId()
        temporary = f"{root}/shards/.{number}-{context.taskAttemptId()}"
        words, end = None, np.array([end_id], dtype).tobytes()
        item, offset, last, ordinal = len(end), 0, object(), 0
        made: list[tuple] = []
        out = None
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    words = word_ids(shared.value, dtype)
                    out = fs.open_output_stream(temporary)
                    out.write(struct.pack(HEADER, SHARD_MAGIC, item, 0))
                for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    blob = words.blob(t) + end
                    out.write(blob)
                    ordinal = ordinal + 1 if i == last else 0
                    last = i
                    made.append((i, ordinal, number, offset, len(blob) // item))
                    offset += len(blob) // item
        if out is not None:
            out.close()
            _publish(fs, temporary, f"{root}/shards/{number:06d}.ids")
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=["id", "ordinal", "shard", "offset", "count"],
            )

    ordered.mapInArrow(shard, "id long, ordinal int, shard int, offset long, count long").write.parquet(
        f"{folder}/entries"
    )
    entries = _with_ordinals(spark.read.parquet(f"{folder}/entries"))
    _write_index(entries, folder)
    return entries


def _with_ordinals(entries: DataFrame) -> DataFrame:
    """Ordinals of a shard's first id go on from those that earlier shards have of it."""
    id_ = F.struct(F.col("id").isNotNull().alias("known"), "id").alias("id")
    edges = entries.groupBy("shard").agg(F.min(id_).alias("first"), F.max(id_).alias("last"))
    ends = entries.join(edges, "shard").groupBy("shard", "first", "last").agg(
        F.count_if(F.col("last.id").eqNullSafe(F.col("id"))).alias("of_last"), F.count("*").alias("rows")
    ).orderBy("shard").collect()  # a row per shard
    earlier, last, n = [], object(), 0
    for row in ends:
        if row["first"] == last:
            earlier.append((row["shard"], n))
        else:
            n = 0
        n = n + row["of_last"] if row["first"] == row["last"] else row["of_last"]
        last = row["last"]
    if not earlier:
        return entries
    found = entries.sparkSession.createDataFrame(earlier, "shard int, earlier long")
    firsts = edges.select("shard", F.col("first.id").alias("first_id"))
    added = F.when(F.col("id").eqNullSafe(F.col("first_id")), F.coalesce("earlier", F.lit(0))).otherwise(0)
    joined = entries.join(firsts, "shard").join(found, "shard", "left")
    return joined.select("id", (F.col("ordinal") + added).cast("int").alias("ordinal"), "shard", "offset", "count")


# --- index ----------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def _key_hash(ids: np.ndarray, ordinals: np.ndarray, seed: int) -> np.ndarray:
    """A hash of both numbers; the seed comes between them, so keys that meet under one seed part under another."""
    step = np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    h = _mixed(ids.astype(np.int64).view(np.uint64) + step)
    return _mixed((h ^ step) + ordinals.astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _keys(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ordinals as numbers; rows without an id get negative ordinals of their own."""
    ids = rows.column("id")
    absent, ordinals = np.asarray(ids.is_null()), np.asarray(rows.column("ordinal")).astype(np.int64)
    return np.asarray(ids.fill_null(NO_ID)), np.where(absent, -1 - ordinals, ordinals)


FINGERPRINT_SEED, GAMMA = 1_000, 2
#: Half of the keys, or more, find their place at each level.
MOST_LEVELS = 100


class PerfectHash:
    """A minimal perfect hash of keys given by ids and ordinals."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [s + np.concatenate([[0], np.cumsum(x)]) for s, x in zip(sums, levels)]

    @classmethod
    def build(cls, ids: np.ndarray, ordinals: np.ndarray) -> PerfectHash:
        levels = []
        while len(ids):
            if len(levels) == MOST_LEVELS:
                raise ValueError(f"{len(ids)} keys find no place of their own; are some given twice?")
            size = GAMMA * len(ids) + 1
            at = (_key_hash(ids, ordinals, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = ~bits[at]
            ids, ordinals = ids[left], ordinals[left]
        return cls(levels)

    def slots(self, ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 or any slot for keys that were not given to ``build``."""
        out = np.full(len(ids), -1, np.int64)
        open_ = np.arange(len(ids))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (_key_hash(ids[open_], ordinals[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def _fingerprint(ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return (_key_hash(ids, ordinals, FINGERPRINT_SEED) >> np.uint64(32)).astype("<u4")


NO_ID = -(2**63)
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("count", "<i8")])


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("id", "ordinal"), F.lit(buckets)).cast("int"))


def _write_index(entries: DataFrame, folder: str) -> None:
    """One index file for each bucket of keys, and their number."""
    buckets = -(-entries.count() // KEYS_PER_BUCKET) or 1

    def build(key, group):
        group = group.sort_by([("id", "ascending"), ("ordinal", "ascending")])
        ids, ordinals = _keys(group)
        index = PerfectHash.build(ids, ordinals)
        slots = np.zeros(len(ids), SLOT)
        at = index.slots(ids, ordinals)
        slots["fingerprint"][at] = _fingerprint(ids, ordinals)
        for name in ("shard", "offset", "count"):
            slots[name][at] = group.column(name).to_numpy()
        number = key[0].as_py()
        fs, root = _files(folder)
        temporary = f"{root}/index/.{number}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temporary) as out:
            out.write(struct.pack(HEADER, INDEX_MAGIC, len(index.levels), len(slots)))
            for bits in index.levels:
                out.write(struct.pack("<Q", len(bits)))
                out.write(np.packbits(bits).tobytes())
            out.write(slots.tobytes())
        _publish(fs, temporary, f"{root}/index/{number:06d}.mph")
        return pa.table({"bucket": pa.array([number], pa.int32()), "keys": pa.array([len(ids)], pa.int64())})

    dealt = _bucketed(entries, buckets).groupBy("bucket").applyInArrow(build, "bucket int, keys long")
    dealt.write.parquet(f"{folder}/buckets")
    totals = entries.groupBy("shard").agg(F.sum("count").alias("ids")).orderBy("shard").collect()  # a row per shard
    fs, root = _files(folder)
    begin = 0
    with fs.open_output_stream(f"{root}/shards.txt") as out:
        out.write(f"{buckets}\n".encode())
        for shard, n in totals:
            out.write(f"{shard} {begin}\n".encode())
            begin += n


def _read(fs, path: str) -> bytes:
    with fs.open_input_file(path) as file:
        return file.read()


def open_index(folder: str, bucket: int) -> tuple[PerfectHash, np.ndarray] | None:
    """The hash and slots of a bucket; None where no key fell into it."""
    fs, root = _files(folder)
    path = f"{root}/index/{bucket:06d}.mph"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    data = _read(fs, path)
    _, levels, keys = struct.unpack_from(HEADER, data)
    at, bits = HEADER_BYTES, []
    for _ in range(levels):
        (n,) = struct.unpack_from("<Q", data, at)
        size = -(-n // 8)
        bits.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 8))[:n].astype(bool))
        at += 8 + size
    return PerfectHash(bits), np.frombuffer(data, SLOT, keys, at)


def _layout(folder: str) -> tuple[int, dict[int, int]]:
    """Number of buckets, and the first id's place of every shard."""
    fs, root = _files(folder)
    first, *rest = _read(fs, f"{root}/shards.txt").decode().splitlines()
    return int(first), {int(s): int(n) for s, n in map(str.split, rest)}


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``id``, ``ordinal``, ``start``, ``count`` and ``ids`` (little-endian, 32 bit) of the keys found in the files.

    ``keys`` has ``id`` and ``ordinal``. Keys that the index does not hold give no row.
    """
    folder = qualified(spark, folder)
    buckets, begins = _layout(folder)
    asked = _bucketed(keys.select("id", "ordinal"), buckets)
    # at least two partitions a bucket would gain nothing: a bucket is read by one task, and is small
    dealt = asked.repartition(min(buckets, 10_000), "bucket").sortWithinPartitions("bucket", "id", "ordinal")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        current, index, files = None, None, {}
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if buckets[a] != current:
                    current, index = buckets[a], open_index(folder, int(buckets[a]))
                if index is None:
                    continue
                part = batch.slice(a, b - a)
                ids, ordinals = _keys(part)
                at = index[0].slots(ids, ordinals)
                slots = index[1][np.maximum(at, 0)]
                found = np.flatnonzero((at >= 0) & (slots["fingerprint"] == _fingerprint(ids, ordinals)))
                found = found[np.argsort(slots["shard"][found], kind="stable")]
                for some in np.array_split(found, -(-len(found) // 500) or 1):
                    rows = []
                    for i in some:
                        shard, offset, count = (int(slots[n][i]) for n in ("shard", "offset", "count"))
                        if shard not in files:
                            if len(files) >= 64:
                                files.pop(next(iter(files)))[0].close()
                            file = fs.open_input_file(f"{root}/shards/{shard:06d}.ids")
                            files[shard] = file, struct.unpack(HEADER, file.read_at(HEADER_BYTES, 0))[1]
                        file, item = files[shard]
                        raw = file.read_at(count * item, HEADER_BYTES + offset * item)
                        rows.append((begins[shard] + offset, count, np.frombuffer(raw, f"<u{item}").astype("<u4").tobytes()))
                    if rows:
                        start, count, raw = zip(*rows)
                        some = pa.array(some, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(some), part.column("ordinal").take(some), pa.array(start, pa.int64()),
                             pa.array(count, pa.int64()), pa.array(raw, pa.binary())],
                            names=["id", "ordinal", "start", "count", "ids"],
                        )

    return dealt.mapInArrow(fetch, "id long, ordinal int, start long, count long, ids binary")

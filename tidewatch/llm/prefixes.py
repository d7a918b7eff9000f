"""The prefix trie of conversations: which openings are shared, and what sharing them saves.

A turn becomes a digest of 128 bits of its role and text, a conversation the row of its
turns' digests. Equal conversations are one row with a weight. Rows are dealt into ranges by
their digests and sorted, so a part of them, a shard, is a matrix of turn ids, padded with
zeros: numpy's lexsort puts it in order, a column's changes against the row above, OR-ed with those
of the columns before it, mark where the nodes of that depth start, and ``reduceat`` over
these starts gives every figure of every node. Only nodes on a shard's first and last row can reach into
other shards. Their partial figures are added up by key, and each border between two shards corrects what
both have counted: the nodes that both border rows share.

A very frequent conversation or opening is no hot key: conversations are counted by parts of their ids
before they meet, and ranges cut through an opening wherever that balances them. The ids of equal
conversations are digested in one pass over parts of up to ``ID_PART`` ids, never held as a list.
A shard is bounded in cells, so one long conversation makes shards of fewer rows. One conversation by itself (24 bytes
a turn) and those that share a base have to fit a task.

Rows without a conversation's id are left out. Null roles and texts are empty ones. Turns without a number come
first; turns of one number are put in the order of their role and digest; repeated rows are turns of their own. An empty
table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import col, drop_stored, list_array, shared_folder

#: Conversations of one base differ by less than this; at most so many turns less one come from the base.
BASES, HEADS = 20, 4
#: Ids of equal conversations that are joined before they are digested.
ID_PART = 256
#: Cells of a padded matrix, and rows.
CELLS, ROWS = 2_000_000, 50_000
#: Bytes of a turn's digest.
TURN = 16
WORD = r"[^\x20\x09-\x0D]+"

FIGURES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A row of a shard: a node; or, with ``first``, the first and last row of a task's range.
PARTS = f"key binary, parent_key binary, {FIGURES}, first binary, first_words array<long>, last binary, last_words array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: ``conv_id`` and ``turns``, digest and words of each turn in order."""
    who, what = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text))
    # the role's length tells where it ends
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(who).cast("string"), who, what).cast("binary")))
    one = F.struct(col(turn).cast("long").alias("at"), who.alias("role"), digest.alias("turn"), F.regexp_count(what, F.lit(WORD)).cast("long").alias("words"))
    rows = conversations.select(col(conv_id).cast("long").alias("conv_id"), one.alias("one")).where("conv_id is not null")
    # conversations of one base are in one place already, for what follows
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASES).repartition("base")
    rows = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return rows.select("base", "conv_id", F.transform("all", lambda x: F.struct(x["turn"].alias("turn"), x["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations that begin with turns of their base: the first crc32(conv_id) % 4 of them, then own ones after as many."""
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEADS - 1))
    # one value for a base at most, of a few turns
    with_head = conversations.withColumn("head", F.max(head).over(Window.partitionBy("base")))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    no_turns = F.slice("turns", 1, 0)
    own = F.slice(F.col("turns"), n + 1, F.greatest(F.size("turns") - n, F.lit(0)))
    return with_head.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), n), no_turns), own).alias("turns"))


def _sequences(conversations: DataFrame) -> DataFrame:
    """``seq``, ``words``, ``part``, and the ids of equal conversations in that part: ``n``, ``least`` and ``ids``."""
    digests = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["turn"])), ""))
    rows = conversations.select(
        digests.alias("seq"), F.transform("turns", lambda x: x["words"]).alias("words"), "conv_id",
        F.floor(F.col("conv_id") / ID_PART).cast("long").alias("part"),
    )
    ids = F.sort_array(F.collect_list("conv_id"))
    return rows.groupBy("seq", "part").agg(
        F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.array_join(ids.cast("array<string>"), ",").alias("ids"),
    )


class Row:
    """One distinct conversation: digests, words, weight, least id and the digest of all ids."""

    def __init__(self, seq: bytes, words: np.ndarray):
        self.seq, self.words, self.weight, self.least, self.sha = seq, words, 0, None, hashlib.sha256()

    def add(self, n: int, least: int, ids: str) -> None:
        self.sha.update(f"{',' if self.weight else ''}{ids}".encode())
        self.weight += n
        self.least = least if self.least is None else min(self.least, least)

    def __len__(self) -> int:
        return len(self.seq) // TURN


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    """Distinct conversations from sorted parts of them."""
    row = None
    for batch in batches:
        words = batch.column("words")
        flat, ends = words.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
        columns = (batch.column(c).to_pylist() for c in ("seq", "n", "least", "ids"))
        for i, (seq, n, least, ids) in enumerate(zip(*columns)):
            if row is None or seq != row.seq:
                if row is not None:
                    yield row
                row = Row(seq, flat[ends[i] : ends[i + 1]].astype(np.int64))
            row.add(n, least, ids)
    if row is not None:
        yield row


def shards_of(rows: Iterator[Row], cells: int = CELLS, most: int = ROWS) -> Iterator[list[Row]]:
    """Rows in parts whose padded matrix is bounded."""
    part, width = [], 0
    for row in rows:
        wider = max(width, len(row))
        if part and ((len(part) + 1) * (wider + 1) > cells or len(part) >= most):
            yield part
            part, wider = [], len(row)
        part.append(row)
        width = wider
    if part:
        yield part


def keys_along(seq: bytes, depth: int) -> list[bytes]:
    """The keys of the nodes of depth 0 to ``depth`` on the way along a row."""
    made, out = hashlib.blake2b(digest_size=TURN), []
    out.append(made.digest())
    for d in range(depth):
        made.update(seq[d * TURN : (d + 1) * TURN])
        out.append(made.digest())
    return out


def common(a: bytes, b: bytes) -> int:
    """Turns that two rows have in common at their beginning."""
    n = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(s, np.uint8, n * TURN).reshape(n, TURN) for s in (a, b))
    differing = np.flatnonzero((x != y).any(axis=1))
    return int(differing[0]) if len(differing) else n


class Shard:
    """The padded matrix of distinct conversations, in order."""

    def __init__(self, rows: list[Row]):
        sizes = np.array([len(r) for r in rows], np.int64)
        width = int(sizes.max())
        turn_of = np.frombuffer(b"".join(r.seq for r in rows), f"V{TURN}")
        # the digests' order is the ids' order; 0 pads
        _, ids = np.unique(turn_of, return_inverse=True)
        filled = np.arange(width) < sizes[:, None]
        matrix, words = np.zeros((len(rows), width), np.int32), np.zeros((len(rows), width + 1), np.int64)
        matrix[filled] = ids.ravel() + 1
        words[:, 1:][filled] = np.concatenate([r.words for r in rows])
        order = np.lexsort(matrix.T[::-1]) if width else np.arange(len(rows))
        self.rows = [rows[i] for i in order]
        self.sizes, self.words, self.width = sizes[order], words[order], width
        matrix = matrix[order]
        #: Whether a row differs from the one above it in its first columns: at d, in d of them.
        changed = np.zeros((len(rows), width + 1), bool)
        changed[0] = True
        changed[1:, 1:] = matrix[1:] != matrix[:-1]
        self.starts = np.logical_or.accumulate(changed, axis=1)

    def nodes(self) -> Iterator[dict[str, np.ndarray | list]]:
        """Figures of all nodes, depth by depth; those with a ``key`` may reach into other shards."""
        rows, sizes, starts, words, width = self.rows, self.sizes, self.starts, self.words, self.width
        weight = np.array([r.weight for r in rows], np.int64)
        least = np.array([r.least for r in rows], np.int64)
        inside = np.arange(width + 1) <= sizes[:, None]
        begins = starts & inside
        # a row's tokens count for each conversation, less one for each node
        saved = words * (weight[:, None] - begins)
        saved[~inside] = 0
        saved = np.cumsum(saved[:, ::-1], axis=1)[:, ::-1]
        # the next row goes on from this one unless it differs in as many columns as this one has
        ends = np.ones(len(rows), np.int64)
        ends[:-1] = starts[np.arange(1, len(rows)), sizes[:-1]]
        first_keys, last_keys = keys_along(rows[0].seq, sizes[0]), keys_along(rows[-1].seq, sizes[-1])
        above, above_least = np.zeros(1, np.int64), None
        for d in range(width + 1):
            at = np.flatnonzero(starts[:, d])
            real = sizes[at] >= d
            n, low = np.add.reduceat(weight, at), np.minimum.reduceat(least, at)
            children = np.add.reduceat(begins[:, d + 1].astype(np.int64), at) if d < width else np.zeros(len(at), np.int64)
            leaves, tokens = np.add.reduceat(ends, at), np.add.reduceat(saved[:, d], at)
            parent = np.searchsorted(above, at, side="right") - 1
            keys: list[bytes | None] = [None] * len(at)
            parent_keys: list[bytes | None] = [None] * len(at)
            if d <= sizes[-1]:
                keys[-1] = last_keys[d]
            if d <= sizes[0]:
                keys[0] = first_keys[d]
            if d:
                # nodes below one that may reach into other shards learn its figures later
                for i in np.flatnonzero(parent == 0) if d - 1 <= sizes[0] else ():
                    parent_keys[i] = first_keys[d - 1]
                for i in np.flatnonzero(parent == len(above) - 1) if d - 1 <= sizes[-1] else ():
                    parent_keys[i] = last_keys[d - 1]
            ended = [rows[r].sha.hexdigest() if sizes[r] == d else NO_ENDS for r in at[real]]
            some = np.flatnonzero(real).tolist()
            yield {
                "key": [keys[i] for i in some], "parent_key": [parent_keys[i] for i in some], "conv_id": low[real],
                "depth": np.full(len(some), d), "parent_conv_id": pa.nulls(len(some), pa.int64()) if above_least is None else above_least[parent[real]],
                "n_convs": n[real], "n_children": children[real], "n_leaves": leaves[real], "saved_tokens": tokens[real], "ends_sha256": ended,
            }
            above, above_least = at, low


def border(last: bytes, words: np.ndarray, first: bytes) -> dict[str, np.ndarray | list]:
    """What two shards that meet between these rows have counted twice, for each node that both rows share."""
    n = common(last, first)
    keys = keys_along(last, n)
    tokens = np.concatenate([[0], words[:n]]).astype(np.int64)
    # a row that the next one goes on from is no leaf
    leaves = -1 if n * TURN == len(last) else 0
    return {
        "key": keys, "parent_key": [None, *keys[:-1]], "conv_id": pa.nulls(n + 1, pa.int64()), "depth": np.arange(n + 1),
        "parent_conv_id": pa.nulls(n + 1, pa.int64()), "n_convs": np.zeros(n + 1, np.int64),
        "n_children": np.where(np.arange(n + 1) < n, -1, 0), "n_leaves": np.full(n + 1, leaves),
        "saved_tokens": np.cumsum(tokens[::-1])[::-1], "ends_sha256": [NO_ENDS] * (n + 1),
    }


NODE_TYPES = {
    "key": pa.binary(), "parent_key": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}
EDGE_TYPES = {"first": pa.binary(), "first_words": pa.list_(pa.int64()), "last": pa.binary(), "last_words": pa.list_(pa.int64())}


def _batch(nodes: dict) -> pa.RecordBatch:
    n = len(nodes["key"])
    arrays = [x if isinstance(x := nodes[c], pa.Array) else pa.array(x, t) for c, t in NODE_TYPES.items()]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(n, t) for t in EDGE_TYPES.values())], names=[*NODE_TYPES, *EDGE_TYPES])


def _edge(first: Row, last: Row) -> pa.RecordBatch:
    made = [
        pa.array([first.seq], pa.binary()), list_array([first.words.tobytes()], np.int64, pa.int64()),
        pa.array([last.seq], pa.binary()), list_array([last.words.tobytes()], np.int64, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in NODE_TYPES.values()), *made], names=[*NODE_TYPES, *EDGE_TYPES])


def node_parts(sequences: DataFrame, cells: int = CELLS, most: int = ROWS, ranges: int | None = None) -> DataFrame:
    """Nodes of each shard, corrections at borders inside a task, and the edge rows of each task."""
    spread = sequences.repartitionByRange(*([ranges] if ranges else []), "seq").sortWithinPartitions("seq", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for rows in shards_of(rows_of(batches), cells, most):
            shard = Shard(rows)
            for nodes in shard.nodes():
                yield _batch(nodes)
            if last is not None:
                yield _batch(border(last.seq, last.words, shard.rows[0].seq))
            first, last = first or shard.rows[0], shard.rows[-1]
        if first is not None:
            yield _edge(first, last)

    return spread.mapInArrow(run, PARTS)


def _borders(edges: DataFrame) -> DataFrame:
    """Corrections at the borders between tasks; ``edges`` has a row for each task."""
    after = edges.select("last", "last_words", F.lead("first").over(Window.orderBy("first")).alias("next")).where("next is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(border(row["last"], np.array(row["last_words"], np.int64), row["next"]))

    return after.mapInArrow(run, PARTS)


def trie(conversations: DataFrame, cells: int = CELLS, most: int = ROWS, ranges: int | None = None, folder: str | None = None) -> DataFrame:
    """All nodes of the trie of ``conversations`` (``conv_id`` and ``turns``, as from ``turns`` or ``rebuilt``).

    Nodes of the shards are written to ``folder``, a new one below the checkpoint folder by default, which must
    stay until the result has been read.
    """
    spark = conversations.sparkSession
    folder = folder or shared_folder(spark, "trie-parts")
    node_parts(_sequences(conversations), cells, most, ranges).write.parquet(folder)
    parts = spark.read.parquet(folder)
    nodes, edges = parts.where("first is null"), parts.where("first is not null")
    figures = [x.split()[0] for x in FIGURES.split(", ")]
    partial = nodes.where("key is not null").unionByName(_borders(edges))
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    # only the shard that has the whole row knows who ends there
    ends = F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256")))
    shared = partial.groupBy("key").agg(
        F.first("parent_key", ignorenulls=True).alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in sums], F.coalesce(ends, F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    up = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("key is null and parent_key is not null").drop("parent_conv_id").join(up, "parent_key")
    whole = nodes.where("key is null and parent_key is null")
    return (
        whole.select(*figures).unionByName(below.select(*figures))
        .unionByName(shared.join(up, "parent_key", "left").select(*figures))
    )


def write_trie(conversations: DataFrame, folder: str) -> None:
    """The trie of a conversations table as Parquet, without intermediate tables left."""
    spark = conversations.sparkSession
    between = shared_folder(spark, "trie-parts")
    trie(turns(conversations), folder=between).write.parquet(folder)
    drop_stored(spark, between)

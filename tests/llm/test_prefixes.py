"""The prefix trie against a plain loop, with shards so small that most nodes reach over borders."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefixes

FIGURES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def own_turns(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(x[2], x[3]) for x in sorted(v)] for c, v in convs.items()}


def with_heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, some in members.items():
        below, stack = [], [node]
        while stack:
            below.append(stack.pop())
            stack += children[below[-1]]
        saved = sum((len(members[x]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(some) if len(convs[c]) == len(node))
        out.append((
            min(some), len(node), min(members[node[:-1]]) if node else None, len(some), len(children[node]),
            sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*FIGURES).collect()), key=repr)


def random_rows(seed, convs=150):
    rng = random.Random(seed)
    openings = [[(rng.choice(["user", "system", None]), rng.choice(["a b", "c", "", None, "d  e\nf"])) for _ in range(9)] for _ in range(3)]
    rows = []
    for i in range(convs):
        c = rng.choice([i, i * 37, -i])
        kept = rng.choice(openings)[: rng.randrange(8)]
        tail = [(rng.choice(["user", "assistant"]), rng.choice(["x", "y z", "w"])) for _ in range(rng.randrange(3))]
        # a third are the very same conversation
        turns = openings[0][:6] if i % 3 == 0 else kept + tail
        rows += [(c, rng.choice([t, t, t, None]) if i % 5 else t, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(None, 1, "user", "nobody's"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (9, None, None, None)]
    rows += [(5000, t, "user", "long") for t in range(300)] + [(5001, t, "user", "long") for t in range(290)]
    rows += [(6000, 0, "user", "word " * 50_000)]
    return list({r: None for r in rows}) + [(9, None, None, None)]


@pytest.mark.parametrize(("cells", "most", "ranges"), [(40, 3, 5), (2_000, 7, 2), (10**6, 1, 3), (10**6, 10**6, 1)])
def test_trie_against_plain_loop(spark, cells, most, ranges):
    rows = random_rows(cells)
    # a tie's order is by role and digest; here it is by text, so ties get one text
    seen, kept = {}, []
    for c, turn, role, text in rows:
        kept.append((c, turn, role or "", seen.setdefault((c, turn, role or ""), text)))
    df = spark.createDataFrame(kept, SCHEMA).repartition(4)
    got = trie_rows(prefixes.trie(prefixes.turns(df), cells, most, ranges))
    assert got == plain_trie(own_turns(kept))
    got = trie_rows(prefixes.trie(prefixes.rebuilt(prefixes.turns(df)), cells, most, ranges))
    assert got == plain_trie(with_heads(own_turns(kept)))


def test_turnless_conversations_and_empty_table(spark):
    # conversations 1 to 40 of one turn each; some are rebuilt to none, as their base is absent
    rows = [(c, 0, "user", "hi there") for c in range(1, 40) if c != 20]
    df = spark.createDataFrame(rows, SCHEMA)
    got = trie_rows(prefixes.trie(prefixes.rebuilt(prefixes.turns(df))))
    assert got == plain_trie(with_heads(own_turns(rows))) and got[0][3] == len(rows)
    assert prefixes.trie(prefixes.rebuilt(prefixes.turns(df.limit(0)))).collect() == []


def test_clashing_columns(spark):
    rows = [(c, t, "user", str(t)) for c in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("seq", "words", "base", "turns", "key", "one", "part"):
        df = df.withColumn(name, F.lit("x"))
    assert trie_rows(prefixes.trie(prefixes.turns(df))) == plain_trie(own_turns(rows))


def test_written_trie(spark, shared):
    rows = [(c, t, "user", str(t)) for c in range(30) for t in range(4)]
    prefixes.write_trie(spark.createDataFrame(rows, SCHEMA), f"{shared}/trie")
    assert trie_rows(spark.read.parquet(f"{shared}/trie")) == plain_trie(own_turns(rows))


def test_a_shard_is_bounded():
    rows = [prefixes.Row(b"x" * 16 * n, None) for n in [1, 2, 500, 1, 1, 1, 1]]
    parts = list(prefixes.shards_of(iter(rows), cells=600, most=3))
    assert [len(p) for p in parts] == [2, 1, 3, 1]

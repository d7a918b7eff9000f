"""Shards against the law and the mixture they promise, and against a plain ranking."""

import hashlib
import zlib
from collections import Counter

import pytest

from tidewatch.llm import sharding


def number(*parts):
    return int(hashlib.md5(":".join(p for p in parts if p is not None).encode()).hexdigest()[:15], 16)


def plain(rows, shards, seed=0):
    """(doc_id, shard, slot) of rows (doc_id, text, source)."""
    by_source = {}
    for i, text, source in rows:
        drawn = number(str(seed), None if i is None else str(i), hashlib.md5((text or "").encode()).hexdigest())
        by_source.setdefault("" if source is None else f"={source}", []).append((drawn, i))
    placed = []
    for s, some in by_source.items():
        u = number(str(seed), s) / float(1 << 60)
        placed += [((k + 1 - u) / len(some), s, drawn, i) for k, (drawn, i) in enumerate(sorted(some, key=repr_key))]
    out, n, slots = [], len(placed), Counter()
    for k, (_, _, _, i) in enumerate(sorted(placed, key=lambda x: x[:3])):
        shard = k * shards // n
        out.append((i, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=repr)


def repr_key(x):
    return x[0], repr(x[1])


def skewed(n=3000):
    # a third of all rows in one source, copies of one text, many sources of one row, rows without a source
    def source(i):
        return "hot" if i % 3 == 0 else None if i % 7 == 0 else f"own{i}" if i % 10 == 1 else f"s{i % 5}"

    return [(i, "copy" if i % 4 == 0 else None if i % 9 == 0 else f"text é {i}", source(i)) for i in range(n)]


@pytest.mark.parametrize(("shards", "least"), [(24, 1024), (7, 16), (1, 64), (5000, 64)])
def test_shards_against_plain_ranking(spark, monkeypatch, shards, least):
    monkeypatch.setattr(sharding, "LEAST_RANGES", least)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = skewed()
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), shards)
    assert sorted(((r.doc_id, r.shard, r.slot) for r in got.collect()), key=repr) == plain(rows, shards)


def test_law_mixture_and_sizes(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.assign(df, 24, seed=3).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source in ("hot", None, "s1", "s4"):
        per = Counter(r.shard for r in got if r.source == source)
        share = sum(per.values()) / 24
        assert all(abs(per[s] - share) <= 2.5 for s in range(24)), source
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    other = sharding.assign(df.repartition(7), 24, seed=3).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in other} == {(r.doc_id, r.shard, r.slot) for r in got}
    assert {(r.doc_id, r.shard) for r in sharding.assign(df, 24, seed=4).collect()} != {(r.doc_id, r.shard) for r in got}


def test_odd_rows_and_empty_table(spark, odd, plain_rows, empty):
    df = odd.selectExpr("*", "lang AS source", "'s' AS slot", "1 AS Shard", "'p' AS place", "'t' AS tie", "0 AS `rank_in`", "2 AS total")
    got = sharding.assign(df, 4).collect()
    assert sorted([(r.doc_id, r.text, r.lang) for r in got], key=repr) == sorted(plain_rows, key=repr)
    assert {(r.shard, r.slot) for r in got} == {(k * 4 // len(got), k - -(-(k * 4 // len(got)) * len(got) // 4)) for k in range(len(got))}
    assert all((r.place, r.tie, r.rank_in, r.total, r.node) == ("p", "t", 0, 2, "node") for r in got)
    assert sharding.assign(empty.selectExpr("*", "lang AS source"), 4).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(df, 0)


def test_written_shards_in_order_of_slots(spark, shared):
    rows = skewed(500)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(df, f"{shared}/shards", shards=5)
    want = {i: (s, k) for i, s, k in plain(rows, 5)}
    back = spark.read.parquet(f"{shared}/shards").collect()
    assert {(r.doc_id, r.text, r.source) for r in back} == set(rows) and all(want[r.doc_id] == (r.shard, r.slot) for r in back)
    for s in range(5):
        own = [r.slot for r in spark.read.parquet(f"{shared}/shards/shard={s}").coalesce(1).collect()]
        assert own == sorted(own)


def test_no_python_in_the_plan(spark):
    df = sharding.assign(spark.createDataFrame(skewed(50), "doc_id long, text string, source string"), 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

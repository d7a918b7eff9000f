"""The helpers that keep one busy key from ending up in one task."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import skew


@pytest.mark.parametrize("levels,fan", [(0, 4), (1, 3), (2, 4), (3, 2)])
def test_prefix_states(spark, levels, fan):
    rnd = random.Random(levels)
    rows = [
        (key, index, [rnd.randrange(3) for _ in range(3)])
        for key, n in (("hot", 200), ("b", 7), ("c", 1))
        for index in rnd.sample(range(-50, 400), n)
    ]
    df = spark.createDataFrame(rows, "k string, i bigint, fn array<int>")
    got = skew.prefix_states(df, ["k"], "i", "fn", 3, start=1, levels=levels, fan=fan).collect()
    want = {}
    for key in ("hot", "b", "c"):
        state = 1
        for _, index, fn in sorted(r for r in rows if r[0] == key):
            want[(key, index)] = state
            state = fn[state]
    assert {(r["k"], r["i"]): r["state"] for r in got} == want


def test_prefix_states_with_own_starts(spark):
    df = spark.createDataFrame([("a", 1, [1, 0]), ("a", 2, [1, 0]), ("z", 1, [0, 0])], "k string, i bigint, fn array<int>")
    starts = spark.createDataFrame([("a", 1)], "k string, _start int")
    got = skew.prefix_states(df, ["k"], "i", "fn", 2, start=starts).collect()
    assert {(r["k"], r["i"]): r["state"] for r in got} == {("a", 1): 1, ("a", 2): 0, ("z", 1): None}


@pytest.mark.parametrize("light", [2, 100])
def test_ordered_states_carry_their_rows(spark, light):
    rows = [("a", i, [1, 2, 0], f"a{i}") for i in range(9)] + [("b", 5, [0, 0, 0], "b5")]
    df = spark.createDataFrame(rows, "k string, i bigint, fn array<int>, name string")
    got = skew.ordered_states(df, ["k"], "i", "fn", 3, carry=["name"], light=light, fan=2).collect()
    assert {r["name"]: r["state"] for r in got} == {**{f"a{i}": i % 3 for i in range(9)}, "b5": 0}


def test_sliced_and_carried(spark):
    rnd = random.Random(9)
    rows = [("hot", t, t if rnd.random() < 0.2 else None) for t in range(-20, 60)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    cut = skew.sliced(df, F.col("t"), 8, 3)
    assert cut.filter("_own").count() == len(rows)
    # a copy lies in the next slice if and only if that slice starts within reach
    copies = {(r["_us"], r["_slice"]) for r in cut.filter("not _own").collect()}
    assert copies == {(t, t // 8 + 1) for _, t, _ in rows if (t + 2) // 8 > t // 8}
    out = skew.carry_forward(cut.filter("_own"), ["k"], ["_us"], "v", "seen").collect()
    want = reduce(lambda acc, r: {**acc, r[1]: r[2] if r[2] is not None else acc.get(r[1] - 1)}, rows, {})
    assert {r["t"]: r["seen"] for r in out} == want


def test_no_task_gets_a_whole_hot_key(spark):
    """A user with most of the rows is spread over many window partitions."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), F.col("id"))).otherwise("hot").alias("user_id"),
        (F.col("id") * 1_000_000).alias("us"),
    )
    cells = skew.sliced(rows, F.col("us"), 3_600_000_000, 60_000_000).groupBy("user_id", "_slice").count()
    assert cells.filter("user_id = 'hot'").agg(F.max("count")).first()[0] < 2_500


@pytest.mark.parametrize("fold", ["max", "sum"])
@pytest.mark.parametrize("levels,fan", [(0, 4), (1, 4), (3, 2)])
def test_what_lies_before(spark, fold, levels, fan):
    rnd = random.Random(levels)
    rows = [(k, i, None if rnd.random() < 0.2 else rnd.randint(-9, 9)) for k in ("a", None) for i in rnd.sample(range(-40, 60), 30)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = skew.before(df, ["k"], "i", "v", "earlier", getattr(F, fold), levels, fan).collect()
    assert len(out) == len(rows)
    for r in out:
        known = [v for k, i, v in rows if k == r["k"] and i < r["i"] and v is not None]
        assert r["earlier"] == ((max if fold == "max" else sum)(known) if known else None)

"""The rule index against Python's own evaluation and against compiled conditions."""

import random

import pytest
from pyspark.sql import functions as F
from python_meaning import run

from tidewatch.plans import match, rule_index
from tidewatch.plans.conditions import Condition
from tidewatch.plans.rule_index import RuleIndex
from tidewatch.plans.rules import Rule

SCHEMA = "n long, m int, x double, d double, s string, b boolean, l array<long>"
NAN, INF = float("nan"), float("inf")
WHOLE = [None, 0, 1, 2, 3, -4, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]
FLOATS = [None, 0.0, -0.0, 1.0, 2.5, -3.75, NAN, INF, -INF, 2.0**53, 1e300]
TEXTS = [None, "", "a", "b", "vip", "é", "\U0001f600", "￿", "A,b", "x'y"]


def rows(seed, n=150):
    rnd = random.Random(seed)
    return [
        (rnd.choice(WHOLE), rnd.choice([None, 0, 1, 2, -5]), rnd.choice(FLOATS), rnd.choice([None, 0.0, 2.5, -1.25]), rnd.choice(TEXTS),
         rnd.choice([None, True, False]), [1])
        for _ in range(n)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("d", F.col("d").cast("decimal(10,2)"))


def atom(rnd):
    name = rnd.choice("nmxdsb")
    if name == "s":
        value = lambda: repr(rnd.choice(TEXTS[1:]))
    else:
        value = lambda: repr(rnd.choice([0, 1, 2, -4, 2.5, 0.5, -3.75, 2**53 + 1, 2**63, -(2**70), 1e300, True, False]))
    other = rnd.choice(["None", "5", "'a'"])
    kind = rnd.randrange(9)
    if kind == 0:
        return f"{value()} {rnd.choice(['<', '<=', '==', '!=', '>', '>='])} {name}"
    if kind == 1:
        return f"{value()} {rnd.choice(['<', '<='])} {name} {rnd.choice(['<', '<=', '>'])} {value()}"
    if kind == 2:
        return f"{name} {rnd.choice(['in', 'not in'])} [{value()}, {other}, {value()}]"
    if kind == 3:
        return f"{name} {rnd.choice(['==', '!='])} {other}"
    if kind == 4:
        return name
    if kind == 5 and rnd.random() < 0.3:
        return f"{name} < {other}"
    return f"{name} {rnd.choice(['<', '<=', '==', '!=', '>', '>='])} {value()}"


def tree(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return atom(rnd)
    kind = rnd.randrange(3)
    if kind == 0:
        return f"(not {tree(rnd, depth - 1)})"
    word = " and " if kind == 1 else " or "
    return "(" + word.join(tree(rnd, depth - 1) for _ in range(rnd.randrange(2, 4))) + ")"


@pytest.mark.parametrize("block", [1024, 7])
def test_random_conditions_as_python(spark, monkeypatch, block):
    monkeypatch.setattr(rule_index, "BLOCK_RULES", block)
    rnd = random.Random(block)
    data = rows(3)
    df = frame(spark, data)
    texts = [tree(rnd, rnd.randrange(4)) for _ in range(250)]
    index = RuleIndex(texts, df.schema)
    assert len(index.compiled) < 100 and len(index.blocks) >= (1 if block > 250 else 20)
    got = [r.hits for r in df.select(index.hits.alias("hits")).collect()]
    for row, hits in zip(data, got):
        context = dict(zip(df.columns, row))
        for i, text in enumerate(texts):
            if i not in index.compiled:
                assert (i in hits) == run(text, context), (text, context)
        assert hits == sorted(set(hits))


def test_compiled_and_indexed_together(spark):
    data = rows(5, 80)
    df = frame(spark, data)
    texts = ["n > 1", "n + m > 2", "len(s) > 1", "s in ['a', 'vip']", "n < x", "True", "0", "undefined > 1", "n >", "", "not b", "l"]
    index = RuleIndex(texts, df.schema)
    assert sorted(index.compiled) == [1, 2, 4, 7, 8, 9, 11]
    columns = [Condition(t, df.schema).matches.alias(f"c{i}") for i, t in enumerate(texts)]
    for r in df.select(index.hits.alias("hits"), *columns).collect():
        assert r.hits == [i for i in range(len(texts)) if r[f"c{i}"]]


def test_long_normal_forms_are_compiled(spark):
    df = frame(spark, [(3, 1, 1.0, 1.0, "a", True, [1])])
    wide = " and ".join(f"(n > {i} or m == {i} or x < {i})" for i in range(12))
    index = RuleIndex([wide, "n == 3"], df.schema)
    assert list(index.compiled) == [0]
    assert df.select(index.hits.alias("hits")).first().hits == [0, 1] if run(wide, {"n": 3, "m": 1, "x": 1.0}) else [1]


def test_whole_numbers_are_exact(spark):
    df = spark.createDataFrame([(2**53 + 1,), (2**53,)], "n long")
    texts = [f"n > {float(2**53)}", f"n == {float(2**53)}", f"n <= {2**53}", "n < 9.3e18", "n > -1e400"]
    got = [r.hits for r in df.select(RuleIndex(texts, df.schema).hits.alias("hits")).collect()]
    assert got == [[0, 3, 4], [1, 2, 3, 4]]


def test_no_rules_no_rows(spark):
    df = frame(spark, rows(1, 3))
    assert [r.hits for r in df.select(RuleIndex([], df.schema).hits.alias("hits")).collect()] == [[], [], []]
    assert df.limit(0).select(RuleIndex(["n > 1"], df.schema).hits).collect() == []


def test_thousand_rules_match_and_validate(spark):
    rnd = random.Random(2)
    data = [(f"u{i}", rnd.randint(0, 50), rnd.choice([None, rnd.random()])) for i in range(100)]
    df = spark.createDataFrame(data, "user_id string, n long, x double")
    many = [
        Rule(f"r{i}", f"R{i}", f"n > {rnd.randint(0, 60)} and x < {rnd.random()}" if i % 2 else f"n == {i % 50} or n in [{i}, {i + 1}]", i % 5)
        for i in range(1000)
    ]
    ready = match.RuleSet(many, df.schema)
    assert not ready.index.compiled and ready.serves(list(many), df.schema) and not ready.serves(many[1:], df.schema)
    want = set()
    for u, n, x in data:
        held = [r for r in sorted(many, key=lambda r: -r.priority) if run(r.condition, {"n": n, "x": x})]
        want |= {(u, r.id, k, r.priority) for k, r in enumerate(held)}
    got = ready.match(df).select("user_id", "rule_id", "rank", "priority").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    plan = ready.match(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    checked = {r.rule_id: r for r in match.validate(df, many).collect()}
    nulls = sum(x is None for _, _, x in data)
    for i, r in enumerate(many):
        c = checked[r.id]
        assert (c.valid, c.valid_contexts) == ((False, 100 - nulls) if i % 2 else (True, 100))
        assert c.matched_contexts == sum(w[1] == r.id for w in want) and (c.error is None) == c.valid


def test_validation_of_no_contexts(spark):
    df = spark.createDataFrame([], "n long")
    (got,) = match.validate(df, [Rule("a", "A", "n > 1")]).collect()
    assert (got.valid, got.valid_contexts, got.matched_contexts, got.error) == (True, 0, 0, None)
    assert df.select(F.lit(1)).count() == 0

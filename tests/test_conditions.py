"""Compiled conditions against Python's own evaluation on random contexts."""

import random

import pytest
from pyspark.sql import functions as F
from python_meaning import run

from tidewatch.plans.conditions import SAMPLE_SCHEMA, Condition, field_condition

SCHEMA = (
    "user_id string, n long, m long, x double, y double, s string, t string, b boolean, "
    "l array<bigint>, q array<string>, d map<string,bigint>, r struct<a:bigint,c:string>"
)

GROUPS = {
    "comparison": [
        "n > 2", "n == 1 or m == 0", "n >= 1 and x > 0", "s == 'vip'", "s != t", "s < t", "n == True",
        "b == 1", "s == n", "n == None", "None == s", "s > n", "n > None", "n != n", "x == x", "n == 1.0",
        "n < m < 10", "0 <= n < 5", "n < 0 < undefined_v", "[n, m] == [1, 0]", "[1, 2] == (1, 2)",
        "l == [1, 2]", "[] == l", "d == d", "float('nan') == float('nan')", "float('inf') > x",
    ],
    "arithmetic": [
        "n + m * 2 > 3", "n / m > 0.5", "n // m == -1", "n % m == 1", "m % n == -1", "x // y > 0", "x % y >= 0",
        "n ** 2 == 4", "n ** m > 1", "x ** y > 2", "x ** 0.5 > 1", "2 ** -1 == 0.5", "0 ** n == 1", "-n > 2",
        "+b == 1", "-s", "b + 1 == 2", "str(n) + s == '2vip'", "s * 2 == 'vipvip'", "'a' * n == 'aa'",
        "l + [1] == [1]", "(n > 1) + (m > 1) == 2", "n + s", "n - None",
    ],
    "membership": [
        "n in [1, 2, None]", "s in ['vip', 'abc']", "'v' in s", "t in s", "n in l", "None in l", "s in q",
        "s in d", "n in (1, 2)", "x in [1.5, 3]", "n not in [1]", "s not in q", "1 in s", "'x' in 5",
        "n in {1: 2, 3: 4}",
    ],
    "boolean": [
        "not n", "not s and not t", "n < 100 or undefined_v", "(s or t)", "(n and s) == True", "b and n > 1",
        "(1 if n > 0 else undefined_v) == 1", "('a' if n > 0 else 3) == 3", "('a' if b else 'b') == 'a'",
        "n if n else s", "(n if b else x) > 1", "1", "'x'", "[]", "[0]", "{}", "()", "True", "None",
    ],
    "parts": [
        "d[t] > 0", "d['a'] == 1", "l[0] > 1", "l[-1] == 2", "l[n] > 0", "s[0] == 'v'", "r.a > 1", "r['c'] == 'z'",
        "r.zz", "[1, 'a', 2.5][n] == 'a'", "{'vip': 1, 'new': 'x'}[t] == 1", "{'a': 1}[s]",
    ],
    "functions": [
        "len(s) > 2", "len(l) > 1", "len(d) == 2", "len([n, m]) == 2", "len(n)", "str(n) == '2'", "str(x) == '1.5'",
        "str(x) == '10000000.0'", "str(x) == '1e-05'", "str(x) == '123456.789'", "str(b) == 'True'",
        "str(None) == 'None'", "int(s) > 5", "float(s) > 3", "int(x) == -2", "int('7') == 7",
        "int('ff', 16) == 255", "int(s, 16) > 5", "int(s, 2) == 1", "int(' -0x_1F ', 16) == -31", "int('0b11', 2) == 3", "int('Zz', 36) == 1295",
        "int(t, 36) > 10", "int(n, 16) == 1", "int('1', 1) == 1", "int('12', 2) == 1", "int('0b1', 16) == 177", "int('', 16) == 0", "bool(s)", "abs(n) > 2",
        "abs(x) > 2", "abs(b) == 1", "max(n, m) > 3", "min(x, n) < 0", "max(l) == 3", "min(q) == 'a'", "max(1, 'a')",
        "max([])", "max(n)", "max(l, default=1) == 3", "sum(l) > 3", "sum([n, m]) > 2", "sum(s)", "any(l)", "all(l)",
        "all(q)", "any([n, s])", "list(s) == ['v', 'i', 'p']", "len(set(l)) == 2", "tuple(l) == (1,)", "dict(d) == d",
    ],
    "refused": [
        "lambda: 1", "n is None", "s.upper()", "f'{n}'", "n & 1", "l[0:1]", "", "  n", "n >", "__import__('os')",
        "s.__class__", "round(x) == 2", "len(*l)", "{**d}", "[i for i in l]", "~n", "open('f')", "(n := 1)",
    ],
}


def _contexts(seed: int, size: int):
    rnd = random.Random(seed)

    def maybe(value):
        return None if rnd.random() < 0.12 else value

    return [
        (
            f"u{i}", maybe(rnd.randint(-4, 6)), maybe(rnd.choice([0, 1, 2, -3, 10**6])),
            maybe(rnd.choice([0.0, 1.5, -2.5, 1e7, 1e-5, 123456.789, 3.0])), maybe(rnd.choice([2.0, -0.5, 0.0, 7.25])),
            maybe(rnd.choice(["", "vip", "12", " 7 ", "3.5", "abc", "1e3", "inf", "x_1"])),
            maybe(rnd.choice(["vip", "new", "", "b"])), maybe(rnd.random() < 0.5),
            maybe([maybe(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 4))]),
            maybe([rnd.choice(["a", "b", "vip"]) for _ in range(rnd.randint(0, 3))]),
            maybe({k: rnd.randint(0, 2) for k in rnd.sample(["a", "b", "vip"], rnd.randint(0, 3))}),
            maybe((rnd.randint(0, 3), "z")),
        )
        for i in range(size)
    ]


class _Record:
    """A struct as Python sees it: fields by name and by key."""

    def __init__(self, a, c):
        self.a, self.c = a, c

    def __getitem__(self, key):
        return {"a": self.a, "c": self.c}[key]


@pytest.fixture(scope="module")
def contexts(spark):
    rows = _contexts(5, 120)
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("group", list(GROUPS))
def test_same_as_python(contexts, group):
    rows, df = contexts
    names = df.columns
    texts = GROUPS[group]
    got = df.select(*[Condition(c, df.schema).matches.alias(f"c{i}") for i, c in enumerate(texts)]).collect()
    for i, text in enumerate(texts):
        for row, out in zip(rows, got):
            context = dict(zip(names, row))
            context["r"] = _Record(*row[-1]) if row[-1] is not None else None
            assert out[i] == run(text, context), (text, context)


def test_random_expressions(contexts):
    """Expressions grown at random from the same grammar."""
    rows, df = contexts
    rnd = random.Random(11)
    atoms = ["n", "m", "x", "y", "s", "t", "b", "l", "1", "0", "2.5", "'vip'", "None", "nope", "len(s)", "abs(n)"]

    def grow(depth):
        if depth == 0 or rnd.random() < 0.2:
            return rnd.choice(atoms)
        a, b = grow(depth - 1), grow(depth - 1)
        kind = rnd.randrange(6)
        if kind == 0:
            return f"({a} {rnd.choice(['+', '-', '*', '/', '//', '%'])} {b})"
        if kind == 1:
            return f"({a} {rnd.choice(['<', '<=', '>', '>=', '==', '!='])} {b})"
        if kind == 2:
            return f"({a} {rnd.choice(['and', 'or'])} {b})"
        if kind == 3:
            return f"(not {a})"
        if kind == 4:
            return f"({a} if {b} else {grow(depth - 1)})"
        return f"({a} in [{b}, {grow(0)}])"

    # a "%" with text on the left is formatting in Python, which conditions do not offer
    texts = [t for t in (grow(3) for _ in range(160)) if "% " not in t][:90]
    got = df.select(*[Condition(c, df.schema).matches.alias(f"c{i}") for i, c in enumerate(texts)]).collect()
    for i, text in enumerate(texts):
        for row, out in zip(rows, got):
            assert out[i] == run(text, dict(zip(df.columns, row))), (text, row)


def test_problem_is_named(spark):
    assert "undefined variable" in Condition("no_such > 1", SAMPLE_SCHEMA).problem
    assert "invalid syntax" in Condition("a >", SAMPLE_SCHEMA).problem
    assert Condition("event_count > 1", SAMPLE_SCHEMA).problem is None


def test_deep_conditions_stay_small(spark):
    """Depth must not multiply the plan: 60 chained operators compile and run."""
    df = spark.createDataFrame([("u", 1)], "user_id string, n long")
    text = "n" + " + n" * 60 + " > 60 and " + " and ".join("n == 1" for _ in range(60))
    assert df.select(Condition(text, df.schema).matches.alias("m")).first()["m"] is True


def test_field_conditions():
    assert field_condition("a", "not_in", [1]) == "a not in [1]"
    assert field_condition("a", "contains", "x") == "'x' in a"
    assert field_condition("a", ">=", 3) == "a >= 3"
    with pytest.raises(ValueError):
        field_condition("a", "like", 1)


def test_whole_numbers_in_any_base(spark):
    """Up to 64 bits as Python; longer ones are errors, not failures of the job."""
    import random

    rnd = random.Random(1)
    for base in (2, 3, 10, 16, 35, 36):
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
        rows = []
        for size in (1, 5, 6, 7, 12, 13, 19, 20, 40, 63, 64, 90):
            text = "".join(rnd.choice(digits) for _ in range(size))
            rows += [(text,), ("-" + text.upper(),), ("0" * 30 + text,)]
        df = spark.createDataFrame([*rows, ("",), ("_1",), ("1__1",), (None,), ("z!",)], "s string")
        got = df.select("s", Condition(f"int(s, {base}) > 1000", df.schema).matches.alias("m")).collect()
        for r in got:
            try:
                want = 1000 < int(r["s"], base) < 2**63
            except (ValueError, TypeError):
                want = False
            assert r["m"] == want, (base, r["s"])


BEYOND = [
    "9223372036854775807 + n > 0", "n ** 10 > 1", "n ** 10 == 97656250000000000", "n * 10**18 > 1",
    "n * 10**18 == 50 * 10**18", "n * 10**18 * m < 0", "-(n * 10**18) < -10**19", "abs(m * 10**19) > 10**19",
    "n ** 20 % 7 == 1", "m ** 21 % 7 == 3", "m ** 21 // 10**18 == -1", "n ** 20 // 10**15 > 10**18", "2 ** 60 + 1 > 2 ** 60",
    "n ** 60 > 10**30", "n ** 200 == n ** 199", "n ** 400 > 1", "n in [10**20, 50]", "n not in [10**20]",
    "str(n * 10**18) == '50000000000000000000'", "float(n * 10**18) == 5e19", "bool(n * 10**18)", "not n * 10**18",
    "int(n * 10**18) > 10**19", "n * 10**18 / 10**18 == 50", "n * 10**18 - n * 10**18 == 0", "n * 10**18 == None",
    "n * 10**18 > x", "10**30 > n", "-10**30 < n < 10**30", "sum([n * 1, 10**18]) > n", "n * m * m * m > 0",
    "(n * 10**18) % 0 == 0", "10**38 > n * 10**36",
    "len(s * 5000000) > 1", "len(s * -3) == 0", "len([n] * 5000000) == 5000000", "len(l * 3) > 3", "len(n * m)",
    "'%s' % n == '50'", "'%s%%' % x == '1.5%'", "'%d/%s' % (n, s) == '50/ab'", "'%d' % s == ''", "'%s' % (n, m) == ''",
    "{'a': n} == {'a': 50}", "{'a': n} == {'b': 50}", "{'a': n, 'b': m} != {'b': m, 'a': n}", "d == {'a': 1}", "{'a': 1, 'b': 2} == d",
    "{'a': None} == d", "{1: n} == d", "{} == {}", "n == {'a': 50}", "m == -7", "{-1: n}[-1] == 50",
]


def test_beyond_64_bits_as_python(spark):
    """Large whole numbers, lengths of long repeats, filled-in text and dicts mean what they mean in Python."""
    schema = "n long, m long, x double, s string, l array<bigint>, d map<string,bigint>"
    rows = [
        (50, -7, 1.5, "ab", [1, 2], {"a": 1}), (1, 0, 2.0, "", [], {"a": 1, "b": 2}), (-3, 2**62, 1e20, "x", [None], {}),
        (0, 1, 0.0, "ab", [1], {"a": None}), (None, 5, None, None, None, None), (2**63 - 1, -(2**63), -1e300, "y", [7], {"a": 50}),
    ]
    df = spark.createDataFrame(rows, schema)
    got = df.select(*[Condition(c, df.schema).matches.alias(f"c{i}") for i, c in enumerate(BEYOND)]).collect()
    wrong = [
        (text, row) for i, text in enumerate(BEYOND) for row, out in zip(rows, got)
        if out[i] != run(text, dict(zip(df.columns, row)))
    ]
    assert not wrong


def test_powers_of_small_numbers(spark):
    """Up to 38 digits exactly, beyond as doubles."""
    df = spark.createDataFrame([(i,) for i in range(-50, 51)], "n long")
    texts = ["n ** 100 > n ** 99", "n ** 22 > n ** 21 + 1", "n ** 21 + 1 == n * n ** 20 + 1", "(n ** 21 - 7) // 13 % 11 == 3"]
    got = df.select("n", *[Condition(c, df.schema).matches.alias(f"c{i}") for i, c in enumerate(texts)]).collect()
    assert [(c, r["n"]) for r in got for i, c in enumerate(texts) if r[i + 1] != run(c, {"n": r["n"]})] == []


def test_what_cannot_be_told_is_no_match(spark):
    """Beyond 38 digits numbers are approximate: equal ones are neither found equal nor different."""
    df = spark.createDataFrame([(50,)], "n long")
    texts = ["n ** 200 == n ** 200", "n ** 200 != n ** 200", "n ** 200 + 1 > n ** 200", "n ** 200 - n ** 200 > -1", "n ** 200 % 7 == 1"]
    got = df.select(*[Condition(c, df.schema).matches.alias(f"c{i}") for i, c in enumerate(texts)]).first()
    assert list(got) == [False] * 5

"""Many rules at once: a bitmap index over the simple comparisons of their conditions.

Most conditions join comparisons of one variable with constants by ``and``, ``or`` and ``not``.
Such a rule is put into a normal form, a few conjunctions, each with one set of allowed values
for each variable. All constants that a variable is compared with, sorted, cut its values
into cells: the constants themselves, the gaps between them, and two more for NaN and null. A set of
allowed values is then a set of cells, and a variable's index gives for each cell a bitmap of the
conjunctions that it leaves possible. A context is looked up by one binary search a
variable; the bits left after all its variables' bitmaps are AND-ed are the conjunctions that hold.

The work for a row grows with the logarithm of the constants and with rules / 64, and nothing of a simple rule
is compiled. Rules go into the index in blocks, each with constants of its own, so the index grows in
proportion to the rules. Other conditions, and those whose normal form is long, are compiled as columns.

The meaning is that of ``Condition``: Python's, exact for whole numbers against fractions, and an error, as in ordering a null,
is no match wherever in the condition it stands.
"""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans.conditions import Condition

#: Rules of a block; conjunctions that a rule may have before it is compiled instead.
BLOCK_RULES, MOST_CONJUNCTIONS = 1024, 64
#: Bits of a word.
WORD = 64
_MIRRORED = {ast.Lt: ast.Gt, ast.Gt: ast.Lt, ast.LtE: ast.GtE, ast.GtE: ast.LtE, ast.Eq: ast.Eq, ast.NotEq: ast.NotEq}
_ORDER = (ast.Lt, ast.LtE, ast.Gt, ast.GtE)
_LEAST, _MOST = -(2**63), 2**63 - 1


class NotSimple(Exception):
    """The condition is none that the index can hold."""


def variable_kind(data_type: T.DataType) -> str | None:
    """How a column's values are compared; None if the index does not hold such columns."""
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return "whole"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "text" if isinstance(data_type, T.StringType) else None


# --- conditions as trees of tests ---------------------------------------------

@dataclass(frozen=True)
class Test:
    """What values of a variable are allowed: compared (``op``) with a constant, or all but those allowed."""

    name: str
    op: str  # < <= == > >= none always
    constant: object = None
    negated: bool = False


Tree = Test | tuple  # ("and" | "or", [trees])


def _constant(node: ast.expr) -> object:
    if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, (bool, int, float, str))):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = _constant(node.operand)
        if isinstance(value, (bool, int, float)):
            return -value if isinstance(node.op, ast.USub) else +value
    raise NotSimple


def _is_constant(node: ast.expr) -> bool:
    try:
        _constant(node)
    except NotSimple:
        return False
    return True


def _whole_test(name: str, op: str, c: int | float) -> Test:
    """A test of a whole number against any number, exact."""
    if isinstance(c, float):
        if math.isinf(c):
            return Test(name, "always", negated=op == "==" or (op[0] == "<") != (c > 0))
        if op == "==" and not c.is_integer():
            return Test(name, "always", negated=True)
        c = math.ceil(c) if op in ("<", ">=") else math.floor(c)
    if not _LEAST <= c <= _MOST:
        return Test(name, "always", negated=op == "==" or (op[0] == "<") != (c > 0))
    return Test(name, op, int(c))


class Parser:
    """One condition as a tree of tests, and the variables that must not be null for it to be valid."""

    def __init__(self, text: str, kinds: dict[str, str | None]):
        self.kinds = kinds
        self.required: set[str] = set()
        self.tree = self._tree(ast.parse(text, mode="eval").body, False)

    def _kind(self, name: str) -> str:
        kind = self.kinds.get(name)
        if kind is None:
            raise NotSimple
        return kind

    def _tree(self, node: ast.expr, negated: bool) -> Tree:
        if isinstance(node, ast.BoolOp):
            parts = [self._tree(v, negated) for v in node.values]
            return ("and" if isinstance(node.op, ast.And) != negated else "or", parts)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return self._tree(node.operand, not negated)
        if isinstance(node, ast.Name):
            # true unless null or empty
            empty = self._equal(node.id, "" if self._kind(node.id) == "text" else 0)
            return self._all([self._equal(node.id, None), empty], not negated, "or")
        if isinstance(node, ast.Compare):
            return self._compare(node, negated)
        if isinstance(node, ast.Constant):
            return ("and" if bool(_constant(node)) != negated else "or", [])
        raise NotSimple

    def _all(self, tests: list[Test], negated: bool, way: str = "and") -> Tree:
        if negated:
            way = "or" if way == "and" else "and"
            tests = [Test(t.name, t.op, t.constant, not t.negated) for t in tests]
        return (way, tests)

    def _compare(self, node: ast.Compare, negated: bool) -> Tree:
        parts = [node.left, *node.comparators]
        if len(node.ops) == 2 and isinstance(parts[1], ast.Name) and all(isinstance(o, _ORDER) for o in node.ops):
            # constant < variable < constant: the variable's null fails at the first of both
            low = self._test(parts[1].id, _MIRRORED[type(node.ops[0])], _constant(parts[0]))
            return self._all([low, self._test(parts[1].id, type(node.ops[1]), _constant(parts[2]))], negated)
        if len(node.ops) != 1:
            raise NotSimple
        op, (left, right) = type(node.ops[0]), parts
        if op in (ast.In, ast.NotIn):
            if not isinstance(left, ast.Name) or not isinstance(right, (ast.List, ast.Tuple)):
                raise NotSimple
            members = [self._equal(left.id, _constant(e)) for e in right.elts]
            return self._all(members, negated != (op is ast.NotIn), "or")
        if isinstance(right, ast.Name) and _is_constant(left):
            left, right, op = right, left, _MIRRORED.get(op)
        if not isinstance(left, ast.Name) or op not in _MIRRORED:
            raise NotSimple
        value = _constant(right)
        if op in (ast.Eq, ast.NotEq):
            return self._all([self._equal(left.id, value)], negated != (op is ast.NotEq))
        return self._all([self._test(left.id, op, value)], negated)

    def _equal(self, name: str, value: object) -> Test:
        kind = self._kind(name)
        if value is None:
            return Test(name, "none")
        if (kind == "text") != isinstance(value, str):
            return Test(name, "always", negated=True)
        return self._number(name, "==", value) if kind != "text" else Test(name, "==", value)

    def _number(self, name: str, op: str, value: int | float) -> Test:
        if self._kind(name) == "whole":
            return _whole_test(name, op, value)
        if isinstance(value, int) and (abs(value) > 2**1023 or int(float(value)) != value):
            raise NotSimple
        return Test(name, op, float(value) + 0.0)

    def _test(self, name: str, op: type, value: object) -> Test:
        kind, sign = self._kind(name), {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}[op]
        if value is None or (kind == "text") != isinstance(value, str):
            raise NotSimple  # always an error: the compiler tells which
        self.required.add(name)
        return Test(name, sign, value) if kind == "text" else self._number(name, sign, value)


# --- cells ----------------------------------------------------------------------

class Cells:
    """The values of one variable, cut at constants: gap, constant, gap, ..., gap, NaN, null."""

    def __init__(self, constants: Iterable):
        # Python orders text by code point, as Spark does by UTF-8 bytes
        self.constants = sorted(set(constants))
        self.place = {c: i for i, c in enumerate(self.constants)}
        self.n = 2 * len(self.constants) + 3

    def allowed(self, test: Test) -> np.ndarray:
        """Which cells pass a test."""
        out = np.zeros(self.n, bool)
        gaps = self.n - 2
        if test.op == "none":
            out[-1] = True
        elif test.op == "always":
            # where nulls do not count, they are required to be absent
            out[:] = True
        else:
            at = 2 * self.place[test.constant] + 1
            begin, end = {"<": (0, at), "<=": (0, at + 1), "==": (at, at + 1), ">": (at + 1, gaps), ">=": (at, gaps)}[test.op]
            out[begin:end] = True
        return ~out if test.negated else out


Conjunction = dict[str, np.ndarray]


def conjunctions(tree: Tree, cells: dict[str, Cells]) -> list[Conjunction]:
    """A tree as conjunctions of allowed cells; more than ``MOST_CONJUNCTIONS`` are NotSimple."""
    if isinstance(tree, Test):
        return _tidy([{tree.name: cells[tree.name].allowed(tree)}])
    way, parts = tree
    if way == "or":
        out = []
        for part in parts:
            out = _tidy(out + conjunctions(part, cells))
        return out
    out = [{}]
    for part in parts:
        out = _tidy([
            {**a, **{name: allowed & a[name] if name in a else allowed for name, allowed in b.items()}}
            for b in conjunctions(part, cells) for a in out
        ])
    return out


def _tidy(found: list[Conjunction]) -> list[Conjunction]:
    """Without impossible conjunctions and tests that always pass; those on the same single variable as one."""
    out, single = [], {}
    for c in found:
        c = {name: allowed for name, allowed in c.items() if not allowed.all()}
        if not all(allowed.any() for allowed in c.values()):
            continue
        if not c:
            return [{}]
        if len(c) == 1:
            (name, allowed), = c.items()
            if name in single:
                single[name][name] = single[name][name] | allowed
                continue
            single[name] = c
        out.append(c)
    if len(out) > MOST_CONJUNCTIONS:
        raise NotSimple
    return out


def _constants(tree: Tree) -> Iterable[Test]:
    if isinstance(tree, Test):
        yield tree
    else:
        for part in tree[1]:
            yield from _constants(part)


# --- the index ------------------------------------------------------------------

def _numbers(values: Iterable, kind: str) -> Column:
    """Numbers as one literal array, made in one call."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass
class Block:
    """Conjunctions of some rules: their places, and allowed cells of each variable."""

    cells: dict[str, Cells] = field(default_factory=dict)
    #: The rule's number of each conjunction, and the conjunctions.
    rules: list[int] = field(default_factory=list)
    found: list[Conjunction] = field(default_factory=list)

    def words(self) -> int:
        return -(-len(self.rules) // WORD)

    def bitmaps(self, name: str) -> np.ndarray:
        """For each cell of a variable, words with a bit for each conjunction that the cell leaves possible."""
        bits = np.ones((self.cells[name].n, self.words() * WORD), bool)
        for i, c in enumerate(self.found):
            if name in c:
                bits[:, i] = c[name]
        return np.packbits(bits, axis=1, bitorder="little").view("<i8")

    def hits(self, columns: dict[str, tuple[Column, str]]) -> Column:
        """Numbers of the rules that hold, in order and once each."""
        words = self.words()
        left = F.array_repeat(F.lit(-1).cast("bigint"), words)
        for name in sorted({n for c in self.found for n in c}):
            rows = _numbers(self.bitmaps(name).ravel().tolist(), "bigint")
            own = F.slice(rows, self._cell(name, *columns[name]) * words + 1, words)
            left = F.zip_with(left, own, lambda a, b: a.bitwiseAND(b))
        bits = _numbers(range(WORD), "int")
        live = F.filter(F.transform(left, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"] != 0)
        numbers = F.flatten(F.transform(live, lambda x: F.transform(
            F.filter(bits, lambda b: F.getbit(x["w"], b) == 1), lambda b: x["i"] * WORD + b
        )))
        rules = _numbers(self.rules, "int")
        # bits beyond the last conjunction are no rules
        return F.array_distinct(F.transform(F.filter(numbers, lambda n: n < len(self.rules)), lambda n: F.get(rules, n)))

    def _cell(self, name: str, column: Column, kind: str) -> Column:
        """The cell of a variable's value, by binary search."""
        constants = self.cells[name].constants
        n = len(constants)
        if not n:
            place = F.lit(0)
        else:
            if kind == "text":
                sorted_ = F.array(*[F.lit(c) for c in constants])
            else:
                sorted_ = _numbers(constants, "bigint" if kind == "whole" else "double")
            steps = _numbers((1 << k for k in reversed(range(n.bit_length()))), "int")
            place = F.aggregate(
                steps, F.lit(0),
                lambda at, step: F.when((at + step <= n) & (F.get(sorted_, at + step - 1) <= column), at + step).otherwise(at),
                # the constant itself is the cell before the gap behind it
                lambda at: at * 2 - F.when(F.get(sorted_, at - 1) == column, 1).otherwise(0),
            )
        out = F.when(column.isNull(), 2 * n + 2)
        if kind == "float":
            out = out.when(F.isnan(column), 2 * n + 1)
        return out.otherwise(place)


class RuleIndex:
    """Conditions compiled against a schema, to be evaluated together.

    ``hits`` is a column: the numbers of the conditions that hold, in ascending order. ``valid_columns`` has for each number
    a column that tells whether the condition evaluates without error. ``compiled`` are the numbers of those that
    the index does not hold.
    """

    def __init__(self, texts: list[str], schema: T.StructType):
        self._types = {f.name: f.dataType for f in schema.fields}
        kinds = {name: variable_kind(t) for name, t in self._types.items()}
        parsed: list[tuple[int, Parser]] = []
        self.compiled: dict[int, Condition] = {}
        self.required: dict[int, frozenset[str]] = {}
        for i, text in enumerate(texts):
            try:
                parsed.append((i, Parser(text, kinds)))
            except (NotSimple, SyntaxError, ValueError, RecursionError, MemoryError):
                self.compiled[i] = Condition(text, schema)
        self.blocks: list[Block] = []
        for begin in range(0, len(parsed), BLOCK_RULES):
            self._add(parsed[begin : begin + BLOCK_RULES], texts, schema)
        self.hits = self._hits()

    def _add(self, parsed: list[tuple[int, Parser]], texts: list[str], schema: T.StructType) -> None:
        constants: dict[str, set] = {}
        for _, p in parsed:
            for test in _constants(p.tree):
                constants.setdefault(test.name, set())
                if test.op not in ("none", "always"):
                    constants[test.name].add(test.constant)
        block = Block({name: Cells(some) for name, some in constants.items()})
        for i, p in parsed:
            # whatever the tree says, an error is no match
            valid = [("and", [p.tree, *(Test(name, "none", negated=True) for name in sorted(p.required))])]
            try:
                found = conjunctions(("and", valid), block.cells)
            except NotSimple:
                self.compiled[i] = Condition(texts[i], schema)
                continue
            self.required[i] = frozenset(p.required)
            block.rules += [i] * len(found)
            block.found += found
        if block.rules:
            self.blocks.append(block)

    def _columns(self) -> dict[str, tuple[Column, str]]:
        as_kind = {"whole": "bigint", "float": "double"}
        out = {}
        for name, data_type in self._types.items():
            kind = variable_kind(data_type)
            if kind:
                column = F.col("`" + name.replace("`", "``") + "`")
                out[name] = (column.cast(as_kind[kind]) if kind in as_kind else column, kind)
        return out

    def _hits(self) -> Column:
        columns = self._columns()
        parts = [b.hits(columns) for b in self.blocks]
        rest = [F.when(c.matches, F.lit(i)) for i, c in self.compiled.items()]
        if rest:
            parts.append(F.array_compact(F.array(*rest)))
        if not parts:
            return F.array().cast("array<int>")
        return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0]

    def valid_sets(self) -> tuple[list[Column], dict[int, int]]:
        """Columns that tell validity, and which of them each condition has; simple conditions share them."""
        columns: list[Column] = []
        of: dict[int, int] = {}
        seen: dict[frozenset[str], int] = {}
        for i, names in self.required.items():
            if names not in seen:
                seen[names] = len(columns)
                held = F.lit(True)
                for name in sorted(names):
                    held = held & F.col("`" + name.replace("`", "``") + "`").isNotNull()
                columns.append(held)
            of[i] = seen[names]
        for i, c in self.compiled.items():
            of[i] = len(columns)
            columns.append(c.valid)
        return columns, of


def literal_rows(rows: list[dict], kind: str) -> Column:
    """Records as one literal array of structs, made in one call."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)

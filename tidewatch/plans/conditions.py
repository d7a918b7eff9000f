"""Rule conditions as Spark columns.

A condition is a Python expression over a user's variables. It is parsed once on
the driver with the standard library and becomes an ordinary column, so Spark
evaluates all rules in generated code next to the data.

Meaning follows Python, and *an error means no match*. Each value therefore
carries a second column, ``ok``, that is false in rows where Python would raise.
Column types are known beforehand, so most errors are decided here; only nulls,
zero divisors, ranges and unreadable text are left to the rows.

A value whose type depends on the row (``'x' if a else 1``) is kept as guarded
alternatives of one type each.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("bool", "int", "float")
SEQUENCES = ("list", "tuple", "set")
REPEAT_LIMIT = 1 << 22
WIDE = "decimal(38,0)"
WIDE_END = 10**38
EXACT_FLOAT = 2.0**53
# wide numbers are divided by less than SMALL in two parts, the last HALF_DIGITS apart
HALF_DIGITS, SMALL = 19, 10**12
# approximate numbers differ where they do by this share of them
NEAR = 1e-9
# constants are worked out beforehand up to this many bits
FOLD_BITS = 4096
# The variables conditions are checked against when no schema is given.
SAMPLE_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("purchase_count", T.LongType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("view_count", T.LongType()),
    T.StructField("click_count", T.LongType()),
])
_INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_FLOAT_TEXT = (
    r"^\s*[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?\s*$"
)


@dataclass
class Wide:
    """A whole number where 64 bits do not hold it.

    ``big`` is exact and null beyond 38 digits; ``far`` is a double for what lies
    beyond, and null where rounding could have taken its meaning.
    """

    big: Column
    far: Column


class Undefined(Exception):
    """The expression can be told to fail before any row is seen."""


@dataclass
class Value:
    """One typed column.

    ``ok`` is null-free; None means always valid. A ``strict`` value is valid
    only where it is not null: arithmetic hands on the null of whatever failed,
    so a long formula needs a single check. ``items`` are the parts of a literal
    sequence or dict, ``literal`` the value of a constant. ``wide`` takes over
    where ``col`` is null because the number is beyond 64 bits.
    """

    kind: str
    col: Column | None = None
    ok: Column | None = None
    of: T.DataType | None = None
    items: list | None = None
    nullable: bool = False
    literal: object = None
    strict: bool = False
    wide: Wide | None = None

    def missing(self) -> Column:
        if self.kind == "none":
            return F.lit(True)
        return self.col.isNull() if self.nullable and self.col is not None else F.lit(False)


Alternatives = list[tuple[Column | None, Value]]


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.StringType):
        return "str"
    if isinstance(data_type, T.ArrayType):
        return "list"
    if isinstance(data_type, T.MapType):
        return "dict"
    if isinstance(data_type, T.StructType):
        return "struct"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time:" + data_type.simpleString()
    if isinstance(data_type, T.NullType):
        return "none"
    return "other:" + data_type.simpleString()


def _of_column(col: Column, data_type: T.DataType, ok: Column | None = None) -> Value:
    kind = _kind(data_type)
    if kind == "int":
        col = col.cast("bigint")
    elif kind == "float":
        col = col.cast("double")
    return Value(kind, col, ok, data_type, nullable=True)


def _both(*conditions: Column | None) -> Column | None:
    """All conditions; None stands for a condition that always holds."""
    out = None
    for c in conditions:
        out = c if out is None else (out if c is None else out & c)
    return out


def _held(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else condition


def _never() -> Value:
    return Value("none", F.lit(None), F.lit(False))


def _sure(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def _present(*values: Value) -> Column | None:
    """None of the values is None. Their own validity is added by the caller."""
    return _both(*[~v.missing() for v in values if v.nullable or v.kind == "none"])


def _constant(value: object) -> Value:
    if value is None:
        return Value("none", F.lit(None))
    if isinstance(value, bool):
        return Value("bool", F.lit(value))
    if isinstance(value, int):
        if -(2**63) <= value < 2**63:
            return Value("int", F.lit(value).cast("bigint"))
        big = F.lit(str(value) if abs(value) < WIDE_END else None).cast(WIDE)
        try:
            far = float(value)
        except OverflowError:
            far = float("inf") if value > 0 else float("-inf")
        return Value("int", F.lit(None).cast("bigint"), strict=True, wide=Wide(big, F.lit(far)))
    if isinstance(value, float):
        return Value("float", F.lit(value))
    if isinstance(value, str):
        return Value("str", F.lit(value))
    raise Undefined(f"unsupported constant: {value!r}")


def _as_int(v: Value) -> Column:
    return v.col.cast("bigint")


def _wide(v: Value) -> Wide:
    return v.wide or Wide(_as_int(v).cast(WIDE), _as_int(v).cast("double"))


def _as_float(v: Value) -> Column:
    if v.wide:
        # beyond the doubles Python fails
        far = F.when(F.abs(v.wide.far) != float("inf"), v.wide.far)
        return F.coalesce(v.col.cast("double"), v.wide.big.cast("double"), far)
    return v.col.cast("bigint").cast("double") if v.kind == "bool" else v.col.cast("double")


def _pair(a: Value, b: Value) -> tuple[str, Column, Column]:
    if "float" in (a.kind, b.kind):
        return "float", _as_float(a), _as_float(b)
    return "int", _as_int(a), _as_int(b)


def _compared(test: Callable[[Column, Column], Column], a: Value, b: Value) -> Column:
    """A comparison of two whole numbers by the narrowest form that holds both; null
    where only approximate forms do and they are too close to be told apart."""
    x, y = _wide(a), _wide(b)
    largest = F.greatest(F.abs(x.far), F.abs(y.far))
    apart = F.when(largest == float("inf"), x.far != y.far).otherwise(F.abs(x.far - y.far) > NEAR * largest)
    return F.coalesce(
        test(_as_int(a), _as_int(b)), test(x.big, y.big), F.when(apart, test(x.far, y.far))
    )


# --- truth, equality, order -------------------------------------------------

def _truth(v: Value) -> Column:
    if v.kind == "none":
        return F.lit(False)
    if v.items is not None:
        return F.lit(bool(v.items))
    if v.kind == "bool":
        return _sure(v.col)
    if v.wide:
        return _sure(F.coalesce(v.col != 0, v.wide.big != 0, v.wide.far != 0))
    if v.kind in ("int", "float"):
        return _sure(v.col != 0)
    if v.kind == "str":
        return _sure(F.length(v.col) > 0)
    if v.kind in SEQUENCES or v.kind == "dict":
        return _sure(F.size(v.col) > 0)
    if v.kind == "struct":
        return v.col.isNotNull() if v.of.fields else F.lit(False)
    return v.col.isNotNull()


def _not_nan(v: Value) -> Column:
    return ~F.isnan(v.col) if v.kind == "float" else F.lit(True)


def _elements(v: Value) -> list[Value] | None:
    return v.items if v.kind in SEQUENCES else None


def _equal(a: Value, b: Value) -> Value:
    ok = None
    both_none = a.missing() & b.missing()
    if (a.wide or b.wide) and {a.kind, b.kind} <= {"int", "bool"}:
        # None equals no number
        gone = a.missing() | b.missing()
        held = F.when(gone, F.lit(False)).otherwise(_compared(Column.__eq__, a, b))
        same, ok = _sure(held), held.isNotNull()
    elif a.kind in NUMBERS and b.kind in NUMBERS:
        _, x, y = _pair(a, b)
        same = _sure((x == y) & _not_nan(a) & _not_nan(b)) | both_none
    elif a.items is not None or b.items is not None:
        same, ok = _equal_parts(a, b)
    elif a.kind == b.kind and a.kind != "none":
        if a.kind == "dict":
            x, y = (F.sort_array(F.map_entries(v.col)) for v in (a, b))
            if a.of != b.of:
                raise Undefined("dicts of different types")
            same = x.eqNullSafe(y)
        elif a.kind in SEQUENCES and a.of != b.of:
            same = _equal_arrays(a, b) | both_none
        elif a.kind == "struct" and a.of != b.of:
            raise Undefined("records of different types")
        else:
            same = a.col.eqNullSafe(b.col)
    else:
        same = both_none
    return Value("bool", same, ok)


def _equal_arrays(a: Value, b: Value) -> Column:
    x_type, y_type = a.of.elementType, b.of.elementType
    if _kind(x_type) in NUMBERS and _kind(y_type) in NUMBERS:
        def numeric(v: Value) -> Column:
            if _kind(v.of.elementType) == "bool":
                return v.col.cast("array<int>").cast("array<double>")
            return v.col.cast("array<double>")
        return _sure(numeric(a) == numeric(b))
    return _sure((F.size(a.col) == 0) & (F.size(b.col) == 0))


def _equal_parts(a: Value, b: Value) -> tuple[Column, Column | None]:
    """Equality where at least one side is a literal sequence or dict."""
    if a.kind != b.kind:
        return a.missing() & b.missing(), None
    if a.items is None:
        a, b = b, a
    if a.kind == "dict":
        return _equal_dicts(a, b)
    if a.kind == "set":
        raise Undefined("comparison of set literals")
    if b.items is not None:
        if len(a.items) != len(b.items):
            return F.lit(False), None
        parts = [_equal(x, y) for x, y in zip(a.items, b.items)]
        size = None
    else:
        parts = [
            _equal(x, _of_column(F.get(b.col, i), b.of.elementType)) for i, x in enumerate(a.items)
        ]
        size = _sure(F.size(b.col) == len(a.items))
    return _held(_both(size, *[p.col for p in parts])), _both(*[p.ok for p in parts])


def _entry(box: Value, key: Value) -> Column:
    return F.get(F.filter(F.map_entries(box.col), lambda e: e["key"] == key.col), 0)


def _equal_dicts(a: Value, b: Value) -> tuple[Column, Column | None]:
    """A literal dict against another one or against a map column."""
    if b.items is None:
        parts = []
        for key, value in a.items:
            if key.kind != _kind(b.of.keyType):
                return F.lit(False), None
            entry = _entry(b, key)
            held = _equal(value, _of_column(entry["value"], b.of.valueType))
            parts.append(replace(held, col=_sure(entry.isNotNull() & held.col)))
        size = _sure(F.size(b.col) == len(a.items))
        return _held(_both(size, *[p.col for p in parts])), _both(*[p.ok for p in parts])
    other = {key.literal: value for key, value in b.items}
    if {key.literal for key, _ in a.items} != set(other):
        return F.lit(False), None
    parts = [_equal(value, other[key.literal]) for key, value in a.items]
    return _held(_both(*[p.col for p in parts])), _both(*[p.ok for p in parts])


_ORDER: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda x, y: x < y,
    ast.LtE: lambda x, y: x <= y,
    ast.Gt: lambda x, y: x > y,
    ast.GtE: lambda x, y: x >= y,
}


def _ordered(op: ast.cmpop, a: Value, b: Value) -> Value:
    test = _ORDER[type(op)]
    if (a.wide or b.wide) and {a.kind, b.kind} <= {"int", "bool"}:
        held = _compared(test, a, b)
        return Value("bool", _sure(held), _both(_present(a, b), held.isNotNull()))
    if a.kind in NUMBERS and b.kind in NUMBERS:
        _, x, y = _pair(a, b)
        held = test(x, y) & _not_nan(a) & _not_nan(b)
    elif a.kind == b.kind and a.items is None and b.items is None and (
        a.kind == "str" or a.kind.startswith("time:")
    ):
        held = test(a.col, b.col)
    elif a.kind == b.kind and a.kind in ("list", "tuple"):
        a, b = _materialised(a), _materialised(b)
        element = a.of.elementType
        if a.of != b.of or _kind(element) not in (*NUMBERS, "str"):
            raise Undefined("lists of different types cannot be ordered")
        whole = ~F.exists(a.col, lambda e: e.isNull()) & ~F.exists(b.col, lambda e: e.isNull())
        return Value("bool", _sure(test(a.col, b.col)), _both(_present(a, b), _sure(whole)))
    else:
        raise Undefined(f"'{a.kind}' and '{b.kind}' cannot be ordered")
    return Value("bool", _sure(held), _present(a, b))


def _contains(item: Value, box: Value) -> Value:
    if box.kind == "str":
        if item.kind != "str":
            raise Undefined("only text can be in text")
        return Value("bool", _sure(F.contains(box.col, item.col)), _present(item, box))
    if box.kind in SEQUENCES or (box.kind == "dict" and box.items is not None):
        if box.items is not None:
            members = [k for k, _ in box.items] if box.kind == "dict" else box.items
            hits = [_equal(item, m) for m in members]
            found = F.lit(False)
            for h in hits:
                found = found | h.col
            ok = _both(*[h.ok for h in hits])
            if box.kind != "list" and box.kind != "tuple" and item.kind in ("list", "dict", "set"):
                raise Undefined(f"unhashable type: {item.kind}")
            return Value("bool", found, ok)
        element = box.of.elementType

        def is_item(e: Column) -> Column:
            return _equal(item, _of_column(e, element)).col

        return Value("bool", _sure(F.exists(box.col, is_item)), _present(box))
    if box.kind == "dict":
        if item.kind in ("list", "dict", "set"):
            raise Undefined(f"unhashable type: {item.kind}")
        key_type = box.of.keyType
        keys = F.map_keys(box.col)
        found = _sure(F.exists(keys, lambda k: _equal(item, _of_column(k, key_type)).col))
        return Value("bool", found, _present(box))
    if box.kind == "struct":
        if item.kind != "str":
            return Value("bool", F.lit(False), _present(box))
        return Value("bool", _sure(item.col.isin(*box.of.fieldNames())), _present(box))
    raise Undefined(f"'{box.kind}' holds no members")


# --- arithmetic -------------------------------------------------------------

def _modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _arithmetic(op: ast.operator, a: Value, b: Value) -> Value:
    name = type(op)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return _numeric(name, a, b)
    if name is ast.Add and a.kind == b.kind == "str":
        return Value("str", F.concat(a.col, b.col), _present(a, b), T.StringType(), nullable=True)
    if name is ast.Add and a.kind == b.kind and a.kind in ("list", "tuple"):
        if a.items is not None and b.items is not None:
            return Value(a.kind, items=[*a.items, *b.items])
        x, y = _materialised(a), _materialised(b)
        if x.of != y.of:
            raise Undefined("lists of different types")
        return Value(a.kind, F.concat(x.col, y.col), _present(x, y), x.of, nullable=True)
    if name is ast.Mod and a.kind == "str":
        return _formatted(a, b)
    if name is ast.Mult:
        body, times = (a, b) if a.kind not in NUMBERS else (b, a)
        if body.kind in ("str", "list", "tuple") and times.kind in ("bool", "int"):
            return _repeated(_materialised(body), times)
    raise Undefined(f"unsupported operands: {a.kind}, {b.kind}")


def _repeated(body: Value, times: Value) -> Value:
    """Text or a list several times over; a result too long to hold is an error."""
    count = F.greatest(_as_int(times), F.lit(0).cast("bigint"))
    size = (F.length(body.col) if body.kind == "str" else F.size(body.col)).cast("double")
    fits = _sure(size * count.cast("double") <= REPEAT_LIMIT)
    # an empty body stays empty however often it is repeated
    often = F.when(fits, F.least(count, F.lit(REPEAT_LIMIT).cast("bigint")).cast("int")).otherwise(F.lit(0))
    often = F.when(size == 0, F.lit(1)).otherwise(often)
    col = F.repeat(body.col, often) if body.kind == "str" else F.flatten(F.array_repeat(body.col, often))
    return Value(body.kind, col, _both(_present(body, times), fits), body.of, nullable=True)


def _repeated_length(op: ast.operator, a: Value, b: Value) -> Value:
    """``len`` of a product; text or a list repeated need not exist for it."""
    body, times = (a, b) if a.kind not in NUMBERS else (b, a)
    if body.kind not in ("str", "list", "tuple") or times.kind not in ("bool", "int"):
        return _length(_arithmetic(op, a, b))
    count = Value("int", F.greatest(_as_int(times), F.lit(0).cast("bigint")))
    size = _length(body)
    return replace(_numeric(ast.Mult, size, count), ok=_both(_present(body, times), size.ok))


def _formatted(form: Value, given: Value) -> Value:
    """``%`` with a constant text on the left that holds ``%s``, ``%d`` and ``%%``."""
    if not isinstance(form.literal, str):
        raise Undefined("only a constant text is filled in")
    values = given.items if given.kind == "tuple" and given.items is not None else [given]
    parts = re.split(r"(%.?)", form.literal, flags=re.DOTALL)
    marks = [p for p in parts[1::2] if p != "%%"]
    if any(m not in ("%s", "%d") for m in marks) or len(marks) != len(values):
        raise Undefined("unsupported format")
    out, oks, left = [], [], list(values)
    for i, part in enumerate(parts):
        if i % 2 == 0 or part == "%%":
            out.append(F.lit("%" if i % 2 else part))
            continue
        v = left.pop(0)
        if part == "%d":
            if v.kind not in NUMBERS:
                raise Undefined("%d takes a number")
            v = _to_int(v)
            oks.append(v.ok)
        out.append(_text(v))
    return Value("str", F.concat(*out), _both(_present(form), *oks), T.StringType(), nullable=True)


def _quotient(number: Column, divisor: Column) -> Column:
    """The exact quotient of wide numbers where no rest is left.

    A division keeps 32 digits before the point, so by a small divisor it is done in
    two parts, the leading digits first.
    """
    half = F.lit(str(10**HALF_DIGITS)).cast(WIDE)
    low = number % half
    high = F.try_divide(F.try_subtract(number, low).cast(WIDE), half).cast(WIDE)
    over = high % divisor
    lead = F.try_divide(F.try_subtract(high, over).cast(WIDE), divisor).cast(WIDE)
    left = F.try_add(F.try_multiply(over, half).cast(WIDE), low).cast(WIDE)
    parts = F.try_add(
        F.try_multiply(lead, half).cast(WIDE), F.try_divide(left, divisor).cast(WIDE)
    ).cast(WIDE)
    return F.when(F.abs(divisor) < SMALL, parts).otherwise(F.try_divide(number, divisor).cast(WIDE))


def _beyond(name: type, a: Value, b: Value) -> Wide | None:
    """What an operation on whole numbers gives beyond 64 bits."""
    x, y = _wide(a), _wide(b)
    if name in (ast.Add, ast.Sub, ast.Mult):
        run = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[name]
        # a small sum of large approximate numbers would say nothing; a product keeps its digits
        nothing = F.lit(None).cast("double")
        far = F.nanvl(x.far * y.far, nothing) if name is ast.Mult else nothing
        return Wide(run(x.big, y.big).cast(WIDE), far)
    divisor = F.nullif(y.big, F.lit(0).cast(WIDE))
    rest = x.big % divisor
    off = (rest != 0) & ((rest < 0) != (divisor < 0))
    rest = F.when(off, F.try_add(rest, divisor)).otherwise(rest).cast(WIDE)
    if name is ast.Mod:
        return Wide(rest, F.lit(None).cast("double"))
    whole = _quotient(F.try_subtract(x.big, rest).cast(WIDE), divisor)
    share = x.far / F.nullif(y.far, F.lit(0.0))
    return Wide(whole, F.when(F.abs(share) >= 1 / NEAR, share))


def _whole_power(a: Value, times: int, power: Column) -> Value:
    """A whole number to a constant power that is not negative."""
    x = _wide(a)
    if times < 127:  # more than that takes any number but -1, 0 and 1 beyond 38 digits
        big = F.aggregate(
            F.array_repeat(F.lit(0), times), F.lit(1).cast(WIDE), lambda acc, _: F.try_multiply(acc, x.big).cast(WIDE)
        )
    else:
        big = F.lit(None).cast(WIDE)
    narrow = F.when(F.abs(power) <= EXACT_FLOAT, power.try_cast("bigint"))
    return Value("int", narrow, strict=True, wide=Wide(big, power))


def _numeric(name: type, a: Value, b: Value) -> Value:
    """Null where an operand is None or the operation fails; a whole number beyond
    64 bits goes on in its wide form."""
    kind, x, y = _pair(a, b)
    if kind == "int" and isinstance(a.literal, int) and isinstance(b.literal, int):
        if (known := _folded(name, int(a.literal), int(b.literal))) is not None:
            return replace(_constant(known), literal=known)
    if kind == "int" and name in (ast.Add, ast.Sub, ast.Mult, ast.FloorDiv, ast.Mod):
        return replace(_narrow(name, a, b), wide=_beyond(name, a, b))
    return _narrow(name, a, b)


def _folded(name: type, a: int, b: int) -> int | None:
    """The operation on two constants, where it is whole and not too long."""
    if name in (ast.Add, ast.Sub, ast.Mult):
        return {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}[name]
    if name is ast.Pow and b >= 0 and max(a.bit_length(), 1) * b <= FOLD_BITS:
        return a**b
    return None


def _narrow(name: type, a: Value, b: Value) -> Value:
    """The operation in 64 bits or as doubles."""
    kind, x, y = _pair(a, b)
    if name in (ast.Add, ast.Sub, ast.Mult):
        if kind == "int":
            run = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[name]
        else:
            run = {ast.Add: Column.__add__, ast.Sub: Column.__sub__, ast.Mult: Column.__mul__}[name]
        return Value(kind, run(x, y), strict=True)
    if name is ast.Div:
        return Value("float", _as_float(a) / F.nullif(_as_float(b), F.lit(0.0)), strict=True)
    if name in (ast.FloorDiv, ast.Mod):
        divisor = F.nullif(y, F.lit(0).cast("bigint") if kind == "int" else F.lit(0.0))
        rest = _modulo(x, divisor)
        if name is ast.Mod:
            return Value(kind, rest, strict=True)
        if kind == "int":
            whole = F.when(divisor == -1, F.try_subtract(F.lit(0).cast("bigint"), x)).otherwise(
                F.call_function("div", F.try_subtract(x, rest), divisor)
            )
            return Value("int", whole, strict=True)
        return Value("float", F.rint((x - rest) / divisor), strict=True)
    if name is ast.Pow:
        p, q = _as_float(a), _as_float(b)
        # 0 to a negative power fails; a root of a negative number is not real
        real = ~((p == 0) & (q < 0)) & ~((p < 0) & (q != F.rint(q)))
        power = F.when(real, F.pow(p, q))
        if kind == "int" and isinstance(b.literal, int) and b.literal >= 0:
            return _whole_power(a, int(b.literal), power)
        if kind == "float":
            power = F.when(F.abs(power) != float("inf"), power)
        return Value("float", power, strict=True)
    raise Undefined(f"unsupported operator: {name.__name__}")


def _negate(v: Value) -> Value:
    if v.kind not in NUMBERS:
        raise Undefined(f"bad operand for unary -: {v.kind}")
    if v.kind == "float":
        return Value("float", -v.col, strict=True)
    wide = Wide(F.try_subtract(F.lit(0).cast(WIDE), v.wide.big).cast(WIDE), -v.wide.far) if v.wide else None
    return Value("int", F.try_subtract(F.lit(0).cast("bigint"), _as_int(v)), strict=True, wide=wide)


def _settled(v: Value, wide: bool = False) -> Value:
    """The value with its null check spelled out; without ``wide`` a number beyond 64
    bits is an error, unless it is a constant."""
    if not v.strict:
        return v
    if v.wide and v.literal is not None:
        return replace(v, strict=False)
    if v.wide and wide:
        there = v.col.isNotNull() | v.wide.big.isNotNull() | v.wide.far.isNotNull()
        return replace(v, ok=_both(v.ok, there), strict=False)
    return replace(v, ok=_both(v.ok, v.col.isNotNull()), strict=False, wide=None)


# --- containers and functions -----------------------------------------------

def _materialised(v: Value) -> Value:
    """A literal sequence as an array column; its parts need one type."""
    if v.items is None:
        return v
    kinds = {i.kind for i in v.items} - {"none"}
    if not kinds:
        if v.items:
            raise Undefined("a list of only None")
        return Value(v.kind, F.array().cast("array<bigint>"), of=T.ArrayType(T.LongType()))
    if kinds <= set(NUMBERS):
        if kinds == {"bool"}:
            parts, element = [i.col for i in v.items], T.BooleanType()
        elif "float" in kinds or any(i.wide for i in v.items):
            parts, element = [_as_float(i) if i.kind in NUMBERS else i.col for i in v.items], T.DoubleType()
        else:
            parts, element = [_as_int(i) if i.kind in NUMBERS else i.col for i in v.items], T.LongType()
    elif kinds == {"str"}:
        parts, element = [i.col for i in v.items], T.StringType()
    else:
        raise Undefined("a list of mixed types")
    array_type = T.ArrayType(element)
    col = F.array(*[p.cast(element) for p in parts])
    return Value(v.kind, col, of=array_type)


def _pick(box: Value, key: Value) -> Alternatives:
    if box.kind in ("list", "tuple"):
        if key.kind not in ("int", "bool"):
            raise Undefined("positions are integers")
        at = _as_int(key)
        if box.items is not None:
            place = F.when(at < 0, at + len(box.items)).otherwise(at)
            if not box.items:
                raise Undefined("index out of range")
            return [(_sure(place == i), item) for i, item in enumerate(box.items)]
        size = F.size(box.col)
        place = F.when(at < 0, at + size).otherwise(at)
        ok = _both(_present(box, key), _sure((place >= 0) & (place < size)))
        return [(None, _of_column(F.get(box.col, F.when(ok, place.cast("int"))), box.of.elementType, ok))]
    if box.kind == "str":
        if key.kind not in ("int", "bool"):
            raise Undefined("positions are integers")
        at, size = _as_int(key), F.length(box.col)
        place = F.when(at < 0, at + size).otherwise(at)
        ok = _both(_present(box, key), _sure((place >= 0) & (place < size)))
        spot = F.when(ok, place.cast("int") + 1)
        return [(None, Value("str", F.substring(box.col, spot, F.lit(1)), ok, nullable=True))]
    if box.kind == "dict":
        if box.items is not None:
            chosen, taken = [], F.lit(False)
            for k, v in reversed(box.items):
                hit = _equal(key, k)
                guard = hit.col & ~taken
                chosen.append((guard, replace(v, ok=hit.ok)))
                taken = taken | hit.col
            if not chosen:
                raise Undefined("missing key")
            return chosen
        key_type = box.of.keyType
        entry = F.filter(
            F.map_entries(box.col), lambda e: _equal(key, _of_column(e["key"], key_type)).col
        )
        ok = _both(_present(box), _sure(F.size(entry) > 0))
        return [(None, _of_column(F.get(entry, 0)["value"], box.of.valueType, ok))]
    if box.kind == "struct" and key.literal is not None:
        return [(None, _field(box, key.literal))]
    raise Undefined(f"'{box.kind}' has no parts")


def _field(box: Value, name: object) -> Value:
    if box.kind != "struct" or name not in box.of.fieldNames():
        raise Undefined(f"no field {name!r}")
    return _of_column(box.col.getField(name), box.of[name].dataType, _present(box))


def _text(v: Value) -> Column:
    """``str()`` of a value."""
    if v.kind == "none":
        return F.lit("None")
    if v.kind == "str":
        shown = v.col
    elif v.kind == "bool":
        shown = F.when(v.col, F.lit("True")).otherwise(F.lit("False"))
    elif v.kind == "int":
        shown = F.coalesce(v.col.cast("string"), v.wide.big.cast("string")) if v.wide else v.col.cast("string")
    elif v.kind == "float":
        shown = _float_text(v.col)
    else:
        raise Undefined(f"str of {v.kind}")
    return F.when(v.missing(), F.lit("None")).otherwise(shown)


def _float_text(d: Column) -> Column:
    """Shortest decimal form: plain from 1e-4 up to 1e16, else with an exponent."""
    java = d.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^([^E]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    size = F.abs(d)
    return (
        F.when(F.isnan(d), F.lit("nan"))
        .when(size == float("inf"), F.when(d > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(size == 0, java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def _to_int(v: Value) -> Value:
    if v.wide:
        return replace(v, strict=True)
    if v.kind in ("bool", "int"):
        return Value("int", _as_int(v), _present(v), nullable=True)
    if v.kind == "float":
        cut = F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col)).cast("bigint")
        fits = _sure(F.abs(v.col) < F.lit(2.0**63)) & ~F.isnan(v.col)
        return Value("int", cut, _both(_present(v), fits), nullable=True)
    if v.kind == "str":
        digits = F.when(v.col.rlike(_INT_TEXT), F.regexp_replace(v.col, r"[_\s]", ""))
        number = digits.try_cast("bigint")
        return Value("int", number, _both(_present(v), number.isNotNull()), nullable=True)
    raise Undefined(f"int of {v.kind}")


_PREFIXES = {2: "0[bB]", 8: "0[oO]", 16: "0[xX]"}


def _in_base(value: int, base: int) -> list[int]:
    """The digits of a number, the last one first."""
    out = []
    while value:
        value, digit = divmod(value, base)
        out.append(digit)
    return out


def _to_int_of_base(v: Value, base: Value) -> Value:
    """``int`` of text in a base given as a constant."""
    n = base.literal
    if v.kind != "str" or not isinstance(n, int) or isinstance(n, bool) or not 2 <= n <= 36:
        raise Undefined("int takes text and a constant base from 2 to 36")
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:n]
    digit = f"[{digits}{digits[10:].upper()}]"
    prefix = f"({_PREFIXES[n]}_?)?" if n in _PREFIXES else ""
    form = rf"^\s*[+-]?{prefix}{digit}+(_{digit}+)*\s*$"
    bare = F.regexp_replace(F.regexp_replace(v.col, r"[_\s+-]", ""), f"^{_PREFIXES[n]}" if n in _PREFIXES else "^$", "")
    bare = F.regexp_replace(F.when(v.col.rlike(form), bare), "^0+", "")
    # in two parts, as a part beyond 64 bits would raise; longer texts are beyond them in any case
    longest, low = len(_in_base(2**63, n)), 6
    padded = F.concat(F.lit("0" * low), F.when(F.length(bare) <= longest, bare))

    def part(text: Column) -> Column:
        return F.coalesce(F.conv(text, n, 10), F.when(text.isNotNull(), F.lit("0"))).cast("decimal(20,0)")

    size = part(F.substring(padded, F.lit(1), F.length(padded) - low)) * F.lit(n**low).cast("decimal(10,0)") + part(F.right(padded, F.lit(low)))
    number = F.when(F.contains(v.col, F.lit("-")), -size).otherwise(size).try_cast("bigint")
    return Value("int", number, _both(_present(v), number.isNotNull()), nullable=True)


def _to_float(v: Value) -> Value:
    if v.kind in NUMBERS:
        number = _as_float(v)
        return Value("float", number, _both(_present(v), number.isNotNull() if v.wide else None), nullable=True)
    if v.kind == "str":
        bare = F.lower(F.regexp_replace(v.col, r"[_\s]", ""))
        number = F.when(v.col.rlike(_FLOAT_TEXT), bare.try_cast("double"))
        for pattern, value in (
            (r"^\s*[+]?(inf|infinity)\s*$", float("inf")),
            (r"^\s*-(inf|infinity)\s*$", float("-inf")),
            (r"^\s*[+-]?nan\s*$", float("nan")),
        ):
            number = F.when(F.lower(v.col).rlike(pattern), F.lit(value)).otherwise(number)
        return Value("float", number, _both(_present(v), number.isNotNull()), nullable=True)
    raise Undefined(f"float of {v.kind}")


def _length(v: Value) -> Value:
    if v.items is not None:
        return Value("int", F.lit(len(v.items)).cast("bigint"))
    if v.kind == "str":
        return Value("int", F.length(v.col).cast("bigint"), _present(v), nullable=True)
    if v.kind in SEQUENCES or v.kind == "dict":
        return Value("int", F.size(v.col).cast("bigint"), _present(v), nullable=True)
    if v.kind == "struct":
        return Value("int", F.lit(len(v.of.fields)).cast("bigint"), _present(v))
    raise Undefined(f"len of {v.kind}")


def _sequence(v: Value) -> Value:
    """What iterating gives, as a list."""
    if v.kind in SEQUENCES:
        return replace(v, kind="list", ok=None)
    if v.kind == "dict" and v.items is not None:
        return Value("list", items=[k for k, _ in v.items])
    if v.kind == "dict":
        return Value("list", F.map_keys(v.col), of=T.ArrayType(v.of.keyType), nullable=v.nullable)
    if v.kind == "str":
        chars = F.filter(F.split(v.col, ""), lambda c: c != "")
        return Value("list", chars, of=T.ArrayType(T.StringType()), nullable=v.nullable)
    if v.kind == "struct":
        names = [_constant(n) for n in v.of.fieldNames()]
        return Value("list", None, _present(v), items=names)
    raise Undefined(f"'{v.kind}' cannot be iterated")


def _extreme(values: list[Value], largest: bool) -> Value:
    if not values:
        raise Undefined("no values")
    if len(values) == 1:
        whole = _sequence(values[0])
        if whole.items is not None:
            if not whole.items:
                raise Undefined("empty sequence")
            if len(whole.items) == 1:
                return whole.items[0]
            return _extreme(whole.items, largest)
        if _kind(whole.of.elementType) not in (*NUMBERS, "str"):
            raise Undefined("elements cannot be ordered")
        gaps = F.exists(whole.col, lambda e: e.isNull())
        ok = _both(_present(whole), _sure((F.size(whole.col) > 0) & (~gaps | (F.size(whole.col) == 1))))
        best = (F.array_max if largest else F.array_min)(whole.col)
        return _of_column(best, whole.of.elementType, ok)
    pick = F.greatest if largest else F.least
    if all(v.kind in NUMBERS for v in values):
        kind = "float" if any(v.kind == "float" for v in values) else "int"
        parts = [_as_float(v) if kind == "float" else _as_int(v) for v in values]
        return Value(kind, pick(*parts), _present(*values), nullable=True)
    if all(v.kind == "str" for v in values):
        return Value("str", pick(*[v.col for v in values]), _present(*values), nullable=True)
    raise Undefined("values of different types cannot be ordered")


def _total(v: Value, start: Value) -> Value:
    whole = _sequence(v)
    if whole.items is not None:
        acc = start
        for item in whole.items:
            added = _arithmetic(ast.Add(), acc, item)
            acc = replace(added, ok=_both(acc.ok, added.ok))
        return acc
    element = _kind(whole.of.elementType)
    if element not in NUMBERS or start.kind not in NUMBERS:
        raise Undefined("only numbers are summed")
    gaps = F.exists(whole.col, lambda e: e.isNull())
    if element == "float" or start.kind == "float":
        parts = F.transform(whole.col, lambda e: e.cast("double"))
        col = F.aggregate(parts, _as_float(start), lambda a, e: a + e)
        return Value("float", col, _both(_present(whole, start), ~_sure(gaps)), nullable=True)
    parts = F.transform(whole.col, lambda e: e.cast("bigint"))
    col = F.aggregate(parts, _as_int(start), lambda a, e: F.try_add(a, e))
    return Value("int", col, _both(_present(whole, start), ~_sure(gaps), col.isNotNull()), nullable=True)


def _any_all(v: Value, every: bool) -> Value:
    whole = _sequence(v)
    if whole.items is not None:
        out = F.lit(every)
        for item in whole.items:
            out = (out & _truth(item)) if every else (out | _truth(item))
        return Value("bool", out, whole.ok)
    element = whole.of.elementType
    test = F.forall if every else F.exists
    return Value("bool", _sure(test(whole.col, lambda e: _truth(_of_column(e, element)))), _present(whole))


def _as_set(v: Value) -> Value:
    whole = _materialised(_sequence(v))
    return Value("set", F.array_distinct(whole.col), _present(whole), whole.of, nullable=whole.nullable)


def _call(name: str, args: list[Value]) -> Value:
    n = len(args)
    if name in ("list", "tuple", "set", "dict", "str", "bool", "int", "float") and n == 0:
        empty = {"str": "", "bool": False, "int": 0, "float": 0.0}
        return _constant(empty[name]) if name in empty else Value(name, items=[])
    if name in ("max", "min"):
        return _extreme(args, name == "max")
    if name == "sum" and n in (1, 2):
        return _total(args[0], args[1] if n == 2 else _constant(0))
    if name == "int" and n == 2:
        return _to_int_of_base(*args)
    if n != 1:
        raise Undefined(f"{name} takes one argument")
    (v,) = args
    if name == "len":
        return _length(v)
    if name == "str":
        return Value("str", _text(v), v.col.isNotNull() | v.wide.big.isNotNull() if v.wide else None, T.StringType())
    if name == "int":
        return _to_int(v)
    if name == "float":
        return _to_float(v)
    if name == "bool":
        return Value("bool", _truth(v))
    if name == "abs":
        if v.kind not in NUMBERS:
            raise Undefined(f"abs of {v.kind}")
        if v.kind == "float":
            return Value("float", F.abs(v.col), _present(v), nullable=True)
        size = F.when(_as_int(v) < 0, _negate(v).col).otherwise(_as_int(v))
        wide = Wide(F.abs(v.wide.big), F.abs(v.wide.far)) if v.wide else None
        return Value("int", size, strict=True, wide=wide)
    if name in ("any", "all"):
        return _any_all(v, name == "all")
    if name == "set":
        return _as_set(v)
    if name == "dict":
        if v.kind != "dict":
            raise Undefined(f"dict of {v.kind}")
        return replace(v, ok=None if v.items is not None else _present(v))
    if name in ("list", "tuple"):
        whole = _sequence(v)
        return replace(whole, kind=name, ok=_both(whole.ok, None if whole.items is not None else _present(whole)))
    raise Undefined(f"function {name!r} is not allowed")


# The functions a condition may call.
FUNCTIONS = (
    "len", "str", "int", "float", "bool", "abs", "max", "min", "sum",
    "any", "all", "list", "dict", "set", "tuple",
)


# those that take a whole number beyond 64 bits as it is
_WIDE_CALLS = ("str", "int", "float", "bool", "abs")


# --- expressions ------------------------------------------------------------

class Condition:
    """One expression compiled against the columns of a context table.

    ``matches`` is never null; ``valid`` is false where Python would raise;
    ``problem`` tells why a condition cannot hold, where that is known beforehand.
    """

    def __init__(self, text: str, schema: T.StructType, prefix: str | None = None):
        self.text = text
        self.problem: str | None = None
        self._types = {f.name: f.dataType for f in schema.fields}
        self._prefix = prefix
        try:
            body = ast.parse(text, mode="eval").body
            truth, valid = self._flag(self._any(body))
        except SyntaxError as error:
            self.problem = f"invalid syntax: {error.msg}"
            truth, valid = F.lit(False), F.lit(False)
        except Exception as error:  # noqa: BLE001 - whatever is wrong, the rule never matches
            self.problem = str(error) or type(error).__name__
            truth, valid = F.lit(False), F.lit(False)
        self.valid = _sure(_held(valid))
        self.matches = _sure(truth & self.valid)

    # every step gives alternatives: [(guard, value)]; the first true guard counts

    def _any(self, node: ast.expr) -> Alternatives:
        """A part that is bound to fail is a value that is never valid: it may lie
        in a branch that is not taken."""
        try:
            return self._value(node)
        except Undefined as error:
            self.problem = self.problem or str(error)
            return [(None, _never())]

    def _over(
        self, run: Callable[..., Value | Alternatives], *operands: Alternatives, passes_null: bool = False,
        wide: bool = False,
    ) -> Alternatives:
        """Applies ``run`` to every combination of alternatives; operands must be valid.

        With ``passes_null`` the result of ``run`` is null where an operand is; with
        ``wide`` it takes numbers beyond 64 bits.
        """
        combos: list[tuple[Column | None, list[Value]]] = [(None, [])]
        for alternatives in operands:
            combos = [
                (_both(guard, g), [*values, v]) for guard, values in combos for g, v in alternatives
            ]
        out: Alternatives = []
        for guard, values in combos:
            settled = [_settled(v, wide) for v in values]
            try:
                got = run(*(values if passes_null else settled))
            except Undefined as error:
                self.problem = self.problem or str(error)
                got = _never()
            absorbed = passes_null and isinstance(got, Value) and got.strict
            ok = _both(*[v.ok for v in (values if absorbed else settled)])
            for g, v in got if isinstance(got, list) else [(None, got)]:
                out.append((_both(guard, g), replace(v, ok=_both(ok, v.ok))))
        return _merged(out)

    def _flag(self, alternatives: Alternatives) -> tuple[Column, Column | None]:
        """Truth and validity of a value, whatever its type."""
        alternatives = [(g, _settled(v, wide=True)) for g, v in alternatives]
        if len(alternatives) == 1 and alternatives[0][0] is None:
            value = alternatives[0][1]
            return _truth(value), value.ok
        return _chosen([(g, _truth(v)) for g, v in alternatives], F.lit(False)), _chosen(
            [(g, _held(v.ok)) for g, v in alternatives], F.lit(False)
        )

    def _value(self, node: ast.expr) -> Alternatives:
        if isinstance(node, ast.Constant):
            return [(None, replace(_constant(node.value), literal=node.value))]
        if isinstance(node, ast.Name):
            if node.id not in self._types:
                raise Undefined(f"undefined variable: {node.id}")
            name = f"{self._prefix}.`{node.id}`" if self._prefix else f"`{node.id}`"
            return [(None, _of_column(F.col(name), self._types[node.id]))]
        if isinstance(node, ast.BinOp):
            return self._over(
                lambda a, b: _arithmetic(node.op, a, b), self._any(node.left), self._any(node.right),
                passes_null=True,
            )
        if isinstance(node, ast.UnaryOp):
            known = node.operand.value if isinstance(node.operand, ast.Constant) else None
            if isinstance(node.op, ast.USub) and type(known) is int:
                return [(None, replace(_constant(-known), literal=-known))]
            if isinstance(node.op, ast.Not):
                truth, valid = self._flag(self._any(node.operand))
                return [(None, Value("bool", ~truth, valid))]
            return self._over(lambda v: _signed(node.op, v), self._any(node.operand), passes_null=True)
        if isinstance(node, ast.Compare):
            return self._compare(node)
        if isinstance(node, ast.BoolOp):
            # all operands are looked at, so an error in any of them counts
            flags = [self._flag(self._any(v)) for v in node.values]
            truth = flags[0][0]
            for other, _ in flags[1:]:
                truth = (truth & other) if isinstance(node.op, ast.And) else (truth | other)
            return [(None, Value("bool", truth, _both(*[ok for _, ok in flags])))]
        if isinstance(node, ast.IfExp):
            test, valid = self._flag(self._any(node.test))
            return _merged([
                (_both(side, guard), replace(v, ok=_both(valid, v.ok), literal=None))
                for branch, side in ((node.body, test), (node.orelse, ~test))
                for guard, v in ((g, _settled(v)) for g, v in self._any(branch))
            ])
        if isinstance(node, (ast.List, ast.Tuple)):
            kind = "list" if isinstance(node, ast.List) else "tuple"
            return self._over(
                lambda *parts: Value(kind, items=[replace(p, ok=None) for p in parts]),
                *[self._any(e) for e in node.elts],
            )
        if isinstance(node, ast.Dict):
            if any(k is None for k in node.keys):
                raise Undefined("unsupported expression: **")
            n = len(node.keys)
            return self._over(
                lambda *parts: _dict_of([replace(p, ok=None) for p in parts], n),
                *[self._any(e) for e in [*node.keys, *node.values]],
            )
        if isinstance(node, ast.Subscript):
            return self._over(_pick, self._any(node.value), self._any(node.slice))
        if isinstance(node, ast.Attribute):
            if node.attr.startswith("_"):
                raise Undefined(f"attribute {node.attr!r} is not allowed")
            return self._over(lambda v: _field(v, node.attr), self._any(node.value))
        if isinstance(node, ast.Call):
            if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS:
                raise Undefined("function call is not allowed")
            name = node.func.id
            only = node.args[0] if len(node.args) == 1 else None
            if name == "len" and isinstance(only, ast.BinOp) and isinstance(only.op, ast.Mult):
                return self._over(
                    lambda a, b: _repeated_length(only.op, a, b), self._any(only.left), self._any(only.right)
                )
            return self._over(
                lambda *args: _call(name, list(args)), *[self._any(a) for a in node.args], wide=name in _WIDE_CALLS
            )
        raise Undefined(f"unsupported expression: {type(node).__name__}")

    def _compare(self, node: ast.Compare) -> Alternatives:
        """A chain stops at the first false pair; what follows is not looked at."""
        operands = [self._any(e) for e in [node.left, *node.comparators]]
        pairs = [
            self._flag(self._over(lambda a, b, op=op: _test(op, a, b), operands[i], operands[i + 1], wide=True))
            for i, op in enumerate(node.ops)
        ]
        truth, valid = pairs[-1]
        for held, ok in reversed(pairs[:-1]):
            truth, valid = held & truth, _both(ok, None if valid is None else ~held | valid)
        return [(None, Value("bool", truth, valid))]


def _chosen(cases: list[tuple[Column | None, Column]], other: Column) -> Column:
    out = other
    for guard, col in reversed(cases):
        out = col if guard is None else F.when(guard, col).otherwise(out)
    return out


def _merged(alternatives: Alternatives) -> Alternatives:
    """Alternatives of one plain type as a single value; others stay apart."""
    if len(alternatives) == 1:
        return alternatives
    alternatives = [(g, _settled(v)) for g, v in alternatives]
    kinds = {v.kind for _, v in alternatives} - {"none"}
    plain = all(v.items is None for _, v in alternatives)
    if len(kinds) == 1 and plain and (kind := kinds.pop()) in ("bool", "int", "float", "str"):
        null = F.lit(None)
        return [(None, Value(
            kind,
            _chosen([(g, null if v.kind == "none" else v.col) for g, v in alternatives], null),
            _chosen([(g, _held(v.ok)) for g, v in alternatives], F.lit(False)),
            nullable=True,
        ))]
    return alternatives if alternatives[-1][0] is None else [*alternatives, (None, _never())]


def _dict_of(parts: list[Value], n: int) -> Value:
    keys = parts[:n]
    if any(k.kind in ("list", "dict", "set") for k in keys):
        raise Undefined("unhashable key")
    if len({(k.kind, k.literal) for k in keys}) < n or any(k.literal is None for k in keys):
        raise Undefined("dict keys must be different constants")
    return Value("dict", items=list(zip(keys, parts[n:])))


def _signed(op: ast.unaryop, v: Value) -> Value:
    if isinstance(op, ast.USub):
        return _negate(v)
    if not isinstance(op, ast.UAdd) or v.kind not in NUMBERS:
        raise Undefined(f"unsupported operator: {type(op).__name__} on {v.kind}")
    return Value(v.kind, v.col, strict=True) if v.kind == "float" else Value("int", _as_int(v), strict=True, wide=v.wide)


def _test(op: ast.cmpop, a: Value, b: Value) -> Value:
    if isinstance(op, (ast.Eq, ast.NotEq)):
        same = _equal(a, b)
        return same if isinstance(op, ast.Eq) else Value("bool", ~same.col, same.ok)
    if type(op) in _ORDER:
        return _ordered(op, a, b)
    if isinstance(op, (ast.In, ast.NotIn)):
        found = _contains(a, b)
        return found if isinstance(op, ast.In) else Value("bool", ~found.col, found.ok)
    raise Undefined(f"unsupported comparison: {type(op).__name__}")


# --- structured conditions --------------------------------------------------

# Operators of a structured condition.
FIELD_OPERATORS = (">", ">=", "<", "<=", "==", "!=", "in", "not_in", "contains")


def field_condition(name: str, operator: str, value: object) -> str:
    """A field, an operator and a value as a condition text."""
    if operator not in FIELD_OPERATORS:
        raise ValueError(f"unsupported operator: {operator}")
    if operator == "contains":
        return f"{value!r} in {name}"
    return f"{name} {operator.replace('_', ' ')} {value!r}"

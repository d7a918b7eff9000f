"""Small value helpers: JSON properties, risk bands, readable trigger data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the risk bands.
RISK_BANDS = ((30, "LOW"), (70, "MEDIUM"))
RISK_TOP = "HIGH"
# How a missing product and missing trigger data are shown.
UNKNOWN_PRODUCT = "unknown"
NO_TRIGGER_DATA = "No trigger data available"
TRIGGER_HIDDEN_KEYS = ("ruleName", "ruleId")

_NUMBER_SCHEMAS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def json_number(json: Column, key: str, default: float = 0.0) -> Column:
    """A property that counts only if the JSON value is a number (or a boolean, as 0/1).

    Text such as ``"12.5"`` is not a number and gives the default.
    """
    node = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    kind = F.schema_of_variant(node)
    number = F.when(
        kind.rlike(_NUMBER_SCHEMAS) | (kind == "BOOLEAN"), F.try_variant_get(node, "$", "double")
    )
    return F.coalesce(number, F.lit(default))


def json_text(json: Column, key: str, default: str | None = None) -> Column:
    """A property as text; the default stands in where the key is absent."""
    value = F.get_json_object(json, f"$.{key}")
    return value if default is None else F.coalesce(value, F.lit(default))


def risk_level(score: Column) -> Column:
    bands = reduce(
        lambda acc, band: acc.when(score <= band[0], F.lit(band[1])),
        RISK_BANDS[1:],
        F.when(score <= RISK_BANDS[0][0], F.lit(RISK_BANDS[0][1])),
    )
    return bands.otherwise(F.when(score.isNotNull(), F.lit(RISK_TOP)))


def trigger_summary(json: Column) -> Column:
    """``key: value`` pairs in document order, without the rule's own name and id."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    shown = F.filter(pairs, lambda p: ~p["key"].isin(*TRIGGER_HIDDEN_KEYS))
    text = F.array_join(
        F.transform(
            shown, lambda p: F.concat(p["key"], F.lit(": "), F.coalesce(p["value"], F.lit("null")))
        ),
        ", ",
    )
    return F.when(F.length(text) > 0, text).otherwise(F.lit(NO_TRIGGER_DATA))


def ranked(value: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in an ordered list of names; unknown names rank lowest."""
    return F.array_position(F.array(*[F.lit(name) for name in order]), value)

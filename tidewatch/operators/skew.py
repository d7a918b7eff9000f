"""Keeping ordered per-key work spread out when one key holds much of the data.

A window over a whole key sorts that key in one task. The helpers here cut a
key's history into slices of time, sort within slices, and carry what crosses a
slice edge as small per-slice summaries:

* ``sliced`` copies a row into the later slices whose look-back reaches it;
* ``before`` totals what lies earlier, by a tree of blocks;
* ``carry_forward`` fills the latest value of a key across slices;
* ``prefix_states`` and ``ordered_states`` give the state of a finite automaton
  before each step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import floor_div
from tidewatch.session import ensure_checkpoint_dir

FAN = 256
LIGHT = 1024
BROADCAST_KEYS = 100_000


def sliced(rows: DataFrame, at: Column, slice_us: int, reach: Column | int = 0) -> DataFrame:
    """Adds ``_us``, ``_slice`` and ``_own``.

    A row at ``t`` also appears, with ``_own`` false, in every later slice that
    starts before ``t + reach``: a trailing window ``(u - reach, u]`` is then
    complete inside the slice of ``u``.
    """
    span = reach if isinstance(reach, Column) else F.lit(reach)
    rows = rows.withColumn("_us", at)
    home = floor_div(F.col("_us"), slice_us)
    last = floor_div(F.col("_us") + F.greatest(span.cast("bigint"), F.lit(1)) - 1, slice_us)
    return rows.withColumn("_slice", F.explode(F.sequence(home, last))).withColumn(
        "_own", F.col("_slice") == home
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null meets a null; the columns of ``on`` come once."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & left[c].eqNullSafe(renamed[f"_right_{c}"])
    return left.join(renamed, met, how).drop(*[f"_right_{c}" for c in on])


def before(
    rows: DataFrame, keys: list[str], index: str, value: str, into: str,
    fold: Callable[[str], Column] = F.max, levels: int = 2, fan: int = FAN,
) -> DataFrame:
    """``into``: ``fold`` (``max`` or ``sum``) of ``value`` over the key's rows of a smaller ``index``.

    ``index`` is unique within a key. It is cut into blocks of ``fan`` numbers, those into blocks of blocks:
    a window holds at most ``fan`` rows, except at the top, which holds ``range / fan**levels``. Null where
    nothing lies before; a key that is null is a key as any other.
    """
    if levels == 0:
        earlier = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(into, fold(value).over(earlier))
    block, total, carried = f"_block{levels}", f"_total{levels}", f"_carried{levels}"
    rows = rows.withColumn(block, floor_div(F.col(index), fan))
    blocks = rows.groupBy(*keys, block).agg(fold(value).alias(total))
    starts = before(blocks, keys, block, total, carried, fold, levels - 1, fan).drop(total)
    inside = Window.partitionBy(*keys, block).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(rows.withColumn(into, fold(value).over(inside)), starts, [*keys, block])
    here, carry = F.col(into), F.col(carried)
    both = F.greatest(here, carry) if fold is F.max else here + carry
    return joined.withColumn(into, F.coalesce(both, here, carry)).drop(block, carried)


def carry_forward(
    rows: DataFrame, keys: list[str], order: list[str], value: str, into: str
) -> DataFrame:
    """Latest non-null ``value`` of the key up to each row, for values that never decrease.

    ``rows`` carries ``_slice``. Only one row per key and slice crosses slices.
    """
    within = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy(*keys, "_slice")
        .agg(F.max(value).alias("_tail"))
        .withColumn("_carried", F.max("_tail").over(earlier))
        .drop("_tail")
    )
    return (
        rows.withColumn(into, F.max(value).over(within))
        .join(carried, [*keys, "_slice"])
        .withColumn(into, F.coalesce(into, "_carried"))
        .drop("_carried")
    )


def compose(acc: Column, step: Column) -> Column:
    """Next-state arrays composed: first ``acc``, then ``step``."""
    return F.transform(acc, lambda state: F.get(step, state))


def identity(n_states: int) -> Column:
    return F.array(*[F.lit(s) for s in range(n_states)])


def _scan(steps: Column, start: Column, carry: list[str]) -> Column:
    """``struct(i, state, carry...)`` for a sorted bounded array, ``state`` being the one before."""
    states = F.aggregate(
        steps,
        F.struct(start.cast("int").alias("state"), F.array().cast("array<int>").alias("out")),
        lambda acc, s: F.struct(
            F.get(s["fn"], acc["state"]).alias("state"),
            F.concat(acc["out"], F.array(acc["state"])).alias("out"),
        ),
    )["out"]
    return F.zip_with(
        steps, states,
        lambda s, state: F.struct(
            s["i"].alias("i"), state.alias("state"), *[s["row"][c].alias(c) for c in carry]
        ),
    )


def prefix_states(
    steps: DataFrame, keys: list[str], index: str, fn: str, n_states: int,
    start: int | DataFrame = 0, levels: int = 2, fan: int = FAN, carry: list[str] | None = None,
) -> DataFrame:
    """State before each step, as rows ``keys, index, state`` and the ``carry`` columns.

    Each step maps every state to the next one (``fn``, an ``array<int>``), is
    numbered by ``index`` (unique within the key) and steps apply in that order.
    Steps are folded in blocks of ``fan`` numbers, blocks of blocks, and so on:
    an array never holds more than ``fan`` steps, except at the top, which holds
    ``range / fan**levels``. The per-key work is thus spread over its blocks.
    ``start`` is one state for all keys or a DataFrame ``keys, _start``, joined at
    the top where a key has one row; keys it lacks have null states.
    """
    carry = carry or []
    row = [F.struct(*carry).alias("row")] if carry else []
    item = F.struct(F.col(index).cast("bigint").alias("i"), F.col(fn).alias("fn"), *row)
    if levels == 0:
        chains = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_steps"))
        if isinstance(start, DataFrame):
            chains = chains.join(start, keys, "left")
        else:
            chains = chains.withColumn("_start", F.lit(start))
        scanned = chains.select(*keys, F.inline(_scan(F.col("_steps"), F.col("_start"), carry)))
        return scanned.withColumnRenamed("i", index)

    blocks = (
        steps.groupBy(*keys, floor_div(F.col(index), fan).alias("_block"))
        .agg(F.sort_array(F.collect_list(item)).alias("_steps"))
    )
    folded = blocks.select(
        *keys,
        "_block",
        F.aggregate("_steps", identity(n_states), lambda acc, s: compose(acc, s["fn"])).alias("_fn"),
    )
    starts = prefix_states(folded, keys, "_block", "_fn", n_states, start, levels - 1, fan)
    return (
        blocks.join(starts, [*keys, "_block"])
        .select(*keys, F.inline(_scan(F.col("_steps"), F.col("state"), carry)))
        .withColumnRenamed("i", index)
    )


def ordered_states(
    steps: DataFrame, keys: list[str], index: str, fn: str, n_states: int,
    start: int | DataFrame = 0, carry: list[str] | None = None, light: int = LIGHT, fan: int = FAN,
) -> DataFrame:
    """``prefix_states`` with one array per key where that is short, blocks where it is not.

    Keys with more than ``light`` steps are looked for first; mostly there are none.
    """
    ensure_checkpoint_dir(steps.sparkSession)
    crowded = (
        steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > light)
        .select(*keys).checkpoint()
    )
    n_crowded = crowded.count()
    if n_crowded == 0:
        return prefix_states(steps, keys, index, fn, n_states, start, 0, fan, carry)
    if n_crowded <= BROADCAST_KEYS:
        # with so few keys the steps need not be shuffled to be told apart
        crowded = F.broadcast(crowded)
    few = steps.join(crowded, keys, "left_anti")
    many = steps.join(crowded, keys, "left_semi")
    return prefix_states(few, keys, index, fn, n_states, start, 0, fan, carry).unionByName(
        prefix_states(many, keys, index, fn, n_states, start, 2, fan, carry)
    )

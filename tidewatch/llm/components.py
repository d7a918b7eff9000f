"""Connected components of links, by repeated star contraction.

Links within a task are first contracted to stars with a union-find over what the
task holds. Then rounds of large stars (every node's larger neighbours are linked to
its smallest one) and small stars (the same for smaller neighbours) follow until the
links no longer change, each round cut off by a table in the shared folder. A round
is two shuffles of the links; their number falls to one per node, and rounds are
about the logarithm of the longest chain. No links or components reach the driver,
and no task holds a whole component: neighbours are joined to their group's smallest
node, which Spark can split, not gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import drop_stored, shared_folder

ROUNDS_AT_MOST = 60
#: Links contracted together in a task.
PART = 500_000


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent[b] = a
            self.parent.setdefault(a, a)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars(union: Union) -> pa.RecordBatch:
        pairs = [(union.find(x), x) for x in list(union.parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    union = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            union.join(a, b)
        if len(union.parent) > PART:
            yield stars(union)
            union = Union()
    yield stars(union)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of every node's larger (or smaller) neighbours to the smallest of itself and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # small stars look from the larger end only
    seen = both if large else links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("m").alias("u"), "v")
    else:
        out = joined.select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is linked with) of every node that has links, but roots.

    The first two columns of ``links`` are the nodes, as longs. Null ends, loops and repeated
    links count for nothing; without links there are no rows.
    """
    a, b = links.columns[:2]
    plain = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    spark = links.sparkSession
    folder = shared_folder(spark, "links")

    def put(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        df.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        return df, tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first())

    current, state = put(plain.mapInArrow(_contract, "u long, v long"), "start")
    for i in range(ROUNDS_AT_MOST):
        after, now = put(_star(_star(current, True), False), f"round-{i}")
        if i:
            drop_stored(spark, f"{folder}/round-{i - 1}")
        current = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links still change after {ROUNDS_AT_MOST} rounds")
    return current.select(F.col("v").alias("node"), F.col("u").alias("root"))

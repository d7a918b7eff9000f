"""Shards that each hold the corpus' mixture of sources: proportional stratified interleaving.

Rows are shuffled within their source by a seeded digest and ranked there. Rank over
size, less a fraction of its own for each source, places a source's rows evenly in (0, 1);
all rows sorted by that place interleave the sources in proportion, and equal cuts of
the sorted rows are the shards. So shards differ by one row at most, and a source's
share of a shard by a row or two from its share of the corpus.

No rank is counted over a whole source: digests, and places after them, fall into ranges
of about equal rows, a range is ranked by itself, and the rows of earlier ranges are added from a table of
counts. The number of ranges follows the rows; it changes no result. A source of any
size, a third of all rows too, is thus ranked by many tasks. Everything is a DataFrame expression.

Null and empty texts are rows like others (size of the row alone). Rows without a source are one source; rows
without an id are shuffled by their text. Repeated rows are each placed; equal rows are interchangeable. An empty
table gives no rows. Columns named like a new one give way to it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import col, drop_stored, shared_folder, unused

LAW = "rows"
#: Bytes of a row besides its text.
ROW_BYTES = 8
#: Ranges are made for so many rows each, but not fewer than the second number.
RANGE_ROWS, LEAST_RANGES = 1_000_000, 1024
#: Bits of a digest that are used.
DIGEST_BITS = 60
NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def digest_number(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts (null ones left out), joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def _ranges(rows: int) -> int:
    """Bits that number the ranges."""
    return (max(LEAST_RANGES, -(-rows // RANGE_ROWS)) - 1).bit_length()


def assign(
    docs: DataFrame, shards: int = 24, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    keep: Iterable[str] | None = None, folder: str | None = None,
) -> DataFrame:
    """The kept columns (all by default) with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Read rows are written to ``folder``, a new one below the checkpoint folder by default, which must
    stay until the result has been read.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "shard-rows")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NEW]
    taken = [*kept, *NEW]
    stratum, drawn, tie, rank, place, at, before, total, found = (
        unused(taken, n) for n in ("stratum", "drawn", "tie", "rank_in", "place", "range_at", "before", "total", "found")
    )
    raw = F.coalesce(col(text), F.lit("")).cast("binary")
    docs.select(
        *[col(c) for c in kept],
        (F.length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(col(source).isNull(), "").otherwise(F.concat(F.lit("="), col(source).cast("string"))).alias(stratum),
        digest_number(F.lit(str(seed)), col(doc_id).cast("string"), F.md5(raw)).alias(drawn),
        F.xxhash64(*[col(c) for c in kept], raw).alias(tie),
    ).write.parquet(folder)
    rows = spark.read.parquet(folder)
    n = rows.count()
    bits = _ranges(n)

    # ranks within the sources
    rows = rows.withColumn(at, F.shiftright(drawn, DIGEST_BITS - bits).cast("int"))
    source_rows = Window.partitionBy(stratum)
    counts = rows.groupBy(stratum, at).agg(F.count("*").alias(found)).select(
        stratum, at, F.sum(found).over(source_rows).alias(total),
        (F.sum(found).over(source_rows.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col(found)).alias(before),
    )
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(stratum, at).orderBy(drawn, tie)))
    # each source starts at a fraction of its own, so that small sources do not meet in one place
    start = digest_number(F.lit(str(seed)), F.col(stratum)) / F.lit(float(1 << DIGEST_BITS))
    rows = rows.join(counts, [stratum, at]).withColumn(place, (F.col(before) + F.col(rank) - start) / F.col(total))
    rows = rows.drop(at, rank, before, total)

    # positions among all rows
    most = 1 << bits
    rows = rows.withColumn(at, F.least(F.floor(F.col(place) * most), F.lit(most - 1)).cast("int"))
    # as many rows as there are ranges
    counts = rows.groupBy(at).agg(F.count("*").alias(found)).select(
        at, (F.sum(found).over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col(found)).alias(before)
    )
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(at).orderBy(place, stratum, drawn, tie))).join(counts, at)
    position = F.col(before) + F.col(rank) - 1
    shard = F.expr(f"(`{before}` + `{rank}` - 1) * {shards} div {max(n, 1)}")
    # a shard begins with the first position that falls into it
    first = F.expr(f"((`{before}` + `{rank}` - 1) * {shards} div {max(n, 1)} * {n} + {shards - 1}) div {shards}")
    return rows.select(
        *[col(c) for c in kept], "size", "text_crc32", F.lit(LAW).alias("law"), shard.cast("int").alias("shard"),
        (position - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 24, seed: int = 0, files: int = 1, **names: str) -> None:
    """The documents, all columns, in folders ``shard=0`` and so on, each of about ``files`` files in the order of ``slot``."""
    spark = docs.sparkSession
    between = shared_folder(spark, "shard-rows")
    placed = assign(docs, shards, seed, folder=between, **names)
    (
        placed.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(folder)
    )
    drop_stored(spark, between)

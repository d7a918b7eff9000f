"""A table with one row per user that is changed in place: upserts, deletion, look-ups.

Rows are filed by a hash of the user into a fixed number of folders. A change reads
and replaces the folders its users fall into and no others; a look-up opens one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import ensure_checkpoint_dir

BUCKET = "user_bucket"


@dataclass
class UserTable:
    """Such a table at ``path``, with the columns ``schema``, ``user_id`` and ``update_time`` among them.

    ``buckets``, the number of folders, is fixed when the table is made: enough that
    the rows of one folder suit one task. There is one writer at a time. Folders are
    replaced when a write has ended, so a task can be repeated; what was read before
    from a replaced folder has to be read anew.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    buckets: int

    def _bucket(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _filed(self) -> DataFrame:
        fields = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not self._exists():
            return self.spark.createDataFrame([], fields)
        # a folder without users holds a row without a user, or it could not be replaced
        return self.spark.read.schema(fields).parquet(self.path).filter("user_id is not null")

    def read(self) -> DataFrame:
        return self._filed().drop(BUCKET)

    def of(self, user_id: str) -> DataFrame:
        """The row of one user, from the one folder that may have it."""
        return self._filed().filter(
            (F.col(BUCKET) == self._bucket(F.lit(user_id))) & (F.col("user_id") == user_id)
        ).drop(BUCKET)

    def _changed(self, changes: DataFrame) -> tuple[DataFrame, list[int]]:
        """Changes filed by user, fixed for the passes to come, and the folders they touch."""
        ensure_checkpoint_dir(self.spark)
        filed = changes.withColumn(BUCKET, self._bucket(F.col("user_id"))).checkpoint()
        # as many numbers as there are folders, at most
        return filed, [r[0] for r in filed.select(BUCKET).distinct().collect()]

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        if not touched:
            return
        blanks = self.spark.range(self.buckets).filter(F.col("id").isin(touched)).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields],
            F.col("id").cast("int").alias(BUCKET),
        )
        (
            rows.select(*self.schema.fieldNames(), BUCKET).unionByName(blanks)
            .repartition(BUCKET).sortWithinPartitions(BUCKET, "user_id")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        )

    def upsert(self, updates: DataFrame) -> None:
        """Puts in users and replaces those known, unless the stored row is newer.

        Of several updates of a user the latest counts, of two at one time the one
        with the larger values, and at one time an update counts before what is
        stored. Updates without a user are ignored.
        """
        bare = [c for c in self.schema.fieldNames() if c not in ("user_id", "update_time")]
        named = updates.filter("user_id is not null").select(*self.schema.fieldNames())
        fresh, touched = self._changed(named)
        known = self._filed().filter(F.col(BUCKET).isin(touched)).withColumn("_fresh", F.lit(False))
        both = known.unionByName(fresh.withColumn("_fresh", F.lit(True)))
        newest = F.max(F.struct("update_time", "_fresh", *bare)).alias("_row")
        rows = both.groupBy("user_id", BUCKET).agg(newest).select("user_id", BUCKET, "_row.*")
        self._replace(rows, touched)

    def delete(self, users: DataFrame) -> None:
        """Takes out users; those the table does not have are ignored."""
        gone, touched = self._changed(users.filter("user_id is not null").select("user_id").distinct())
        kept = self._filed().filter(F.col(BUCKET).isin(touched)).join(gone, ["user_id", BUCKET], "left_anti")
        self._replace(kept, touched)

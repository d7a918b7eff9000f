"""The table changed in place against a dict, and what a change and a look-up touch."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import types as T

from tidewatch.operators.user_table import BUCKET, UserTable

T0 = datetime(2024, 1, 1)
SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("update_time", T.TimestampType()),
])


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_changes_equal_a_dict(spark, tmp_path):
    rnd = random.Random(3)
    table, model = UserTable(spark, str(tmp_path / "t"), SCHEMA, 5), {}
    for step in range(4):
        updates = [
            (rnd.choice([None, "", *"abcdefghij"]), rnd.randint(0, 9), T0 + timedelta(hours=rnd.randint(0, 5) + step))
            for _ in range(20)
        ]
        table.upsert(spark.createDataFrame(updates, SCHEMA))
        best = {}
        for user, n, at in updates:
            if user is not None:
                best[user] = max(best.get(user, (at, n)), (at, n))
        for user, (at, n) in best.items():
            if user not in model or at >= model[user][0]:
                model[user] = (at, n)
        gone = rnd.sample(list("abcdefghijz"), 3)
        table.delete(spark.createDataFrame([(u,) for u in [*gone, None, gone[0]]], "user_id string"))
        model = {u: v for u, v in model.items() if u not in gone}
        assert rows_of(table) == sorted((u, n, at) for u, (at, n) in model.items())


def test_empty_and_emptied(spark, tmp_path):
    table = UserTable(spark, str(tmp_path / "t"), SCHEMA, 3)
    nobody = spark.createDataFrame([], SCHEMA)
    assert rows_of(table) == [] and table.of("a").count() == 0
    table.upsert(nobody)
    table.delete(nobody)
    assert rows_of(table) == []
    table.upsert(spark.createDataFrame([("a", 1, T0)], SCHEMA))
    table.delete(spark.createDataFrame([("a",)], "user_id string"))
    assert rows_of(table) == []


def test_only_touched_folders_are_replaced(spark, tmp_path):
    path = tmp_path / "t"
    table = UserTable(spark, str(path), SCHEMA, 8)
    table.upsert(spark.createDataFrame([(f"u{i}", i, T0) for i in range(100)], SCHEMA))

    def files():
        return {f.parent.name: f.name for f in path.glob(f"{BUCKET}=*/*.parquet")}

    before = files()
    table.upsert(spark.createDataFrame([("u7", -1, T0 + timedelta(hours=1))], SCHEMA))
    after = files()
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1
    assert [r["n"] for r in table.of("u7").collect()] == [-1]
    assert table.read().count() == 100


def test_look_up_opens_one_folder(spark, tmp_path, capsys):
    table = UserTable(spark, str(tmp_path / "t"), SCHEMA, 8)
    table.upsert(spark.createDataFrame([(f"u{i}", i, T0) for i in range(50)], SCHEMA))
    found = table.of("u7")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(user_bucket" in plan and "EqualTo(user_id,u7)" in plan
    with pytest.raises(Exception, match="update_time"):
        table.upsert(spark.createDataFrame([("a", 1)], "user_id string, n long"))

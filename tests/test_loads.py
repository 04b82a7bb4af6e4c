"""Stored tables: resumable loads, corrections by folder, layouts by key."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrace.operators import joins
from terrace.sources import tables

SCHEMA = "k int, part string, v int"


def rows(df):
    return sorted(df.collect(), key=str)


def test_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(2, "a", 1), (None, "a", 1)], SCHEMA)
    new = spark.createDataFrame([(1, "b", 5), (1, "b", 3), (None, "c", 4), (2, "d", 1), (1, "b", 3)], SCHEMA)
    assert rows(tables.append_new(new, old, ["k"])) == sorted([(1, "b", 5), (1, "b", 3), (1, "b", 3)])
    assert rows(tables.append_new(new, old, ["k"], one=True)) == [(1, "b", 3)]
    assert rows(tables.append_new(new, old.limit(0), ["k", "part", "v"], one=True)) == [(1, "b", 3), (1, "b", 5), (2, "d", 1), (None, "c", 4)]


def test_a_killed_and_repeated_load_equals_one_load(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/loads"
    one = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "n", 3)], SCHEMA)
    two = spark.createDataFrame([(1, "a", 9), (2, "b", 4), (None, "n", 9)], SCHEMA)
    want = [(1, "a", 1), (2, "b", 4), (None, "n", 3)]
    assert tables.read_loads(spark, path, one.schema).count() == 0
    real = tables.loads

    def killed(*x):
        raise KeyboardInterrupt

    # Killed while its rows are written, and once more before its mark.
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, p: (write(self, p), killed()))
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            tables.load_batch(one, path, ["k"], "first")
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert len(os.listdir(f"{path}/rows")) == 2 and tables.read_loads(spark, path, one.schema).count() == 0
    assert [tables.load_batch(one, path, ["k"], "first"), tables.load_batch(one, path, ["k"], "first")] == [True, False]
    assert [tables.load_batch(two, path, ["k"], "second"), tables.load_batch(two, path, ["k"], "second")] == [True, False]
    assert rows(tables.read_loads(spark, path, one.schema)) == want
    # Two loads of one batch side by side: both wrote, one counts.
    monkeypatch.setattr(tables, "loads", lambda *x: {})
    assert tables.load_batch(two, f"{tmp_path}/race", ["k"], "b") and tables.load_batch(two, f"{tmp_path}/race", ["k"], "b")
    monkeypatch.setattr(tables, "loads", real)
    assert tables.read_loads(spark, f"{tmp_path}/race", one.schema).count() == 3


def files(path):
    return {f"{d[len(path):]}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_corrections_rewrite_touched_folders_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    df = spark.createDataFrame([(i, f"s{i % 4}" if i % 4 else None, i) for i in range(40)], SCHEMA)
    df.write.partitionBy("part").parquet(path)
    before = files(path)
    # One true change, one to the value that is there, one null, one unknown key.
    fixes = spark.createDataFrame([(5, -1), (6, 6), (7, None), (99, 1)], "k int, v int")
    want = joins.apply_corrections(df, fixes, ["k"], ["v"])
    assert joins.correct_partitions(spark, path, fixes, ["k"], ["v"], "part") == ["s1"]
    assert rows(spark.read.parquet(path).select("k", "part", "v")) == rows(want)
    after = files(path)
    assert {f for f in before if "s1" not in f} == {f for f in after if "s1" not in f} and not {f for f in before & after if "s1" in f}
    assert joins.correct_partitions(spark, path, fixes, ["k"], ["v"], "part") == [] and files(path) == after
    assert joins.correct_partitions(spark, path, spark.createDataFrame([(8, -8)], "k int, v int"), ["k"], ["v"], "part") == [None]
    assert spark.read.parquet(path).filter("k = 8").first().v == -8
    with pytest.raises(ValueError):
        joins.correct_partitions(spark, path, fixes, ["k"], ["part"], "part")


def test_layout_by_key_needs_no_exchange(spark, tmp_path):
    a = spark.range(500).select((F.col("id") % 50).alias("k"), "id")
    left = tables.write_buckets(a, "layout_left", f"{tmp_path}/l", ["k"], 4)
    right = tables.write_buckets(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")), "layout_right", f"{tmp_path}/r", ["k"], 4)
    try:
        out = left.join(right.hint("merge"), "k").withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
        total = out.groupBy("k").agg(F.sum("n").alias("n"), F.max("w").alias("w"))
        plan = total._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows(total) == sorted([(k, 55, 2 * k) for k in range(50)], key=str)
    finally:
        spark.sql("DROP TABLE layout_left")
        spark.sql("DROP TABLE layout_right")


def test_the_season_job_exchanges_no_facts(spark, tmp_path):
    """Grouping, features, injuries, role and the season before, over facts in buckets."""
    from terrace.plans import q_jobs

    rows = spark.range(400).selectExpr("id % 20 as player", "id as o_orderkey", "cast(id as double) as o_totalprice", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority", "timestampadd(DAY, cast(id * 5 as int), timestamp'1995-01-01') as o_orderdate")
    stored = tables.write_buckets(rows, "season_facts", f"{tmp_path}/f", ["player"], 4)
    try:
        out = q_jobs.season_rows(stored)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 20 * 5
    finally:
        spark.sql("DROP TABLE season_facts")

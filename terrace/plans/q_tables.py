"""Reading and writing (S) as round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from terrace.operators.rounds import shared_path
from terrace.plans.bindings import SIDES_SQL, sides, t
from terrace.plans.registry import query
from terrace.sources import tables


@query(
    "s1_read_table",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey % 3 = 0 AS flag FROM orders",
)
def s1(spark, d):
    # Cells as a source might hold them: words among the numbers, gaps, a time behind the date.
    k = F.col("o_orderkey")
    raw = t(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 7 > 0, F.col("o_custkey").cast("string")).otherwise("n/a").alias("o_custkey"),
        F.when(k % 5 > 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("o_totalprice"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 18:30:00")).alias("o_orderdate"),
        F.when(k % 3 == 0, "True").otherwise("False").alias("flag"),
    )
    path = shared_path(spark, "orders-csv")
    raw.write.csv(path, header=True)
    return tables.read_table(spark, path, _parse_datatype_string("o_orderkey string, o_custkey bigint, o_totalprice double, o_orderdate date, flag boolean"))


@query("s3_read_optional", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, CAST(NULL AS DOUBLE) AS bonus FROM customer")
def s3(spark, d):
    path = shared_path(spark, "customer-csv")
    t(spark, d, "customer").select("c_custkey", "c_mktsegment").write.csv(path, header=True)
    there = tables.read_optional(spark, path, _parse_datatype_string("c_custkey string, c_mktsegment string"))
    absent = tables.read_optional(spark, f"{path}-absent", _parse_datatype_string("c_custkey string, bonus double"))
    return tables.union_seasons([there, absent])


@query(
    "s4_load_batches",
    "SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 1000000 END) AS price FROM orders GROUP BY o_custkey",
)
def s4_loads(spark, d):
    """Customers with a finished order come in the first batch, those that remain in the second; one load is killed before
    its mark, two are repeated."""
    path = shared_path(spark, "loads")
    o = t(spark, d, "orders")
    first = o.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_totalprice").alias("price"))
    second = o.select("o_custkey", (F.col("o_totalprice") + 1000000).alias("price"))
    first.write.parquet(f"{path}/rows/killed")
    for rows, batch in ((first, "1"), (first, "1"), (second, "2"), (second, "2")):
        tables.load_batch(rows, path, ["o_custkey"], batch)
    return tables.read_loads(spark, path, first.schema)


@query("s5_write_features", f"WITH {SIDES_SQL} SELECT match_id, season, team, CAST(points AS INTEGER) AS points FROM sides")
def s5(spark, d):
    path = shared_path(spark, "features")
    tables.write_features(sides(spark, d).select("match_id", "season", "team", F.col("points").cast("int").alias("points")), path, ["season"])
    return spark.read.parquet(path)


@query(
    "s5_buckets",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def s5_buckets(spark, d):
    """Orders and customers laid out by customer: the window and the join read their buckets, without an exchange."""
    name = uuid.uuid4().hex
    store = lambda df, what: tables.write_buckets(df, f"{what}_{name}", shared_path(spark, what), ["o_custkey"], 8)
    orders = store(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "orders")
    people = store(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "people")
    return bucketed_rows(orders, people)


def bucketed_rows(orders, people):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.join(people.hint("merge"), "o_custkey", "left").select("o_custkey", "o_orderkey", k.cast("bigint").alias("k"), "c_mktsegment")

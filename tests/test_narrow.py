"""Rows that can't be chosen are not carried along whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake import queries
from basketlake.operators.latest import latest_products


def test_only_lines_of_the_last_orders_are_joined_whole(spark):
    plan = queries.QUERIES["last_of_each_chain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_only_lines_of_an_items_newest_day_are_put_in_order(spark, tmp_path):
    """With days that are null, too, they give the same products as all lines."""
    plan = queries.QUERIES["latest_products"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    lines, at = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), str(tmp_path)
    lines.withColumn("l_shipdate", F.when(F.col("l_partkey") % 3 > 0, F.col("l_shipdate"))).unionByName(lines.where("l_partkey % 3 = 0")).write.parquet(f"{at}/lineitem.parquet")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").write.parquet(f"{at}/part.parquet")
    few = queries.newest_observations(spark, at)
    assert few.count() < lines.count()
    got, expected = (latest_products(obs).collect() for obs in (few, queries.observations(spark, at)))
    assert sorted(map(str, got)) == sorted(map(str, expected))

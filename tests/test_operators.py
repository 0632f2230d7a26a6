from __future__ import annotations

import datetime

import pytest
from pyspark.errors import PySparkException

from basketlake.operators import quality
from basketlake.operators.coerce import cast_to_table
from basketlake.operators.latest import last_written, latest_daily_snapshots
from basketlake.operators.upsert import merge_batch, upsert


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_latest_day_then_latest_time_per_store(spark):
    given = [("1", "20260721", "090000", 0, "before"), ("1", "20260722", "010000", 1, "early"), ("1", "20260722", "020000", 2, "late"), ("1", "20260722", "020000", 3, "tie"), ("2", "20260722", "000000", 4, "second"), ("3", "20260721", "230000", 5, "gone")]
    df = spark.createDataFrame(given, "store_id string, date string, time string, position long, payload string")
    assert [r["payload"] for r in latest_daily_snapshots(df).collect()] == ["late", "second"]
    assert [r["payload"] for r in latest_daily_snapshots(df, max_files=1).collect()] == ["late"]
    assert latest_daily_snapshots(df.limit(0)).count() == 0


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(upsert(old, new, ["k"], "ignore")) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(upsert(upsert(old, new, ["k"]), new, ["k"])) == rows(upsert(old, new, ["k"]))
    with pytest.raises(ValueError):
        upsert(old, new, ["k"], "delete")


def test_last_written_counts_and_keyless_rows_go(spark):
    columns = "chain_id long, store_id int, store_name string, source_file string, position long"
    batch = spark.createDataFrame([(1, 1, "a", "f1", 9), (1, 1, "b", "f2", 1), (1, 1, "c", "f2", 2), (None, 1, "d", "f3", 1)], columns)
    assert [r["store_name"] for r in last_written(batch.where("chain_id is not null"), ["chain_id", "store_id"], ["source_file", "position"]).collect()] == ["c"]
    assert [r["store_name"] for r in merge_batch(batch.limit(0), batch, "stores", ["source_file", "position"]).collect()] == ["c"]


def test_cast_modes(spark):
    raw = spark.createDataFrame([("001", "7.905", "on"), ("x", "1", "0"), (None, "", "1")], "item_code string, price string, flag string")
    kinds = {"item_code": "bigint", "price": "decimal(10,2)", "flag": "boolean"}
    good, bad = cast_to_table(raw, kinds, "quarantine")
    assert [(r[0], str(r[1]), r[2]) for r in good.collect()] == [(1, "7.91", True)]
    assert rows(bad.select("item_code", "bad_columns")) == [("x", ["item_code"]), (None, ["price"])]
    with pytest.raises(PySparkException):
        cast_to_table(raw, kinds)[0].collect()
    assert cast_to_table(raw.limit(1), kinds)[0].count() == 1


def test_checks_raise_with_counts(spark):
    day = datetime.date(2026, 7, 22)
    staging = spark.createDataFrame([(1, 1, day, 2), (None, 1, day, 2), (3, 1, day, None)], "item_code long, store_id int, extraction_date date, item_price int")
    with pytest.raises(ValueError, match="2 staged rows"):
        quality.validate_staging(staging)
    quality.validate_staging(staging.limit(1))
    products = spark.createDataFrame([(1,)], "item_code long")
    with pytest.raises(ValueError, match="2 prices"):
        quality.validate_product_prices(staging, products)
    quality.validate_product_prices(staging.limit(1), products)

"""A load in quarantine mode casts its rows once, however many of its steps read them; words aren't cast to numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions import text
from basketlake.plans import jobs
from test_feeds import ITEM, PRICE, landed, pack, tables  # noqa: F401  fixtures


def test_rows_are_cast_once(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    rows = jobs.documents.price_rows
    monkeypatch.setattr(jobs.documents, "price_rows", lambda parsed: rows(parsed).withColumn("item_code", counted.asNondeterministic()("item_code")))
    items = ITEM.format(code="1", price="1") + ITEM.format(code="x", price="2") + ITEM.format(code="3", price="")
    pack(tmp_path / "raw" / "price_full" / "fresh" / "PriceFull7290027600007-001-001-20260722-030000.gz", PRICE.format(store="1", items=items))
    metrics = jobs.run(tables, str(tmp_path / "raw"), "fresh", "price_full", jobs.Options(mode="quarantine"))
    assert seen.value == 3
    assert (metrics.counts["products_staging_rejected"], metrics.counts["products_staging_incomplete"], metrics.counts["staged"]) == (1, 1, 1)
    kept = {r["reason"]: r["row"] for r in tables.read("rejected").collect()}
    assert set(kept) == {"not of the type of item_code", "no item_price"} and '"item_code":"x"' in kept["not of the type of item_code"] and '"lacks":["item_price"]' in kept["no item_price"]


def test_what_may_be_a_number(spark):
    given = ["7", " 7 ", " 7", "-7", "+7", "7.5", "1e3", "1E-3", ".5", "5.", "old", "7x9", "", " ", None, "٧", "\x017\x7f", "NaN"]
    df = spark.createDataFrame([(x,) for x in given], "x string")
    for kind in ("int", "bigint", "decimal(10,2)"):
        assert [r[0] == r[1] for r in df.select(F.coalesce(text.typed(F.col("x"), kind).cast("string"), F.lit("-")), F.coalesce(text.strip(F.col("x")).try_cast(kind).cast("string"), F.lit("-"))).collect()] == [True] * len(given)

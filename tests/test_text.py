from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from basketlake.functions import text


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("c"))).collect()]


def test_blank_and_unknown_text(spark):
    given = (" 6 ", "", "  ", "לא ידוע", " לא ידוע ", None, " x\n")
    assert values(spark, text.optional_text, *given) == ["6", None, None, "לא ידוע", "לא ידוע", None, "x"]
    assert values(spark, text.integer_text, *given) == ["6", None, None, None, None, None, "x"]


def test_first_filled(spark):
    rows = spark.createDataFrame([("1", "0"), ("", "0"), (None, "0"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(text.first_filled(F.col("a"), F.col("b"))).collect()] == ["1", "0", "0", ""]


@pytest.mark.parametrize(
    ("feed", "name", "found"),
    [
        (text.PRICE_FULL, "PriceFull7290027600007-001-004-20260722-030000.gz", ("004", "20260722", "030000")),
        (text.PRICE_FULL, "pricefull1-2-3-20260722-030000.GZ", ("3", "20260722", "030000")),
        (text.PRICE_FULL, "PromoFull7290027600007-001-001-20260722-030000.gz", None),
        (text.PRICE_FULL, "PriceFull7290027600007-001-001-20260722-030000.xml", None),
        (text.PRICE_FULL, "PriceFull7290027600007-001-20260722.gz", None),
        (text.STORES, "Stores7290027600007-000-20260816-020.gz", ("000", "20260816", "020")),
        (text.STORES, "Stores7290058140886-000-20260816-050500.xml", ("000", "20260816", "050500")),
        (text.STORES, "Stores7290696200003-000-20260816060100-060100.gz", ("000", "20260816060100", "060100")),
        (text.STORES, "Stores7290027600007-000-000-20260722-030000.gz", ("000", "20260722", "030000")),
        (text.PROMO_FULL, "PromoFull7290027600007-001-001-20260816-030000.gz", ("001", "20260816", "030000")),
    ],
)
def test_snapshot_of_names(spark, feed, name, found):
    (got,) = values(spark, lambda c: text.snapshot_of(c, feed), name)
    assert (tuple(got) if got else None) == found


def test_day_of_names(spark):
    price = lambda c: text.day_of(c, text.PRICE_FULL)
    stores = lambda c: text.day_of(c, text.STORES)
    day = datetime.date(2026, 7, 22)
    assert values(spark, price, "PriceFull1-2-3-20260722-030000.gz", "PriceFull1-2-3-20261399-030000.gz", "PriceFull.gz", "PriceFull1-2-3-20260722030000-1.gz") == [day, None, None, None]
    assert values(spark, stores, "Stores1-000-20260722060100-060100.gz", "Stores1-000-20260722-1.xml", "Stores1.gz") == [day, day, None]


def test_excluded_store(spark):
    assert values(spark, text.is_excluded_store, "039", "39", " 0039 ", "139", "", None) == [True, True, True, False, False, False]
    names = ("PromoFull7290058140886-001-039-20260816-030000.gz", "PromoFull7290058140886-001-39-20260816-030000.gz", "PromoFull7290027600007-001-039-20260816-030000.gz", "PriceFull7290058140886-001-039-20260816-030000.gz")
    assert values(spark, text.is_excluded_file, *names) == [True, True, False, False]


def test_addresses(spark):
    assert values(spark, text.file_name_of, "https://h.example/a/b.gz?sig=a/b", "/x/y.gz#z", "https://h.example", "n.gz", "") == ["b.gz", "y.gz", "", "n.gz", ""]
    joined = lambda c: text.absolute_url("https://h.example/dir/page?x=1", c)
    got = values(spark, joined, "/a.gz", "b.gz", "https://o.example/c", "//o.example/d", "?p=2", "../e.gz", "./f/../g.gz")
    assert got == ["https://h.example/a.gz", "https://h.example/dir/b.gz", "https://o.example/c", "https://o.example/d", "https://h.example/dir/page?p=2", "https://h.example/e.gz", "https://h.example/dir/g.gz"]


def test_manifest_time(spark):
    got = values(spark, text.manifest_time, "2026-08-16 05:05:00", "2026-08-16", None, "a b c")
    assert [tuple(x) if x else None for x in got] == [("2026-08-16", "05:05:00"), None, None, ("a", "b c")]


def test_typed_values(spark):
    assert values(spark, lambda c: text.typed(c, "boolean"), "1", "0", "on", "OFF", " yes ", "tru", "", None) == [True, False, True, False, True, None, None, None]
    assert values(spark, lambda c: text.typed(c, "int"), "001", " 7 ", "", "1.5", "x") == [1, 7, None, None, None]
    assert [str(x) for x in values(spark, lambda c: text.typed(c, "decimal(10,2)"), "7.905", "-7.905", "7")] == ["7.91", "-7.91", "7.00"]

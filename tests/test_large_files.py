"""Files of any size: landed row by row, read item by item, with the rows of whole documents."""

from __future__ import annotations

import gzip

from test_feeds import ITEM, PRICE, landed, tables  # noqa: F401  fixtures

from basketlake import queries
from basketlake.plans import jobs
from basketlake.sources import documents, landing


def test_documents_land_in_rows(spark, tmp_path):
    rows = [("PriceFull1.gz", 1, f"<i>{i}</i>") for i in range(500)] + [("PriceFull1.gz", 0, "<a>"), ("PriceFull1.gz", 2, "</a>"), ("b.xml", 2, "</b>"), ("b.xml", 0, "<b>")]
    assert landing.land_documents(spark.createDataFrame(rows, "source_file string, place int, content string").repartition(7), str(tmp_path / "x")) == 2
    lines = gzip.decompress((tmp_path / "x" / "PriceFull1.gz").read_bytes()).decode().split()
    assert (lines[0], lines[-1], len(lines)) == ("<a>", "</a>", 502)
    assert (tmp_path / "x" / "b.xml").read_text().split() == ["<b>", "</b>"]


def test_large_file_with_items_of_other_names(spark, landed, tables, monkeypatch):  # noqa: F811
    """It is too large to be read whole as a rule, and can't be read by the name Item."""
    monkeypatch.setattr(jobs, "ODD", 1000)
    content = PRICE.format(store="1", items=ITEM.format(code="1", price="1") + ITEM.format(code="2", price="2").replace("Item>", "Product>"))
    folder = landed / "price_full" / "odd"
    folder.mkdir()
    (folder / "PriceFull7290027600007-001-001-20260722-030000.gz").write_bytes(gzip.compress(content.encode()))
    jobs.run(tables, str(landed), "odd", "price_full", jobs.Options(record_bytes=1))
    assert tables.rows("rejected") == 0 and tables.rows("product_prices") == 2


def test_no_landed_file_is_one_value(spark, monkeypatch):
    """The queries' files are larger than what is read whole; no whole document is read."""
    monkeypatch.setattr(jobs.Options.__init__, "__defaults__", tuple(1000 if v == 256 << 10 else v for v in jobs.Options.__init__.__defaults__))
    seen = []
    read = documents.read_documents
    monkeypatch.setattr(documents, "read_documents", lambda *a, **k: seen.append(read(*a, **k).count()) or read(*a, **k))
    for name in ("landed_prices", "prices_in_range", "staged_after_failed_check"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert seen and not any(seen)

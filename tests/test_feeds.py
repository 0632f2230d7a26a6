"""Landed files to tables, for the three data sets, with unreadable and odd files among them."""

from __future__ import annotations

import datetime
import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.functions import text
from basketlake.plans import jobs
from basketlake.sources import documents, landing
from basketlake.sources.tables import Tables, drop_empty_columns, write_csv
from basketlake.streaming.ingest import stream_ingest

PRICE = """<Root><ChainID>7290027600007</ChainID><SubChainID>1</SubChainID><StoreID>{store}</StoreID><Items>{items}</Items></Root>"""
ITEM = "<Item><ItemCode>{code}</ItemCode><ItemName> Milk </ItemName><Quantity>1.5</Quantity><IsWeighted>0</IsWeighted><QtyInPackage>לא ידוע</QtyInPackage><ItemPrice>{price}</ItemPrice><AllowDiscount>1</AllowDiscount><PriceUpdateTime>2026-07-21 10:00:00</PriceUpdateTime><LastSaleDateTime/></Item>"
STORES = """<Root><ChainID>7290027600007</ChainID><ChainName>Fresh</ChainName><SubChains><SubChain><SubChainId>1</SubChainId><SubChainName>City</SubChainName><Stores>
<Store><StoreID>001</StoreID><BikoretNo>3</BikoretNo><StoreType></StoreType><StoreName>Old</StoreName><Address> 1 Road </Address><City/><ZipCode>123</ZipCode></Store>
<Store><StoreID>1</StoreID><BikoretNo>3</BikoretNo><StoreType>2</StoreType><StoreName>New</StoreName><Address>x</Address></Store>
<Store><StoreID>לא ידוע</StoreID><StoreName>Nowhere</StoreName></Store></Stores></SubChain><SubChain><SubChainId>2</SubChainId></SubChain></SubChains></Root>"""
PROMO = """﻿<Root><ChainID>{chain}</ChainID><SubChainID>1</SubChainID><StoreID>{store}</StoreID><BikoretNo>5</BikoretNo><Promotions>
<Promotion><PromotionID>P1</PromotionID><PromotionStartDateTime>2026-08-01 00:00:00</PromotionStartDateTime><AllowMultipleDiscounts>1</AllowMultipleDiscounts><ClubID> </ClubID><Remarks/>
 <Groups><Group><GroupID>G1</GroupID><MinPurchaseAmount>10.5</MinPurchaseAmount><PromotionItems><PromotionItem><ItemCode>7290001</ItemCode><DiscountedPrice>5.005</DiscountedPrice></PromotionItem><PromotionItem><ItemCode> </ItemCode></PromotionItem><Item><ItemCode>9</ItemCode></Item></PromotionItems></Group>
 <Group><GroupID/><PromotionItems><PromotionItem><ItemCode>8</ItemCode></PromotionItem></PromotionItems></Group><Group><GroupID>G2</GroupID></Group></Groups></Promotion>
<Promotion><PromotionID>P2</PromotionID></Promotion><Promotion><PromotionID> </PromotionID><Groups><Group><GroupID>G9</GroupID></Group></Groups></Promotion></Promotions></Root>"""


def pack(path, content, cut=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = gzip.compress(content.encode()) if path.suffix == ".gz" else content.encode()
    path.write_bytes(data[:cut])


@pytest.fixture
def landed(tmp_path):
    prices, stores, promos = (tmp_path / "raw" / kind / "fresh" for kind in ("price_full", "stores", "promo_full"))
    pack(prices / "PriceFull7290027600007-001-001-20260722-030000.gz", PRICE.format(store="001", items=ITEM.format(code="7290001", price="7.90") + ITEM.format(code="7290002", price="3")))
    pack(prices / "PriceFull7290027600007-001-001-20260722-040000.gz", PRICE.format(store="1", items=ITEM.format(code="07290001", price="8.10")))
    pack(prices / "PriceFull7290027600007-001-002-20260722-030000.gz", "<Root><ChainID>1</ChainID></Root>")
    pack(prices / "PriceFull7290027600007-001-003-20260722-030000.gz", PRICE.format(store="3", items=""))
    pack(prices / "PriceFull7290027600007-001-004-20260722-030000.gz", "<Root><Items>")
    pack(prices / "PriceFull7290027600007-001-005-20261399-030000.gz", PRICE.format(store="5", items=ITEM.format(code="1", price="1")))
    pack(prices / "PriceFull7290027600007-001-006-20260722-030000.gz", PRICE.format(store="6", items=ITEM.format(code="1", price="1")) * 40, cut=60)
    (prices / "PriceFull7290027600007-001-007-20260722-030000.gz").write_bytes(b"not gzip")
    pack(prices / "PromoFull7290027600007-001-001-20260722-030000.gz", "<Root/>")
    pack(stores / "Stores7290027600007-000-20260816060100-060100.gz", STORES)
    pack(stores / "Stores7290027600007-000-20260816-050500.xml", "<Root><SubChains/></Root>")
    pack(promos / "PromoFull7290027600007-001-001-20260816-030000.gz", PROMO.format(chain="7290027600007", store="1"))
    pack(promos / "PromoFull7290058140886-001-039-20260816-030000.gz", PROMO.format(chain="7290058140886", store="1"))
    pack(promos / "PromoFull7290058140886-001-040-20260816-030000.gz", PROMO.format(chain="7290058140886", store=" 039"))
    return tmp_path / "raw"


@pytest.fixture
def tables(spark, tmp_path):
    made = Tables(spark, str(tmp_path / "tables"))
    made.create()
    return made


def test_listing(spark, landed):
    folder = str(landed / "price_full" / "fresh")
    listed = landing.list_files(spark, folder, text.PRICE_FULL).collect()
    assert len(listed) == 8 and [r["path"] for r in listed] == sorted(r["path"] for r in listed)
    assert {(r["extract_type"], r["chain"]) for r in listed} == {("price_full", "fresh")}
    assert landing.list_all_files(spark, str(landed), text.PROMO_FULL).count() == 4
    with pytest.raises(FileNotFoundError, match="Stores"):
        landing.require_files(landing.list_files(spark, folder, text.STORES), folder, text.STORES)
    assert landing.list_files(spark, str(landed / "nothing"), text.STORES).isEmpty()
    one, rest = landing.skip_existing(landing.list_files(spark, folder, text.PRICE_FULL), landing.list_files(spark, folder, text.PRICE_FULL).limit(3))
    assert (one.count(), rest.count()) == (5, 3)


def test_quarantine_reasons(spark, landed):
    for kind, feed, want in (
        ("price_full", text.PRICE_FULL, {"002": "empty", "004": "malformed", "005": "no date in name", "006": "unreadable", "007": "unreadable"}),
        ("promo_full", text.PROMO_FULL, {"039": "excluded store", "040": "excluded store"}),
    ):
        folder = str(landed / kind / "fresh")
        parsed = documents.parse_documents(documents.read_documents(spark, folder, feed), feed)
        found = documents.quarantine(landing.list_files(spark, folder, feed), parsed, feed).collect()
        assert {r["file_name"].split("-")[2]: r["reason"] for r in found} == want


def test_prices_run_twice_gives_the_same_tables(spark, landed, tables):
    for _ in range(2):
        metrics = jobs.run(tables, str(landed), "fresh", "price_full")
        assert metrics.counts["files"] == 8 and metrics.counts["files_skipped"] == 5 and metrics.counts["staged"] == 3
        products = {r["item_code"]: r for r in tables.read("products").collect()}
        assert set(products) == {7290001, 7290002} and products[7290001]["item_name"] == " Milk " and products[7290001]["qty_in_package"] is None and products[7290001]["is_weighted"] is False
        prices = {r["item_code"]: r for r in tables.read("product_prices").collect()}
        assert str(prices[7290001]["item_price"]) == "8.10" and prices[7290001]["source_file"].endswith("040000.gz") and prices[7290001]["store_id"] == 1
        assert prices[7290002]["extraction_date"] == datetime.date(2026, 7, 22) and prices[7290002]["last_sale_date_time"] is None
        assert tables.read("products_staging").count() == 0
    assert metrics.rows(spark).count() == len(metrics.counts)


def test_strict_names_end_the_run(landed, tables):
    with pytest.raises(ValueError, match="no date"):
        jobs.run(tables, str(landed), "fresh", "price_full", jobs.Options(strict_names=True))
    assert tables.read("products").count() == 0


def test_failed_check_leaves_the_batch_staged(landed, tables):
    pack(landed / "price_full" / "fresh" / "PriceFull7290027600007-001-008-20260722-030000.gz", PRICE.format(store="8", items=ITEM.format(code="5", price="")))
    with pytest.raises(ValueError, match="1 staged rows"):
        jobs.run(tables, str(landed), "fresh", "price_full")
    assert tables.read("products_staging").count() == 4 and tables.read("products").count() == 0


def test_stores(landed, tables):
    metrics = jobs.run(tables, str(landed), "fresh", "stores")
    (store,) = tables.read("stores").collect()
    assert (store["chain_id"], store["store_id"], store["store_name"], store["store_type"], store["sub_chain_id"], store["extraction_date"]) == (7290027600007, 1, "New", 2, 1, datetime.date(2026, 8, 16))
    assert metrics.counts["stores_without_key"] == 1 and metrics.counts["files_skipped"] == 1


def test_promotions(landed, tables):
    for _ in range(2):
        metrics = jobs.run(tables, str(landed), "fresh", "promo_full")
        promos = {r["promotion_id"]: r for r in tables.read("promotions").collect()}
        assert set(promos) == {"P1", "P2"} and promos["P1"]["club_id"] is None and promos["P1"]["remarks"] is None and promos["P1"]["allow_multiple_discounts"] is True
        assert {r["group_id"] for r in tables.read("promotion_groups").collect()} == {"G1", "G2"}
        (item,) = tables.read("promotion_items").collect()
        assert item["item_code"] == 7290001 and str(item["discounted_price"]) == "5.01"
    assert metrics.counts["promotions_without_key"] == 1 and metrics.counts["files_skipped"] == 2


def test_unknown_data_set(tables, landed):
    with pytest.raises(ValueError, match="data sets"):
        jobs.run(tables, str(landed), "fresh", "coupons")


def test_stream_takes_each_file_once(spark, landed, tables, tmp_path):
    start = lambda kind: stream_ingest(tables, str(landed / kind / "fresh"), kind, str(tmp_path / "at" / kind))
    for kind in ("price_full", "stores", "promo_full"):
        start(kind).awaitTermination()
    assert tables.read("product_prices").count() == 2 and tables.read("stores").count() == 1 and tables.read("promotion_items").count() == 1
    pack(landed / "price_full" / "fresh" / "PriceFull7290027600007-001-009-20260723-030000.gz", PRICE.format(store="9", items=ITEM.format(code="7290001", price="9")))
    again = start("price_full")
    again.awaitTermination()
    assert sum(p["numInputRows"] for p in again.recentProgress) == 1
    assert tables.read("product_prices").count() == 3


def test_tables(spark, tables, tmp_path):
    assert [r[0] for r in tables.names().collect()] == sorted(["products", "product_prices", "products_staging", "stores", "promotions", "promotion_groups", "promotion_items", "rejected"])
    tables.create()
    df = spark.createDataFrame([(1, "א", None, " \t"), (2, "b", None, "\n")], "a int, b string, c int, d string")
    assert drop_empty_columns(df).columns == ["a", "b"]
    write_csv(df.select("a", "b"), str(tmp_path), "fresh")
    back = spark.read.option("header", True).csv(str(tmp_path / "fresh_products.csv"))
    assert sorted(map(tuple, back.collect())) == [("1", "א"), ("2", "b")]


def test_a_load_writes_its_own_days_only(spark, landed, tables):
    jobs.run(tables, str(landed), "fresh", "price_full")
    before = dict(tables._current("product_prices"))
    pack(landed / "price_full" / "fresh2" / "PriceFull7290027600007-001-009-20260723-030000.gz", PRICE.format(store="9", items=ITEM.format(code="7290001", price="9")))
    jobs.run(tables, str(landed), "fresh2", "price_full")
    after = dict(tables._current("product_prices"))
    assert tables.days("product_prices") == ["2026-07-22", "2026-07-23"] and tables.rows("product_prices") == 3
    assert set(before) < set(after) and [n for f, n in after.items() if f not in before] == [1]
    for _ in range(3):  # old versions go, with the folders that only they list
        jobs.run(tables, str(landed), "fresh2", "price_full")
    folders = {str(p.relative_to(Path(tables.root, "product_prices", "data"))) for p in Path(tables.root, "product_prices", "data").glob("write=*/extraction_date=*/bucket=*")}
    assert len(folders) == 3 and set(dict(tables._current("product_prices"))) <= folders


class Stopped(Exception):
    pass


class Stopping:
    """A file system that stops before its k-th change."""

    def __init__(self, fs, left):
        self.fs, self.left = fs, left

    def __getattr__(self, name):
        def call(*args):
            if name in ("create", "rename", "delete", "mkdirs"):
                if self.left[0] == 0:
                    raise Stopped
                self.left[0] -= 1
            return getattr(self.fs, name)(*args)

        return call


def test_a_write_that_stops_anywhere_loses_nothing(spark, tmp_path, monkeypatch):
    store = lambda i: spark.createDataFrame([(1, i)], "chain_id long, store_id int")
    full = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in schemas.STORES.items()))
    tables = Tables(spark, str(tmp_path / "t"))
    tables.create()
    for i in range(3):
        tables.overwrite("stores", full(store(i)))
    real, last = Tables._fs, 2
    for stop in range(12):
        left = [stop]
        monkeypatch.setattr(Tables, "_fs", lambda self: Stopping(real(self), left))  # noqa: B023
        try:
            tables.overwrite("stores", full(store(100 + stop)))
            ended = True
        except Stopped:
            ended = False
        monkeypatch.setattr(Tables, "_fs", real)
        again = Tables(spark, str(tmp_path / "t"))
        again.create()
        (now,) = [r["store_id"] for r in again.read("stores").collect()]
        assert now in (last, 100 + stop) and (now == 100 + stop or not ended)
        last = now
    assert ended


def test_rejected_rows_and_files_are_kept(spark, landed, tables):
    items = ITEM.format(code="7290001", price="7.90") + ITEM.format(code="x1", price="3") + ITEM.format(code="5", price="")
    pack(landed / "price_full" / "odd" / "PriceFull7290027600007-001-001-20260722-030000.gz", PRICE.format(store="1", items=items))
    pack(landed / "price_full" / "odd" / "PriceFull7290027600007-001-002-20260722-030000.gz", "<Root><Items>")
    metrics = jobs.run(tables, str(landed), "odd", "price_full", jobs.Options(mode="quarantine"))
    assert metrics.counts["products_staging_rejected"] == 1 and metrics.counts["products_staging_incomplete"] == 1 and metrics.counts["product_prices"] == 1
    kept = {(r["target"], r["reason"]): r["row"] for r in tables.read("rejected").collect()}
    assert set(kept) == {("PriceFull file", "malformed"), ("products_staging", "not of the type of item_code"), ("products_staging", "no item_price")}
    assert '"item_code":"x1"' in kept["products_staging", "not of the type of item_code"]


def test_listing_to_load(spark, landed, tables, tmp_path):
    """A JSON manifest: newest day, newest time of each store, what has landed is loaded, the rest is to be fetched."""
    name = "PriceFull7290027600007-001-00{}-202607{}-0{}0000.gz".format
    listed = [(name(1, 22, 3), "2026-07-22 03:00:00", 1), (name(1, 22, 4), "2026-07-22 04:00:00", 1), (name(8, 22, 4), "2026-07-22 04:00:00", 8), (name(9, 21, 9), "2026-07-21 09:00:00", 9)]
    entries = [{"fileType": "pricefull", "fileName": n, "fileDate": d, "branchNumber": b} for n, d, b in listed]
    (tmp_path / "m.json").write_text(json.dumps(entries))
    (tmp_path / "n.txt").write_text("\r\n".join(n for n, _, _ in listed) + "\n\nreadme\n")
    by_json = landing.snapshots_of_manifest(landing.read_manifest_json(spark, str(tmp_path / "m.json"), "PriceFull"))
    by_name = landing.snapshots_of_names(landing.read_manifest_names(spark, str(tmp_path / "n.txt")), text.PRICE_FULL)
    for snapshots in (by_json, by_name):
        metrics, fetch = jobs.run_listed(tables, snapshots, str(landed), "fresh", "price_full")
        assert [r["file_name"] for r in fetch.collect()] == [name(8, 22, 4)] and metrics.counts["files"] == 1
        assert [(r["item_code"], str(r["item_price"])) for r in tables.read("product_prices").collect()] == [(7290001, "8.10")]
    links = spark.createDataFrame([(f"https://h.example/p/{n}?s={i}", i) for i, (n, _, _) in enumerate(listed)], "url string, position int")
    metrics, fetch = jobs.run_listed(tables, landing.snapshots_of_links(links, text.PRICE_FULL), str(landed), "fresh", "price_full", jobs.Options.trial())
    assert metrics.counts["files"] == 1 and fetch.count() == 1
    assert jobs.run_listed(tables, by_name.where("false"), str(landed), "fresh", "price_full")[0].counts == {"files": 0}


def test_trial_takes_a_few_files(landed, tables):
    assert jobs.run(tables, str(landed), "fresh", "price_full", jobs.Options.trial()).counts["files"] == landing.TRIAL_FILES


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"fileType":"PriceFull","fileName":"a.gz","fileDate":"2026-08-16 05:05:00","branchNumber":4},{"fileType":"promo"},{"fileName":"x"}]')
    assert [tuple(r) for r in landing.read_manifest_json(spark, str(tmp_path / "m.json"), "pricefull").collect()] == [("PriceFull", "a.gz", "2026-08-16 05:05:00", "4", 0)]
    (tmp_path / "n.txt").write_text("PromoFull7290058140886-001-039-20260817-030000.gz\nPromoFull7290058140886-001-001-20260816-030000.gz\nreadme\n")
    names = landing.read_manifest_names(spark, str(tmp_path / "n.txt"))
    assert [r["store_id"] for r in landing.snapshots_of_names(names, text.PROMO_FULL, text.EXCLUDED_CHAIN, text.EXCLUDED_STORE).collect()] == ["001"]
    links = spark.createDataFrame([("https://h.example/PriceFull1-2-3-20260722-030000.gz?s=1", 0), ("https://h.example/other", 1)], "url string, position int")
    assert [r["store_id"] for r in landing.snapshots_of_links(links, text.PRICE_FULL).collect()] == ["3"]


def test_links_stop_at_a_page_without_new_names(spark):
    pages = [(1, '<a href="/PriceFull-a.gz?s=1">x</a><A HREF=\'/stores.gz\'>'), (2, "<a class=q href=/PriceFull-b.gz>"), (3, '<a href="/PriceFull-a.gz?s=2">'), (4, '<a href="/PriceFull-c.gz">')]
    df = spark.createDataFrame(pages, "page int, html string")
    links = landing.extract_links(df, "https://h.example/l", "pricefull")
    assert [r["url"] for r in links.orderBy("page").collect()] == ["https://h.example/PriceFull-a.gz?s=1", "https://h.example/PriceFull-b.gz", "https://h.example/PriceFull-a.gz?s=2", "https://h.example/PriceFull-c.gz"]
    assert sorted(r["file_name"] for r in landing.new_links(links).collect()) == ["PriceFull-a.gz", "PriceFull-b.gz"]
    assert landing.new_links(links, max_pages=1).count() == 1

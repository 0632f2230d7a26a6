"""Buckets, other writers, compaction, streams that stop midway, states of files, checks of all days."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import StreamingQueryException
from test_feeds import ITEM, PRICE, landed, pack, tables  # noqa: F401  fixtures

from basketlake import schemas
from basketlake.operators.upsert import merge_batch
from basketlake.plans import jobs
from basketlake.sources import landing
from basketlake.sources import tables as tables_module
from basketlake.sources.tables import Conflict, Tables, part_of
from basketlake.streaming.ingest import stream_ingest


def name(store, day=22, hour="03"):
    return f"PriceFull7290027600007-001-{store:03d}-202607{day}-{hour}0000.gz"


def price_file(folder: Path, store, day=22, items=(("7290001", "7.90"),), hour="03"):
    pack(folder / name(store, day, hour), PRICE.format(store=store, items="".join(ITEM.format(code=c, price=p) for c, p in items)))


def prices(spark, rows):
    """(store, item, day, price) as rows of the price table."""
    given = spark.createDataFrame([(1, s, i, datetime.date(2026, 7, d), p) for s, i, d, p in rows], "chain_id long, store_id int, item_code long, extraction_date date, item_price string")
    return given.select(*((F.col(c).cast(k) if c in given.columns else F.lit(None).cast(k)).alias(c) for c, k in schemas.TABLES["product_prices"].items()))


def held(tables):  # noqa: F811
    return {(r["store_id"], r["item_code"], r["extraction_date"].day): str(r["item_price"]) for r in tables.read("product_prices").collect()}


# buckets


def test_a_file_of_one_store_rewrites_its_buckets_alone(spark, tables):  # noqa: F811
    jobs.merge_into(tables, "product_prices", prices(spark, [(s, i, d, "1") for s in range(60) for i in range(5) for d in (20, 21, 22)]))
    before = dict(tables._current("product_prices"))
    assert len(before) > 3 * 8
    jobs.merge_into(tables, "product_prices", prices(spark, [(7, 3, 21, "2"), (7, 99, 21, "3")]))
    after = dict(tables._current("product_prices"))
    gone = set(before) - set(after)
    assert len(gone) == 1 and len(set(after) - set(before)) == 1
    assert part_of(*gone)[0] == "2026-07-21"
    assert tables.rows("product_prices") == 901 and held(tables)[7, 3, 21] == "2.00"


def test_keys_of_each_bucket_are_in_the_manifest(spark, tables):  # noqa: F811
    jobs.merge_into(tables, "product_prices", prices(spark, [(s, 10 * s + i, d, "1") for s in range(60) for i in range(5) for d in (20, 21)]))
    jobs.merge_into(tables, "product_prices", prices(spark, [(4, 100_000, 20, "1")]))
    for e in tables._entries("product_prices"):
        rows = tables._read("product_prices", [e]).collect()
        assert len(rows) == e["rows"]
        for k in ("chain_id", "store_id", "item_code"):
            assert (min(r[k] for r in rows), max(r[k] for r in rows)) == (e["low"][k], e["high"][k])
    assert len(tables.in_range("product_prices", item_code=(90_000, 200_000))) == 1
    assert [r["store_id"] for r in tables.read_range("product_prices", item_code=(90_000, 200_000)).collect()] == [4]
    assert tables.read_range("product_prices", store_id=(3, 5), item_code=(40, 44)).count() == 10


def test_a_whole_history_may_be_overwritten(spark, tables):  # noqa: F811
    rows = prices(spark, [(s, 1, 20, "1") for s in range(30)])
    odd = rows.limit(1).withColumn("store_id", F.lit(None).cast("int"))
    tables.overwrite("product_prices", rows.unionByName(odd))
    assert tables.rows("product_prices") == tables.read("product_prices").count() == 31


def test_many_parts_are_counted_from_their_files(spark, tables, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tables_module, "COUNTED_PARTS", 2)
    jobs.merge_into(tables, "product_prices", prices(spark, [(s, 1, 20, "1") for s in range(30)]))
    assert tables.rows("product_prices") == tables.read("product_prices").count() == 30


# other writers


class Meddled(Tables):
    """Tables in which another writer acts between the data and the commit of a write."""

    def meanwhile(self, act):
        self.act = act

    def _write(self, *args, **more):
        out = super()._write(*args, **more)
        act, self.act = getattr(self, "act", None), None
        if act:
            act()
        return out


def test_two_writers_of_different_days_both_succeed(spark, tables):  # noqa: F811
    one = Meddled(spark, tables.root)
    one.meanwhile(lambda: jobs.merge_into(tables, "product_prices", prices(spark, [(1, 1, 21, "2")])))
    jobs.merge_into(one, "product_prices", prices(spark, [(1, 1, 20, "1")]))
    assert held(tables) == {(1, 1, 20): "1.00", (1, 1, 21): "2.00"}


def test_two_writers_of_one_bucket_are_merged_one_after_the_other(spark, tables):  # noqa: F811
    one = Meddled(spark, tables.root)
    one.meanwhile(lambda: jobs.merge_into(tables, "product_prices", prices(spark, [(1, 1, 20, "2"), (1, 2, 20, "2")])))
    jobs.merge_into(one, "product_prices", prices(spark, [(1, 1, 20, "1"), (1, 3, 20, "1")]))
    assert held(tables) == {(1, 1, 20): "1.00", (1, 2, 20): "2.00", (1, 3, 20): "1.00"}
    full = lambda i: spark.createDataFrame([(1, i)], "chain_id long, store_id int").select(*((F.col(c) if c in ("chain_id", "store_id") else F.lit(None)).cast(k).alias(c) for c, k in schemas.STORES.items()))
    one.meanwhile(lambda: jobs.merge_into(tables, "stores", full(2)))
    jobs.merge_into(one, "stores", full(1))
    assert sorted(r["store_id"] for r in tables.read("stores").collect()) == [1, 2]


def test_a_stale_base_is_a_conflict(spark, tables):  # noqa: F811
    jobs.merge_into(tables, "product_prices", prices(spark, [(1, 1, 20, "1")]))
    base, batch = tables._entries("product_prices"), prices(spark, [(1, 1, 20, "3")])
    jobs.merge_into(tables, "product_prices", prices(spark, [(1, 1, 20, "2")]))
    with pytest.raises(Conflict):
        tables.replace_parts("product_prices", merge_batch(batch.limit(0), batch, "product_prices", []), tables.bounds("product_prices", batch), base)
    assert held(tables) == {(1, 1, 20): "2.00"}


# compaction and clean-up


def test_appends_keep_few_folders(spark, tables, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tables_module, "MOST_FOLDERS", 4)
    for i in range(20):
        tables.append("rejected", spark.createDataFrame([("t", f"file {i}", "r", None)], schemas.struct_of(schemas.REJECTED)))
        assert len(tables._current("rejected")) <= 5
    assert sorted(r["source_file"] for r in tables.read("rejected").collect()) == sorted(f"file {i}" for i in range(20)) and tables.rows("rejected") == 20


def test_vacuum_deletes_what_no_manifest_lists(spark, tables):  # noqa: F811
    for i in range(3):
        jobs.merge_into(tables, "product_prices", prices(spark, [(i, 1, 20, "1")]))
    before = held(tables)
    left = tables._write("product_prices", prices(spark, [(9, 9, 20, "1")]))  # a write that never came to its commit
    Path(tables.root, "product_prices", "pending-x").write_text("{}")
    assert tables.vacuum() == 0 and left
    assert tables.vacuum(older_than=-10) >= 2
    assert held(tables) == before and not Path(tables.root, "product_prices", "pending-x").exists()
    assert not Path(tables.root, "product_prices", "data", left[0]["path"].split("/")[0]).exists()
    assert {p.name for p in Path(tables.root, "product_prices", "data").iterdir() if p.is_dir()} >= {f.split("/")[0] for f, _ in tables._current("product_prices")}


# streams


class Stopped(Exception):
    pass


def stream(tables, folder, at, **options):  # noqa: F811
    stream_ingest(tables, str(folder), "price_full", str(at), **options).awaitTermination()


def rejected(tables):  # noqa: F811
    return sorted((r["source_file"].split("-")[2], r["reason"]) for r in tables.read("rejected").collect())


WANT = [("002", "empty"), ("004", "malformed"), ("005", "no date in name"), ("006", "unreadable"), ("007", "unreadable")]


def test_files_that_cannot_be_read_are_stored_once(landed, tables, tmp_path):  # noqa: F811
    for _ in range(2):
        stream(tables, landed / "price_full" / "fresh", tmp_path / "at")
        assert rejected(tables) == WANT and tables.read("product_prices").count() == 2
    states = {r["file_name"].split("-")[2] + r["file_name"][-9:-7]: r["state"] for r in jobs.file_states(tables).collect()}
    assert set(states.values()) == {"loaded", "rejected"} and len(states) == 8


@pytest.mark.parametrize("stop", ["append:rejected", "_commit:products", "merge:product_prices", "merge:price_items", "clear:products_staging", "append:files"])
def test_a_stream_that_stops_between_a_commit_and_its_checkpoint(spark, landed, tables, tmp_path, monkeypatch, stop):  # noqa: F811
    """It ends right after a commit; the next run makes the same batch, and what is committed counts once."""
    step, table = stop.split(":")
    real = getattr(Tables, step)

    def stopping(self, name, *args, **more):
        out = real(self, name, *args, **more)
        if name == table:
            raise Stopped
        return out

    monkeypatch.setattr(Tables, step, stopping)
    with pytest.raises(StreamingQueryException):
        stream(tables, landed / "price_full" / "fresh", tmp_path / "at")
    monkeypatch.setattr(Tables, step, real)
    number = max(tables._versions("rejected"))
    stream(tables, landed / "price_full" / "fresh", tmp_path / "at")
    assert rejected(tables) == WANT and tables.read("product_prices").count() == 2 and tables.read("products").count() == 2
    assert tables.read("files").count() == 8 and max(tables._versions("rejected")) == number
    price_file(landed / "price_full" / "fresh", 9, day=23)
    stream(tables, landed / "price_full" / "fresh", tmp_path / "at")
    assert tables.read("product_prices").count() == 3 and rejected(tables) == WANT


def test_streams_are_told_apart(landed, tables, tmp_path):  # noqa: F811
    """A second stream's first batch has a number that the first stream has used."""
    stream(tables, landed / "price_full" / "fresh", tmp_path / "one")
    price_file(landed / "price_full" / "other", 9, day=23)
    (landed / "price_full" / "other" / name(8)).write_bytes(b"no")
    stream(tables, landed / "price_full" / "other", tmp_path / "two")
    assert tables.read("product_prices").count() == 3 and rejected(tables) == sorted([*WANT, ("008", "unreadable")])


# states of files


def test_a_loaded_file_that_was_moved_away_is_not_fetched_again(spark, landed, tables, tmp_path):  # noqa: F811
    folder = landed / "price_full" / "fresh"
    stream(tables, folder, tmp_path / "at")
    (folder / name(1, hour="04")).unlink()
    (folder / name(7)).unlink()  # unreadable, so it is wanted again
    names = spark.createDataFrame([(name(1, hour="04"), 0), (name(7), 1), (name(8), 2)], "name string, position int")
    metrics, fetch = jobs.run_listed(tables, landing.snapshots_of_names(names, jobs.FEEDS["price_full"]), str(landed), "fresh", "price_full")
    assert sorted(r["file_name"] for r in fetch.collect()) == [name(7), name(8)] and metrics.counts == {"files": 0}
    states = {r["file_name"]: r["state"] for r in jobs.file_states(tables).collect()}
    assert states[name(1, hour="04")] == "loaded" and states[name(7)] == states[name(8)] == "listed"


def test_job_and_stream_leave_out_what_the_other_has_loaded(landed, tables, tmp_path):  # noqa: F811
    folder = landed / "price_full" / "fresh"
    price_file(folder, 20)
    jobs.run(tables, str(landed), "fresh", "price_full")
    price_file(folder, 21)
    version = max(tables._versions("rejected"))
    stream(tables, folder, tmp_path / "at", options=jobs.Options(mode="quarantine", skip_loaded=True))
    assert tables.read("product_prices").where("store_id = 21").count() == 1
    assert jobs.run(tables, str(landed), "fresh", "price_full", jobs.Options(skip_loaded=True)).counts["staged"] == 0
    assert max(tables._versions("rejected")) > version  # damaged files are tried again


def test_a_trial_over_three_pages_loads_two(spark, landed, tables):  # noqa: F811
    folder = landed / "price_full" / "pages"
    for s in (1, 2, 3):
        price_file(folder, s)
    pages = spark.createDataFrame([(s, f'<a href="/f/{name(s)}?k={s}">x</a>') for s in (1, 2, 3)], "page int, html string")
    metrics, _ = jobs.run_pages(tables, pages, "https://h.example/", str(landed), "pages", "price_full", jobs.Options.trial())
    assert metrics.counts["files"] == 2 and sorted(r["store_id"] for r in tables.read("product_prices").collect()) == [1, 2]
    metrics, _ = jobs.run_pages(tables, pages, "https://h.example/", str(landed), "pages", "price_full")
    assert metrics.counts["files"] == 3


# checks and counts


def test_an_old_price_without_product_is_found_without_reading_all_days(spark, landed, tables):  # noqa: F811
    folder = landed / "price_full" / "fresh9"
    for day in (20, 21, 22):
        price_file(folder, 1, day=day, items=[("1", "1"), (str(day), "2")])
    jobs.run(tables, str(landed), "fresh9", "price_full")
    tables.overwrite("products", tables.read("products").where("item_code <> 20"))  # by someone else
    opened = []
    real = Tables.read
    Tables.read = lambda self, n, *a, **k: opened.append((n, k.get("days"))) or real(self, n, *a, **k)
    try:
        price_file(landed / "price_full" / "fresh10", 2, day=23, items=[("1", "1")])
        with pytest.raises(ValueError, match="1 prices have no product"):
            jobs.run(tables, str(landed), "fresh10", "price_full")
    finally:
        Tables.read = real
    assert [d for n, d in opened if n == "product_prices" and d is not None] == [[datetime.date(2026, 7, 20)]]


def test_counts_are_taken_in_the_pass_that_writes(spark, landed, tables):  # noqa: F811
    """The staged batch is made once: its parse is counted row by row."""
    seen = spark.sparkContext.accumulator(0)
    real = jobs.documents.price_rows

    def watched(parsed):
        rows = real(parsed)
        note = F.udf(lambda x: seen.add(1) or x, "string")
        return rows.withColumn("source_file", note.asNondeterministic()("source_file"))

    jobs.documents.price_rows = watched
    try:
        metrics = jobs.run(tables, str(landed), "fresh", "price_full")
    finally:
        jobs.documents.price_rows = real
    assert seen.value == metrics.counts["staged"] == 3 and metrics.counts["prices_without_key"] == 0
    metrics = jobs.run(tables, str(landed), "fresh", "stores")
    assert metrics.counts["stores_without_key"] == 1

"""One row per key: the latest of a batch, and the newest snapshot per store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake import schemas


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Only one row of a key leaves a task, since the rank's limit moves below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def newest_first(rows: DataFrame, *columns: str) -> list[Column]:
    """Descending with nulls first by these columns, then by all others, so that ties have one result."""
    rest = [c for c in rows.columns if c not in columns]
    return [F.desc_nulls_first(c) for c in (*columns, *rest)]


def latest_products(staging: DataFrame) -> DataFrame:
    """The newest day's description of each item."""
    known = staging.where("item_code is not null").select("item_code", "extraction_date", "source_file", *(c for c in schemas.PRODUCTS if c != "item_code"))
    return first_per_key(known, ["item_code"], newest_first(known, "extraction_date", "source_file")).select(*schemas.PRODUCTS)


def latest_prices(staging: DataFrame) -> DataFrame:
    """The last file's price for each chain, store, item and day; rows without a full key are left out."""
    keys = schemas.KEYS["product_prices"]
    known = staging.select(*schemas.PRICES).dropna(subset=keys)
    return first_per_key(known, keys, newest_first(known, "source_file"))


def last_written(rows: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """What row-by-row writes would leave: the last row of a key by source file and position within it."""
    return first_per_key(rows, keys, newest_first(rows, *position))


def latest_daily_snapshots(snapshots: DataFrame, max_files: int | None = None) -> DataFrame:
    """Of rows (store_id, date, time, position, ...): the newest day over all stores, then each store's newest time, the
    first listed of equal ones; by store. Days and times compare as text. A store without that day is not selected.
    `max_files` cuts the selection afterwards."""
    newest = snapshots.agg(F.max("date").alias("date"))  # one row
    same_day = snapshots.join(F.broadcast(newest), "date").select(*snapshots.columns)
    rest = [F.asc_nulls_first(c) for c in snapshots.columns if c not in ("store_id", "time", "position")]
    chosen = first_per_key(same_day, ["store_id"], [F.desc_nulls_last("time"), F.asc("position"), *rest]).orderBy("store_id")
    return chosen if max_files is None else chosen.limit(max_files)

"""Keyed merges: an incoming batch over the rows that a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketlake import schemas
from basketlake.operators.latest import last_written


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """All rows after the merge; nothing is deleted. `incoming` has one row per key.

    update: an incoming row replaces the row of its key. ignore: the row that is there stays.
    """
    if mode == "update":
        return existing.join(incoming.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(incoming)
    if mode == "ignore":
        return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns))
    raise ValueError(f"mode is update or ignore, not {mode}")


def merge_batch(existing: DataFrame, batch: DataFrame, table: str, position: list[str], mode: str = "update") -> DataFrame:
    """Rows of a table after a batch in which keys may repeat: the last written counts. `position` orders the batch."""
    keys = schemas.KEYS[table]
    known = batch.dropna(subset=keys)
    return upsert(existing, last_written(known, keys, position).select(*existing.columns), keys, mode)

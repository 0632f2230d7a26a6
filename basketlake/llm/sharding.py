"""Contiguous shards of near equal bytes: global prefix sums of sizes from per-partition totals, cut at equal targets.

Only doc_id, size and checksum are shuffled, never a text. Rows are dealt out by ranges of doc_id and summed within each
range; the totals of the ranges (a row each) give what lies before a range. A row belongs to the shard in which the
middle of its bytes falls, so shards differ from the target by less than a row at either end. What lies before each
shard then gives the slots.

A null text has size 1 (no bytes, plus 1) and crc32 0; a null doc_id comes first. Equal rows are ordered among
themselves in any way, which does not show in the result. Shards that no row falls into stay empty (fewer rows than
shards). An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlake.llm import shared


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), "size", "text_crc32", "tie"]
    within = Window.partitionBy("part").orderBy(*order)
    scratch = shared.Scratch(spark, "sharding")
    dealt = rows.repartitionByRange(shared.shuffle_width(spark), *order).withColumn("part", F.spark_partition_id())
    summed = scratch.save(dealt.select("doc_id", "size", "text_crc32", "part", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(within).cast("long").alias("row")), "summed")
    totals = shared.before_parts(summed.groupBy("part").agg(F.max("upto").alias("bytes"), F.max("row").alias("rows")), "part", "bytes", "rows")
    whole = summed.agg(F.sum("size")).first()[0] or 1
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = summed.join(F.broadcast(totals), "part").select(
        "doc_id", "size", "text_crc32", F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * whole)).cast("int").alias("shard"), (F.col("rows_before") + F.col("row") - 1).alias("place")
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes the table with one folder of Parquet files per shard, rows in order of doc_id within a file. Equal rows that
    lie on both sides of a cut are told apart by their number among their like, as many to each side as the slots say."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["__id", "__crc", "__size"]
    placed = shard_by_bytes(docs, shards).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), "shard", "slot")
    spread = placed.groupBy(*key).agg(F.min("shard").alias("__least"), F.max("shard").alias("__most"))
    spread = spread.select(*(F.col(c).alias(f"{c}_2") for c in key), "__least", "__most")
    split = F.broadcast(spread.where("__least < __most"))  # one key a cut at most
    same = lambda two: F.col("__id").eqNullSafe(F.col(f"__id{two}")) & (F.col("__crc") == F.col(f"__crc{two}")) & (F.col("__size") == F.col(f"__size{two}"))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__crc": F.crc32(text.cast("binary")), "__size": (F.octet_length(text) + 1).cast("long")})
    one = keyed.join(spread.where("__least = __most"), same("_2")).select(*docs.columns, F.col("__least").alias("shard"))
    left = keyed.join(split, same("_2"), "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    right = placed.join(split, same("_2"), "left_semi").withColumn("__n_3", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")))
    right = right.select(*(F.col(c).alias(f"{c}_3") for c in key), "__n_3", F.col("shard").alias("__shard"))
    cut = left.join(right, same("_3") & (F.col("__n") == F.col("__n_3"))).select(*docs.columns, F.col("__shard").alias("shard"))
    one.unionByName(cut).repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path)

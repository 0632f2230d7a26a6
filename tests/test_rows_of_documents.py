"""Rows that are made of a document's elements don't hold the whole document, which would grow with its square."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions import text
from basketlake.operators.coerce import cast_to_table
from basketlake.sources import documents


def generated(plan):
    """Columns that each generator of a plan puts out."""
    below = [c for i in range(plan.children().size()) for c in generated(plan.children().apply(i))]
    return below + ([plan.output().toString()] if plan.nodeName() == "Generate" else [])


def rows_of(spark, feed, rows, kinds):
    """The generators of the rows of documents that stand parsed, with a filter on their values."""
    docs = spark.createDataFrame([("x", "<Root/>")], "source_file string, content string")
    parsed = documents.parse_documents(docs, feed).persist()
    raw = rows(documents.usable(parsed, feed))
    _, bad = cast_to_table(raw.select(*(F.col(c).cast("string").alias(c) for c in kinds)), kinds, "quarantine")
    found = generated(bad._jdf.queryExecution().optimizedPlan())
    parsed.unpersist()
    return found


def test_prices_hold_no_document(spark):
    found = rows_of(spark, text.PRICE_FULL, documents.price_rows, {"store_id": "int", "item_status": "int", "source_file": "string"})
    assert found and not [c for c in found if "doc#" in c or "items#" in c]


def test_stores_hold_no_sub_chain(spark):
    found = rows_of(spark, text.STORES, documents.store_rows, {"chain_id": "bigint", "sub_chain_id": "int", "store_id": "int", "source_file": "string"})
    assert len(found) == 2 and not [c for c in found if "doc#" in c] and "g#" not in found[1]


def test_promotions_hold_no_document_or_group(spark):
    def rows(parsed):
        return documents.flatten_promotions(documents.promotion_trees(parsed).persist())[2]

    found = rows_of(spark, text.PROMO_FULL, rows, {"chain_id": "bigint", "item_code": "bigint", "source_file": "string"})
    assert len(found) == 2 and "groups#" not in found[0] and "g#" not in found[1]
    spark.catalog.clearCache()


def test_names_of_documents_without_a_listing_are_not_joined(spark):
    docs = spark.createDataFrame([("x", "<Root/>")], "source_file string, content string")
    plan = documents.quarantine(None, documents.parse_documents(docs, text.PROMO_FULL), text.PROMO_FULL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

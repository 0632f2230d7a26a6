"""The names of a price document's items are found in its text, and by a parse only where the text may mislead."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_any_item import codes, document, one

from basketlake.functions import text
from basketlake.sources import documents

BOTH = one("Item", "1") + one("Product", "2")
#: Documents whose items the text's names give.
PLAIN = [
    (document(BOTH), ["1", "2"]),
    ("<?xml version='1.0'?>\n" + document(BOTH), ["1", "2"]),
    (document(one("Row", "1") + "<Product a='b'><ItemCode>2</ItemCode><New>5</New><Deep><Item><ItemCode>9</ItemCode></Item></Deep></Product><!-- <x> --><odd.name/>"), ["1", "2", None]),
]
#: Those where a parse must find them: values with tags, CDATA, another root.
MISLEADING = [
    (document("<Item><ItemCode><b>1</b></ItemCode></Item>" + one("Product", "2")), ["<b>1</b>", "2"]),
    (document("<Item><ItemCode><![CDATA[<b>]]></ItemCode></Item>" + one("Product", "2")), ["<b>", "2"]),
    (document(BOTH).replace("Root>", "Prices>"), ["1", "2"]),
    (document(BOTH, "<Items>").replace("Root>", "ns:Root>"), ["1", "2"]),
]


@pytest.mark.parametrize(("content", "want"), PLAIN + MISLEADING)
def test_items_are_found(spark, content, want):
    assert [c for c, _ in codes(spark, content)] == want


def test_plain_documents_need_no_third_parse(spark, monkeypatch):
    monkeypatch.setattr(documents, "other_names_of_items", lambda content: F.raise_error(content).cast("array<string>"))
    for content, want in PLAIN:
        df = spark.createDataFrame([("PriceFull1-1-1-20260722-030000.gz", content)], "source_file string, content string")
        found = documents.parse_documents(df, text.PRICE_FULL).selectExpr("transform(doc.Items.Item, i -> i.ItemCode) as c").first()["c"]
        assert found == want

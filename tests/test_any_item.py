"""Children of Items under any name are items, in their order."""

from __future__ import annotations

import pytest

from basketlake.functions import text
from basketlake.sources import documents

NAME = "PriceFull7290027600007-001-001-20260722-030000.gz"


def codes(spark, content):
    df = spark.createDataFrame([(NAME, content)], "source_file string, content string")
    parsed = documents.parse_documents(df, text.PRICE_FULL)
    return [(r["item_code"], r["item_price"]) for r in documents.price_rows(documents.usable(parsed, text.PRICE_FULL)).orderBy("position").collect()]


def one(tag, code, price="1.50"):
    return f"<{tag}><ItemCode>{code}</ItemCode><ItemPrice>{price}</ItemPrice></{tag}>"


def document(items, head="<Items Count='3'>"):
    return f"<Root><ChainID>1</ChainID><StoreID>2</StoreID>{head}{items}</Items></Root>"


@pytest.mark.parametrize(
    ("items", "want"),
    [
        (one("Item", "001") + one("Product", "002") + one("Item", "003"), ["001", "002", "003"]),
        (one("Product", "001") + one("Product", "002"), ["001", "002"]),
        (one("product", "001", " 7.90 ") + one("ITEM", "2") + one("Odd.Name-x", "3"), ["001", "2", "3"]),
        (one("Item", "1") + "<!-- a comment -->" + one("Item", "2"), ["1", "2"]),
        (one("Item", "1") + "<!-- a --> <!-- b -->" + one("Row", "2"), ["1", "2"]),
        ("<!-- first -->" + one("Row", "1") + one("Item", "2"), ["1", "2"]),
        ("\n  " + one("Item", "1") + "\n  " + one("Row", "2") + "\n", ["1", "2"]),
        (one("Item", "1") + "<Product/>" + one("Item", "2") + "<Note>text</Note>", ["1", None, "2", None]),
        (one("Item", "1"), ["1"]),
    ],
)
def test_every_child_is_an_item(spark, items, want):
    assert [c for c, _ in codes(spark, document(items))] == want


def test_values_stay_as_they_are(spark):
    assert codes(spark, document(one("Product", "007", " 7.90 "))) == [("007", " 7.90 ")]


def test_elements_of_items_keep_their_names(spark):
    items = "<Item><ItemCode>1</ItemCode><Details><Product>x</Product></Details><ItemPrice>2</ItemPrice></Item>" + one("Row", "2")
    assert codes(spark, document(items)) == [("1", "2"), ("2", "1.50")]

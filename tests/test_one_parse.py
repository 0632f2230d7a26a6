"""Price documents without items of other names are parsed once, and not searched for such items."""

from __future__ import annotations

from basketlake.functions import text
from basketlake.sources import documents


def test_other_names_come_from_the_parse(spark):
    docs = spark.createDataFrame([("PriceFull1-1-1-20260722-030000.gz", f"<Root><Items><Item><ItemCode>1</ItemCode></Item>{x}</Items></Root>") for x in ("", "<Product a='b'><ItemCode>2</ItemCode></Product><!-- <x> --><odd.name/>")], "source_file string, content string")
    parsed = documents.parse_documents(docs, text.PRICE_FULL)
    codes = parsed.selectExpr("transform(doc.Items.Item, i -> i.ItemCode) as c").collect()
    assert sorted(r["c"][:2] for r in codes) == [["1"], ["1", "2"]]
    assert "</Item" not in parsed._jdf.queryExecution().optimizedPlan().toString()

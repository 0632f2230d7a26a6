"""Checks of tables and batches. Each returns rows; the `validate` functions raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake import schemas

REQUIRED = ("item_code", "store_id", "extraction_date", "item_price")


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("rows"))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def duplicate_products(products: DataFrame) -> DataFrame:
    return duplicates(products, ["item_code"])


def duplicate_prices(prices: DataFrame, with_chain: bool = False) -> DataFrame:
    """By store, item and day, as the report counts them: equal ids of two chains show as duplicates. `with_chain`: by
    the table's whole key."""
    return duplicates(prices, schemas.KEYS["product_prices"] if with_chain else ["store_id", "item_code", "extraction_date"])


def orphan_prices(prices: DataFrame, products: DataFrame) -> DataFrame:
    """Prices whose item is in no product; a null item is in none."""
    return prices.join(products.select("item_code"), "item_code", "left_anti")


def missing_values(rows: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """One row, `rows`: how many lack a value in any of the columns. The chain is not among the required ones."""
    lacks = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
    return rows.agg(F.count_if(lacks).alias("rows"))


def require_values(lacking: int) -> None:
    if lacking:
        raise ValueError(f"{lacking} staged rows lack one of {', '.join(REQUIRED)}")


def validate_staging(staging: DataFrame) -> None:
    require_values(missing_values(staging).first()["rows"])


def validate_product_prices(prices: DataFrame, products: DataFrame) -> None:
    n = orphan_prices(prices, products).count()
    if n:
        raise ValueError(f"{n} prices have no product")


def quality_report(products: DataFrame, prices: DataFrame) -> DataFrame:
    """check, value: two row counts, two duplicate counts, orphans, prices without a required value. The prices are read
    once for what needs no grouping."""
    groups = lambda df: df.agg(F.count("*").alias("value"))
    lacks = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in REQUIRED))
    once = prices.agg(F.count("*").alias("prices"), F.count_if(lacks).alias("missing_values"))
    counted = once.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("value")) for n in ("prices", "missing_values")))))
    checks = {
        "products": groups(products),
        "duplicate_products": groups(duplicate_products(products)),
        "duplicate_prices": groups(duplicate_prices(prices)),
        "orphan_prices": groups(orphan_prices(prices, products)),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("check"), "value") for name, df in checks.items()), counted)


def check_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """table, violations: keys that occur more than once."""
    return _counts({t: duplicates(df, schemas.KEYS[t]) for t, df in tables.items() if t in schemas.KEYS})


def check_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, violations: nulls of each column that must have a value, in one pass over a table."""
    out = []
    for t, df in tables.items():
        if t in schemas.NOT_NULL:
            counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in schemas.NOT_NULL[t]))
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in schemas.NOT_NULL[t]))).alias("p")
            out.append(counts.select(F.lit(t).alias("table"), pairs).select("table", "p.column", "p.violations"))
    return reduce(DataFrame.unionByName, out)


def check_references(tables: dict[str, DataFrame]) -> DataFrame:
    """table, violations: child rows without their parent; a row with a null in the columns refers to nothing."""
    out = {}
    for child, columns, parent in schemas.REFERENCES:
        if child in tables and parent in tables:
            out[child] = tables[child].dropna(subset=columns).join(tables[parent].select(*columns), columns, "left_anti")
    return _counts(out)


def _counts(found: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("violations")).select(F.lit(t).alias("table"), "violations") for t, df in found.items()))

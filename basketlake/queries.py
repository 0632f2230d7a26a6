"""The engine's operators as queries on the driver's tables, each with the SQL that it is held against.

There is no grocery data among the tables, so orders and lines stand in for price files: `observations` has the shape of
staged prices, with many colliding keys. All queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.functions import text
from basketlake.operators import quality
from basketlake.operators.coerce import cast_to_table, with_keys, without_keys_count
from basketlake.operators.latest import first_per_key, latest_daily_snapshots, latest_prices, latest_products, newest_first
from basketlake.operators.upsert import merge_batch, upsert
from basketlake.plans import jobs
from basketlake.sources import documents, landing
from basketlake.sources.tables import Tables, drop_empty_columns, work_folder
from basketlake.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        name = f.__name__.removesuffix("_query")
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Order lines, all or some, and their parts in the shape of staged prices."""
    lines = (table(spark, sf_dir, "lineitem") if lines is None else lines).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    given = {
        "item_code": "l_partkey", "item_name": "p_name", "manufacture_name": "p_brand", "manufacture_country": "nullif(p_brand, 'Brand#11')",
        "manufacture_item_description": "p_type", "unit_qty": "l_returnflag", "quantity": "cast(l_quantity as decimal(38,10))",
        "unit_of_measure": "l_linestatus", "is_weighted": "l_linestatus = 'O'", "qty_in_package": "p_size",
        "item_price": "cast(l_extendedprice as decimal(10,2))", "unit_of_measure_price": "cast(p_retailprice as decimal(10,2))",
        "allow_discount": "l_discount > 0", "item_status": "l_linenumber", "price_update_time": "cast(l_shipdate as timestamp_ntz)",
        "last_sale_date_time": "cast(null as timestamp_ntz)", "item_type": "l_linenumber % 2", "store_id": "cast(l_suppkey % 5 as int)",
        "chain_id": "l_suppkey % 3", "sub_chain_id": "1", "extraction_date": "make_date(year(l_shipdate), 1, 1)",
        "source_file": "concat('PriceFull', cast(l_suppkey % 3 as string), '-001-', lpad(cast(l_suppkey % 5 as string), 3, '0'), '-', date_format(l_shipdate, 'yyyyMMdd'), '-', lpad(cast(l_orderkey as string), 9, '0'), '.gz')",
    }
    return lines.select(*(F.expr(e).alias(c) for c, e in given.items()), F.col("l_orderkey").alias("order_key"))


def newest_observations(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Each item's observations of its newest day. The days are found by numbers alone, so that of all other lines no
    wide rows are made and sorted."""
    lines, day = table(spark, sf_dir, "lineitem").where(where), F.year("l_shipdate")
    last = F.when(~F.max(day.isNull()), F.max(day))  # a null day is the first in order
    newest = lines.groupBy(F.col("l_partkey").alias("part")).agg(last.alias("newest"))
    of_newest = (F.col("l_partkey") == F.col("part")) & day.eqNullSafe(F.col("newest"))
    return observations(spark, sf_dir, lines.join(newest.hint("shuffle_hash"), of_newest, "left_semi"))


OBS = """obs AS (SELECT l_partkey AS item_code, p_name AS item_name, p_brand AS manufacture_name, nullif(p_brand, 'Brand#11') AS manufacture_country,
  p_type AS manufacture_item_description, l_returnflag AS unit_qty, l_quantity AS quantity, l_linestatus AS unit_of_measure, l_linestatus = 'O' AS is_weighted,
  p_size AS qty_in_package, CAST(l_extendedprice AS DECIMAL(10,2)) AS item_price, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_of_measure_price,
  l_discount > 0 AS allow_discount, l_linenumber AS item_status, l_shipdate AS price_update_time, CAST(NULL AS TIMESTAMP) AS last_sale_date_time,
  l_linenumber % 2 AS item_type, CAST(l_suppkey % 5 AS INT) AS store_id, l_suppkey % 3 AS chain_id, 1 AS sub_chain_id, make_date(year(l_shipdate), 1, 1) AS extraction_date,
  'PriceFull' || (l_suppkey % 3) || '-001-' || lpad(CAST(l_suppkey % 5 AS VARCHAR), 3, '0') || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '.gz' AS source_file,
  l_orderkey AS order_key FROM lineitem JOIN part ON l_partkey = p_partkey)"""
DESC = " DESC NULLS FIRST"


def _by(columns: list[str]) -> str:
    return ", ".join(c + DESC for c in columns)


PRODUCT_REST = [c for c in schemas.PRODUCTS if c != "item_code"]
PRODUCT_ORDER = _by(["extraction_date", "source_file", *PRODUCT_REST])
PRICE_REST = [c for c in schemas.PRICES if c != "source_file"]
PRICE_ORDER = _by(["source_file", *PRICE_REST])
PRICE_KEY = "chain_id, store_id, item_code, extraction_date"
PRODUCT_OUT = "item_code, item_name, manufacture_name, manufacture_country, manufacture_item_description, unit_qty, CAST(quantity AS DECIMAL(12,2)) AS quantity, unit_of_measure, is_weighted, qty_in_package, item_type"
PRICE_OUT = "item_code, store_id, item_price, unit_of_measure_price, item_status, allow_discount, chain_id, sub_chain_id, source_file, extraction_date"


def _top(name: str, source: str, keys: str, order: str, where: str = "true") -> str:
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


@query(f"WITH {OBS}, {_top('top', 'obs', 'item_code', PRODUCT_ORDER)} SELECT {PRODUCT_OUT} FROM top")
def latest_products_query(spark, sf_dir):
    return latest_products(newest_observations(spark, sf_dir)).selectExpr(*_columns(PRODUCT_OUT))


def _columns(listed: str) -> list[str]:
    """Expressions of a select list without nested commas outside brackets."""
    out, depth, now = [], 0, ""
    for c in listed:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


@query(f"WITH {OBS}, {_top('top', 'obs', PRICE_KEY, PRICE_ORDER)} SELECT {PRICE_OUT} FROM top")
def latest_prices_query(spark, sf_dir):
    return latest_prices(observations(spark, sf_dir)).selectExpr(*_columns(PRICE_OUT))


HALVES = f"{OBS}, {_top('old', 'obs', 'item_code', PRODUCT_ORDER, 'order_key % 2 = 0')}, {_top('new', 'obs', 'item_code', PRODUCT_ORDER, 'order_key % 2 = 1')}"


def _product_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two batches that together have all observations: what is there, and what comes in."""
    even, odd = (newest_observations(spark, sf_dir, f"l_orderkey % 2 = {i}") for i in (0, 1))
    return latest_products(even), latest_products(odd)


@query(f"WITH {HALVES} SELECT {PRODUCT_OUT} FROM old WHERE item_code NOT IN (SELECT item_code FROM new) UNION ALL SELECT {PRODUCT_OUT} FROM new")
def upsert_products_update(spark, sf_dir):
    old, new = _product_halves(spark, sf_dir)
    return upsert(old, new, ["item_code"]).selectExpr(*_columns(PRODUCT_OUT))


@query(f"WITH {HALVES} SELECT {PRODUCT_OUT} FROM old UNION ALL SELECT {PRODUCT_OUT} FROM new WHERE item_code NOT IN (SELECT item_code FROM old)")
def upsert_products_ignore(spark, sf_dir):
    old, new = _product_halves(spark, sf_dir)
    return upsert(old, new, ["item_code"], "ignore").selectExpr(*_columns(PRODUCT_OUT))


PRICE_HALVES = f"{OBS}, {_top('old', 'obs', PRICE_KEY, PRICE_ORDER, 'order_key % 2 = 0')}, {_top('new', 'obs', PRICE_KEY, PRICE_ORDER, 'order_key % 2 = 1')}"
SAME_PRICE_KEY = " AND ".join(f"new.{k} = old.{k}" for k in schemas.KEYS["product_prices"])


@query(f"WITH {PRICE_HALVES} SELECT {PRICE_OUT} FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE {SAME_PRICE_KEY}) UNION ALL SELECT {PRICE_OUT} FROM new")
def upsert_prices(spark, sf_dir):
    obs = observations(spark, sf_dir)
    old, batch = latest_prices(obs.where("order_key % 2 = 0")), obs.where("order_key % 2 = 1").select(*schemas.PRICES)
    return merge_batch(old, batch, "product_prices", ["source_file"]).selectExpr(*_columns(PRICE_OUT))


def store_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores; stores repeat within a batch, and every tenth has no chain."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(
        "if(s_suppkey % 10 = 0, null, cast(n_regionkey as bigint)) as chain_id", "cast(s_nationkey as int) as store_id", "concat('chain ', cast(n_regionkey as string)) as chain_name",
        "cast(s_suppkey % 4 as int) as sub_chain_id", "cast(null as string) as sub_chain_name", "1 as bikoret_no", "1 as store_type", "s_name as store_name", "n_name as address", "cast(null as string) as city",
        "cast(null as string) as zip_code", "concat('Stores-', lpad(cast(s_suppkey % 7 as string), 3, '0')) as source_file", "date'2026-01-01' as extraction_date", "s_suppkey as position",
    )


STORE_BATCH = """b AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS chain_id, CAST(s_nationkey AS INT) AS store_id, 'chain ' || n_regionkey AS chain_name,
  CAST(s_suppkey % 4 AS INT) AS sub_chain_id, s_name AS store_name, n_name AS address, 'Stores-' || lpad(CAST(s_suppkey % 7 AS VARCHAR), 3, '0') AS source_file, s_suppkey AS position
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
STORE_OUT = "chain_id, store_id, chain_name, sub_chain_id, store_name, address, source_file"
STORE_KNOWN = "chain_id IS NOT NULL AND store_id IS NOT NULL"


@query(
    f"WITH {STORE_BATCH}, {_top('old', 'b', 'chain_id, store_id', 'source_file DESC, position DESC', f'{STORE_KNOWN} AND position % 2 = 0')}, {_top('new', 'b', 'chain_id, store_id', 'source_file DESC, position DESC', f'{STORE_KNOWN} AND position % 2 = 1')} "
    f"SELECT {STORE_OUT} FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.chain_id = old.chain_id AND new.store_id = old.store_id) UNION ALL SELECT {STORE_OUT} FROM new"
)
def upsert_stores(spark, sf_dir):
    batch = store_batch(spark, sf_dir)
    empty = batch.select(*schemas.STORES).where("false")
    old = merge_batch(empty, batch.where("position % 2 = 0"), "stores", ["source_file", "position"])
    return merge_batch(old, batch.where("position % 2 = 1"), "stores", ["source_file", "position"]).selectExpr(*_columns(STORE_OUT))


@query(f"WITH {STORE_BATCH} SELECT count(*) FILTER (chain_id IS NULL OR store_id IS NULL) AS dropped FROM b")
def stores_without_keys(spark, sf_dir):
    return without_keys_count(store_batch(spark, sf_dir), ["chain_id", "store_id"])


def _small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("item_code"))


@query("SELECT count(*) AS rows FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey WHERE p_partkey IS NULL")
def orphan_prices(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_code"))
    return quality.row_count(quality.orphan_prices(prices, _small_parts(spark, sf_dir)))


@query(f"WITH {OBS} SELECT item_code, count(*) AS rows FROM obs GROUP BY 1 HAVING count(*) > 1")
def duplicate_products(spark, sf_dir):
    return quality.duplicate_products(observations(spark, sf_dir))


@query(f"WITH {OBS} SELECT store_id, item_code, extraction_date, count(*) AS rows FROM obs GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_prices(spark, sf_dir):
    return quality.duplicate_prices(observations(spark, sf_dir))


@query(f"WITH {OBS} SELECT {PRICE_KEY}, count(*) AS rows FROM obs GROUP BY {PRICE_KEY} HAVING count(*) > 1")
def duplicate_prices_by_key(spark, sf_dir):
    return quality.duplicate_prices(observations(spark, sf_dir), with_chain=True)


@query(f"WITH {OBS} SELECT count(*) FILTER (nullif(item_code, 7) IS NULL OR nullif(store_id, 3) IS NULL OR extraction_date IS NULL OR nullif(item_price, 100) IS NULL) AS rows FROM obs")
def missing_values(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return quality.missing_values(obs.withColumns({"item_code": F.nullif("item_code", F.lit(7)), "store_id": F.nullif("store_id", F.lit(3)), "item_price": F.nullif("item_price", F.lit(100))}))


@query(
    f"WITH {OBS}, p AS (SELECT p_partkey AS item_code FROM part WHERE p_size <= 25), f AS (SELECT nullif(item_code, 7) AS item_code, store_id, chain_id, extraction_date, item_price FROM obs) "
    "SELECT 'products' AS \"check\", count(*) AS value FROM p UNION ALL SELECT 'prices', count(*) FROM f UNION ALL SELECT 'duplicate_products', count(*) FROM (SELECT 1 FROM p GROUP BY item_code HAVING count(*) > 1) "
    "UNION ALL SELECT 'duplicate_prices', count(*) FROM (SELECT 1 FROM f GROUP BY store_id, item_code, extraction_date HAVING count(*) > 1) "
    "UNION ALL SELECT 'orphan_prices', count(*) FROM f LEFT JOIN p USING (item_code) WHERE p.item_code IS NULL UNION ALL SELECT 'missing_values', count(*) FILTER (item_code IS NULL OR store_id IS NULL OR extraction_date IS NULL OR item_price IS NULL) FROM f"
)
def quality_report(spark, sf_dir):
    prices = observations(spark, sf_dir).withColumn("item_code", F.nullif("item_code", F.lit(7)))
    return quality.quality_report(_small_parts(spark, sf_dir), prices)


def _checked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    obs = observations(spark, sf_dir)
    return {"products": _small_parts(spark, sf_dir), "product_prices": obs.withColumn("store_id", F.nullif("store_id", F.lit(3)))}


@query(f"WITH {OBS}, f AS (SELECT chain_id, nullif(store_id, 3) AS store_id, item_code, extraction_date FROM obs) SELECT 'products' AS \"table\", count(*) AS violations FROM (SELECT 1 FROM part WHERE p_size <= 25 GROUP BY p_partkey HAVING count(*) > 1) UNION ALL SELECT 'product_prices', count(*) FROM (SELECT 1 FROM f GROUP BY {PRICE_KEY} HAVING count(*) > 1)")
def check_keys(spark, sf_dir):
    return quality.check_keys(_checked(spark, sf_dir))


@query(f"WITH {OBS} SELECT 'products' AS \"table\", 'item_code' AS \"column\", count(*) FILTER (p_partkey IS NULL) AS violations FROM part WHERE p_size <= 25 UNION ALL SELECT 'product_prices', 'chain_id', count(*) FILTER (chain_id IS NULL) FROM obs UNION ALL SELECT 'product_prices', 'store_id', count(*) FILTER (nullif(store_id, 3) IS NULL) FROM obs UNION ALL SELECT 'product_prices', 'item_code', count(*) FILTER (item_code IS NULL) FROM obs UNION ALL SELECT 'product_prices', 'extraction_date', count(*) FILTER (extraction_date IS NULL) FROM obs")
def check_not_null(spark, sf_dir):
    return quality.check_not_null(_checked(spark, sf_dir))


@query("SELECT 'product_prices' AS \"table\", count(*) AS violations FROM lineitem JOIN part a ON l_partkey = a.p_partkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) b ON l_partkey = b.p_partkey WHERE b.p_partkey IS NULL")
def check_references(spark, sf_dir):
    return quality.check_references(_checked(spark, sf_dir))


# file names of the three feeds, with wrong endings, short names, packed times and impossible days among them
NAMES_SPARK = """case o_orderkey % 6
  when 0 then concat('PriceFull7290027600007-001-', lpad(cast(o_custkey % 50 as string), 3, '0'), '-', date_format(o_orderdate, 'yyyyMMdd'), '-', lpad(cast(o_orderkey % 240000 as string), 6, '0'), '.gz')
  when 1 then concat('pricefull7290027600007-001-', cast(o_custkey % 50 as string), '-', date_format(o_orderdate, 'yyyy'), '13', lpad(cast(o_orderkey % 40 as string), 2, '0'), '-010203.GZ')
  when 2 then concat('Stores7290027600007-000-', date_format(o_orderdate, 'yyyyMMdd'), lpad(cast(o_orderkey % 240000 as string), 6, '0'), '-', cast(o_custkey as string), '.xml')
  when 3 then concat('PromoFull7290058140886-001-', lpad(cast(o_custkey % 60 as string), 3, '0'), '-', date_format(o_orderdate, 'yyyyMMdd'), '-030000.gz')
  when 4 then concat('PriceFull7290027600007-', date_format(o_orderdate, 'yyyyMMdd'), '.gz')
  else concat('PriceFull7290027600007-001-002-', date_format(o_orderdate, 'yyyyMMdd'), '-030000.xml') end"""
NAMES_DUCK = """CASE o_orderkey % 6
  WHEN 0 THEN 'PriceFull7290027600007-001-' || lpad(CAST(o_custkey % 50 AS VARCHAR), 3, '0') || '-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') || '.gz'
  WHEN 1 THEN 'pricefull7290027600007-001-' || (o_custkey % 50) || '-' || strftime(o_orderdate, '%Y') || '13' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') || '-010203.GZ'
  WHEN 2 THEN 'Stores7290027600007-000-' || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') || '-' || o_custkey || '.xml'
  WHEN 3 THEN 'PromoFull7290058140886-001-' || lpad(CAST(o_custkey % 60 AS VARCHAR), 3, '0') || '-' || strftime(o_orderdate, '%Y%m%d') || '-030000.gz'
  WHEN 4 THEN 'PriceFull7290027600007-' || strftime(o_orderdate, '%Y%m%d') || '.gz'
  ELSE 'PriceFull7290027600007-001-002-' || strftime(o_orderdate, '%Y%m%d') || '-030000.xml' END"""
PARTS_DUCK = f"""n AS (SELECT o_orderkey, {NAMES_DUCK} AS name FROM orders),
p AS (SELECT o_orderkey, name, lower(name) AS low, string_split(left(name, len(name) - CASE WHEN lower(name) LIKE '%.gz' THEN 3 ELSE 4 END), '-') AS q FROM n),
s AS (SELECT o_orderkey, name, q, CASE WHEN low LIKE 'pricefull%.gz' AND len(q) >= 5 THEN 'price' WHEN low LIKE 'stores%' AND len(q) >= 4 THEN 'stores' WHEN low LIKE 'promofull%.gz' AND len(q) >= 5 THEN 'promo' END AS kind FROM p)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(NAMES_SPARK).alias("name"))


@query(
    f"WITH {PARTS_DUCK} SELECT o_orderkey, name, CASE WHEN kind IS NOT NULL THEN q[-3] END AS store_id, CASE WHEN kind IS NOT NULL THEN q[-2] END AS date, CASE WHEN kind IS NOT NULL THEN q[-1] END AS time, "
    "CASE WHEN kind = 'price' AND len(q[-2]) = 8 OR kind IN ('stores', 'promo') THEN CAST(try_strptime(left(q[-2], 8), '%Y%m%d') AS DATE) END AS day, coalesce(kind = 'promo' AND ltrim(q[-3], '0') = '39', false) AS excluded FROM s"
)
def snapshot_names(spark, sf_dir):
    name = F.col("name")
    feeds = (text.PRICE_FULL, text.STORES, text.PROMO_FULL)
    found = [text.snapshot_of(name, f) for f in feeds]
    days = F.coalesce(*(F.when(s.isNotNull(), text.day_of(name, f)) for f, s in zip(feeds, found, strict=True)))
    return names(spark, sf_dir).withColumns({"s": F.coalesce(*found), "day": days, "excluded": text.is_excluded_file(name)}).select("o_orderkey", "name", "s.store_id", "s.date", "s.time", "day", "excluded")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots: a user is a store."""
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as store_id", "date_format(ts, 'yyyyMMdd') as date", "date_format(ts, 'HHmmss') as time", "event_id as position", "event_type as payload")


SNAPSHOTS = "s AS (SELECT CAST(user_id AS VARCHAR) AS store_id, strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H%M%S') AS time, event_id AS position, event_type AS payload FROM events)"
NEWEST = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY time DESC, position) AS rn FROM {0} WHERE date = (SELECT max(date) FROM {0})) WHERE rn = 1)"


@query(f"WITH {SNAPSHOTS} SELECT * FROM {NEWEST.format('s')}")
def latest_snapshots(spark, sf_dir):
    return latest_daily_snapshots(snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOTS} SELECT * FROM {NEWEST.format('s')} ORDER BY store_id LIMIT 3")
def latest_snapshots_capped(spark, sf_dir):
    return latest_daily_snapshots(snapshots(spark, sf_dir), landing.TRIAL_FILES)


@query(f"WITH {SNAPSHOTS}, x AS (SELECT * FROM s WHERE ltrim(store_id, '0') <> '39') SELECT * FROM {NEWEST.format('x')}")
def latest_snapshots_without_store(spark, sf_dir):
    return latest_daily_snapshots(snapshots(spark, sf_dir).where(~text.is_excluded_store(F.col("store_id"))))


@query(
    f"WITH {PARTS_DUCK}, x AS (SELECT q[-3] AS store_id, q[-2] AS date, q[-1] AS time, o_orderkey AS position, name AS payload FROM s WHERE kind = 'promo' AND ltrim(q[-3], '0') <> '39') SELECT * FROM {NEWEST.format('x')}"
)
def promotion_name_snapshots(spark, sf_dir):
    listed = names(spark, sf_dir).withColumnRenamed("o_orderkey", "position")
    return latest_daily_snapshots(landing.snapshots_of_names(listed, text.PROMO_FULL, text.EXCLUDED_CHAIN, text.EXCLUDED_STORE))


@query(
    "WITH m AS (SELECT event_id AS position, event_type || '.gz' AS payload, CASE WHEN user_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS store_id, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events WHERE event_id % 2 = 0), "
    f"x AS (SELECT store_id, string_split(t, ' ')[1] AS date, string_split(t, ' ')[2] AS time, position, payload FROM m WHERE store_id IS NOT NULL AND contains(t, ' ')) SELECT * FROM {NEWEST.format('x')}"
)
def manifest_snapshots(spark, sf_dir):
    """A JSON listing made from events, read back with the listing's schema."""
    entries = table(spark, sf_dir, "events").selectExpr(
        "event_id as position",
        "to_json(named_struct('fileType', if(event_id % 2 = 0, 'PriceFull', 'Promo'), 'fileName', concat(event_type, '.gz'), 'fileDate', if(event_id % 5 = 0, date_format(ts, 'yyyy-MM-dd'), date_format(ts, 'yyyy-MM-dd HH:mm:ss')), 'branchNumber', if(user_id % 7 <> 0, user_id, null))) as j",
    )
    listed = entries.select("position", F.from_json("j", landing.MANIFEST).alias("e")).select("position", "e.*")
    return latest_daily_snapshots(landing.snapshots_of_manifest(landing.wanted_entries(listed, "pricefull")))


BASE = "https://feeds.example.org/files/list"
LINKS_DUCK = """l AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1), 1) - 1 AS position FROM pages),
u AS (SELECT page, CAST(position AS INT) AS position, replace(href, '&amp;', '&') AS href FROM l),
links AS (SELECT page, position, href, CASE WHEN href LIKE '/%' THEN 'https://feeds.example.org' || href WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE 'https://feeds.example.org/files/' || href END AS url FROM u)"""


def _links(spark: SparkSession, sf_dir: str, token: str = "") -> DataFrame:
    return landing.extract_links(table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "html"), BASE, token)


@query(f"WITH {LINKS_DUCK} SELECT page, position, href, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file_name FROM links WHERE contains(lower(href), 'th')")
def links_from_pages(spark, sf_dir):
    return _links(spark, sf_dir, "TH").withColumn("file_name", text.file_name_of(F.col("url")))


@query(
    f"WITH {LINKS_DUCK}, n AS (SELECT page, position, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file_name FROM links), "
    "f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY page, position, url) AS rn FROM n) WHERE rn = 1), "
    "w AS (SELECT page_id AS page, count(f.page) AS fresh FROM pages LEFT JOIN f ON f.page = page_id WHERE page_id >= (SELECT min(page) FROM n) GROUP BY 1), g AS (SELECT page, min(CASE WHEN fresh > 0 THEN 1 ELSE 0 END) OVER (ORDER BY page ROWS UNBOUNDED PRECEDING) AS open FROM w) "
    "SELECT page, position, url, file_name FROM f JOIN g USING (page) WHERE open = 1"
)
def links_until_stop(spark, sf_dir):
    return landing.new_links(_links(spark, sf_dir).select("page", "position", "url"))


@query(
    f"WITH {LINKS_DUCK}, n AS (SELECT page, position, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file_name FROM links WHERE page < 2), "
    "f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY page, position, url) AS rn FROM n) WHERE rn = 1) SELECT page, position, url, file_name FROM f WHERE page = (SELECT min(page) FROM n) OR (SELECT count(DISTINCT page) FROM f) = 2"
)
def links_of_first_pages(spark, sf_dir):
    return landing.new_links(_links(spark, sf_dir).select("page", "position", "url"), max_pages=landing.TRIAL_PAGES - 1)


def _element(tag: str, fields: dict[str, Column]) -> Column:
    return F.concat(F.lit(f"<{tag}>"), _elements(fields), F.lit(f"</{tag}>"))


def _elements(fields: dict[str, Column]) -> Column:
    """An element for each value that is not null. Values are numbers, flags and names."""
    escaped = lambda c: F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(*(F.coalesce(F.concat(F.lit(f"<{t}>"), escaped(c), F.lit(f"</{t}>")), F.lit("")) for t, c in fields.items()))


def _joined(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces `xml` of each key as one text, `items`."""
    return lines.groupBy(*keys).agg(F.array_join(F.collect_list("xml"), "").alias("items"))


def _root(header: dict[str, Column], tag: str) -> Column:
    return F.concat(F.lit("<Root>"), _elements(header), F.lit(f"<{tag}>"), "items", F.lit(f"</{tag}></Root>"))


def _in_rows(lines: DataFrame, keys: list[str], head: Column, end: Column) -> DataFrame:
    """Documents in rows: what stands before the lines (`content`) of each key, the lines, and what stands after them."""
    around = lines.select(*keys).distinct().withColumn("part", F.explode(F.array(F.struct(F.lit(0).alias("place"), head.alias("content")), F.struct(F.lit(2).alias("place"), end.alias("content")))))
    return around.select(*keys, "part.*").unionByName(lines.withColumn("place", F.lit(1)))


def _price_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a price document, its lines as items."""
    docs = _joined(table(spark, sf_dir, "lineitem").select("l_orderkey", _element("Item", _price_item()).alias("xml")), ["l_orderkey"])
    root = _root({"StoreID": F.col("l_orderkey") % 5, "ChainID": F.lit("7290027600007"), "SubChainID": F.lit("001")}, "Items")
    name = F.concat(F.lit("PriceFull7290027600007-001-001-20260722-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit(".gz"))
    return docs.select(name.alias("source_file"), root.alias("content"))


def _price_item() -> dict[str, Column]:
    quantity = F.when(F.col("l_linenumber") % 3 == 0, text.UNKNOWN).when(F.col("l_linenumber") % 3 == 1, " 6 ").otherwise("")
    given = {"ItemCode": F.col("l_partkey"), "ItemName": F.col("l_returnflag"), "bIsWeighted": F.when(F.col("l_linenumber") % 2 == 0, "1"), "IsWeighted": F.lit("0")}
    return given | {"QtyInPackage": quantity, "ItemPrice": F.col("l_extendedprice").cast("decimal(12,2)"), "ItemStatus": F.col("l_linestatus")}


PRICE_DOCUMENTS_SQL = (
    "SELECT CAST(l_partkey AS VARCHAR) AS item_code, l_returnflag AS item_name, CASE WHEN l_linenumber % 2 = 0 THEN '1' ELSE '0' END AS is_weighted, CASE WHEN l_linenumber % 3 = 1 THEN '6' END AS qty_in_package, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS item_price, "
    "l_linestatus AS item_status, CAST(l_orderkey % 5 AS VARCHAR) AS store_id, '7290027600007' AS chain_id, '001' AS sub_chain_id, 'PriceFull7290027600007-001-001-20260722-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '.gz' AS source_file, '2026-07-22' AS extraction_date FROM lineitem"
)
PRICE_DOCUMENT_COLUMNS = ("item_code", "item_name", "is_weighted", "qty_in_package", "item_price", "item_status", "store_id", "chain_id", "sub_chain_id", "source_file", "extraction_date")


@query(PRICE_DOCUMENTS_SQL)
def price_documents(spark, sf_dir):
    parsed = documents.usable(documents.parse_documents(_price_xml(spark, sf_dir), text.PRICE_FULL), text.PRICE_FULL)
    return documents.price_rows(parsed).select(*PRICE_DOCUMENT_COLUMNS)


@query(PRICE_DOCUMENTS_SQL)
def items_of_any_name(spark, sf_dir):
    """The same documents with every second item under another name, and comments between items."""
    named = F.when(F.col("l_linenumber") % 2 == 0, _element("Product", _price_item())).otherwise(F.concat(_element("Item", _price_item()), F.lit("<!-- next -->")))
    docs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", named.alias("xml")).alias("item")).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("item"))["xml"], "").alias("items"))
    head = F.concat(F.lit("<Root><StoreID>"), (F.col("l_orderkey") % 5).cast("string"), F.lit("</StoreID><ChainID>7290027600007</ChainID><SubChainID>001</SubChainID><Items>"))
    name = F.concat(F.lit("PriceFull7290027600007-001-001-20260722-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit(".gz"))
    parsed = documents.parse_documents(docs.select(name.alias("source_file"), F.concat(head, "items", F.lit("</Items></Root>")).alias("content")), text.PRICE_FULL)
    return documents.price_rows(documents.usable(parsed, text.PRICE_FULL)).select(*PRICE_DOCUMENT_COLUMNS)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS chain_id, r_name AS chain_name, CAST(n_nationkey AS VARCHAR) AS sub_chain_id, n_name AS sub_chain_name, CAST(s_suppkey AS VARCHAR) AS store_id, CASE WHEN s_suppkey % 2 = 0 THEN '1' END AS store_type, s_name AS store_name, ' ' || s_name || ' ' AS address, '2026-08-16' AS extraction_date FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def store_documents(spark, sf_dir):
    """Regions as chains, nations as sub-chains, suppliers as stores."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    store = F.struct(F.col("s_suppkey").cast("string").alias("StoreID"), F.when(F.col("s_suppkey") % 2 == 0, " 1 ").otherwise("").alias("StoreType"), F.col("s_name").alias("StoreName"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("Address"))
    nations = joined.groupBy("r_regionkey", "r_name", "n_nationkey", "n_name").agg(F.collect_list(store).alias("stores"))
    sub = F.struct(F.col("n_nationkey").cast("string").alias("SubChainID"), F.col("n_name").alias("SubChainName"), F.struct(F.col("stores").alias("Store")).alias("Stores"))
    chains = nations.groupBy("r_regionkey", "r_name").agg(F.collect_list(sub).alias("subs"))
    root = F.struct(F.col("r_regionkey").cast("string").alias("ChainID"), F.col("r_name").alias("ChainName"), F.struct(F.col("subs").alias("SubChain")).alias("SubChains"))
    docs = chains.select(F.concat(F.lit("Stores"), F.col("r_regionkey").cast("string"), F.lit("-000-20260816060100-060100.xml")).alias("source_file"), F.to_xml(root, {"rowTag": "Root"}).alias("content"))
    parsed = documents.usable(documents.parse_documents(docs, text.STORES), text.STORES)
    return documents.store_rows(parsed).select("chain_id", "chain_name", "sub_chain_id", "sub_chain_name", "store_id", "store_type", "store_name", "address", "extraction_date")


def _group(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("<Group>"), _elements(fields), F.lit("<PromotionItems>"), "items", F.lit("</PromotionItems></Group>"))


def _promotion_root(header: dict[str, Column], promotion: dict[str, Column]) -> Column:
    """A document of one promotion with the groups `items`."""
    groups = F.concat(F.lit("<Groups>"), F.coalesce("items", F.lit("")), F.lit("</Groups>"))
    return F.concat(F.lit("<Root>"), _elements(header), F.lit("<Promotions><Promotion>"), _elements(promotion), groups, F.lit("</Promotion></Promotions></Root>"))


def _promotion_layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as promotions, their lines by return flag as groups, lines as items; every seventh group has no id."""
    lines = table(spark, sf_dir, "lineitem")
    item = {"ItemCode": F.col("l_partkey"), "ItemType": F.col("l_linenumber"), "MinQty": F.col("l_quantity").cast("decimal(12,2)"), "RewardType": F.lit("  ")}
    groups = _joined(lines.select("l_orderkey", "l_returnflag", _element("PromotionItem", item).alias("xml")), ["l_orderkey", "l_returnflag"])
    group = _group({"GroupID": F.when(F.col("l_orderkey") % 7 == 0, " ").otherwise(F.col("l_returnflag")), "DiscountType": F.lit(" 2 ")})
    promos = table(spark, sf_dir, "orders").join(_joined(groups.select("l_orderkey", group.alias("xml")), ["l_orderkey"]), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    root = _promotion_root({"ChainID": F.lit("7290027600007"), "SubChainID": F.lit("1"), "StoreID": F.col("o_custkey") % 9}, {"PromotionID": F.col("o_orderkey"), "PromotionDescription": F.col("o_orderpriority"), "ClubID": F.lit("")})
    name = F.concat(F.lit("PromoFull7290027600007-001-001-20260816-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".gz"))
    docs = promos.select(name.alias("source_file"), root.alias("content"))
    parsed = documents.usable(documents.parse_documents(docs, text.PROMO_FULL), text.PROMO_FULL)
    return documents.flatten_promotions(documents.promotion_trees(parsed))


PROMO = "'7290027600007' AS chain_id, CAST(o_custkey % 9 AS VARCHAR) AS store_id, CAST(o_orderkey AS VARCHAR) AS promotion_id, '2026-08-16' AS extraction_date"


@query(f"SELECT {PROMO}, o_orderpriority AS promotion_description, CAST(NULL AS VARCHAR) AS club_id FROM orders")
def promotion_tree_promotions(spark, sf_dir):
    return _promotion_layers(spark, sf_dir)[0].select("chain_id", "store_id", "promotion_id", "extraction_date", "promotion_description", "club_id")


@query(f"SELECT DISTINCT {PROMO}, l_returnflag AS group_id, '2' AS discount_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> 0")
def promotion_tree_groups(spark, sf_dir):
    return _promotion_layers(spark, sf_dir)[1].select("chain_id", "store_id", "promotion_id", "extraction_date", "group_id", "discount_type")


@query(f"SELECT {PROMO}, l_returnflag AS group_id, CAST(l_partkey AS VARCHAR) AS item_code, CAST(l_linenumber AS VARCHAR) AS item_type, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) AS min_qty, CAST(NULL AS VARCHAR) AS reward_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> 0")
def promotion_tree_items(spark, sf_dir):
    return _promotion_layers(spark, sf_dir)[2].select("chain_id", "store_id", "promotion_id", "extraction_date", "group_id", "item_code", "item_type", "min_qty", "reward_type")


PROMO_BATCH = """b AS (SELECT CAST(o_custkey % 9 AS BIGINT) AS chain_id, CAST(o_custkey % 4 AS INT) AS store_id, CAST(o_orderkey % 500 AS VARCHAR) AS promotion_id, make_date(year(o_orderdate), 1, 1) AS extraction_date,
  l_returnflag AS group_id, l_partkey % 40 AS item_code, l_linenumber AS item_type, o_orderpriority AS remarks, o_orderkey AS position, l_linenumber AS place, CAST(l_quantity AS DECIMAL(12,2)) AS min_qty, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
PROMO_SPARK = [
    "cast(o_custkey % 9 as bigint) as chain_id", "cast(o_custkey % 4 as int) as store_id", "cast(o_orderkey % 500 as string) as promotion_id", "make_date(year(o_orderdate), 1, 1) as extraction_date", "l_returnflag as group_id",
    "l_partkey % 40 as item_code", "l_linenumber as item_type", "o_orderpriority as remarks", "o_orderkey as position", "l_linenumber as place", "cast(l_quantity as decimal(12,2)) as min_qty", "l_partkey as part",
]


def _promotion_upsert(spark: SparkSession, sf_dir: str, name: str, values: list[str]) -> DataFrame:
    """Two halves of a batch of promotions merged one after the other."""
    batch = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(*PROMO_SPARK)
    columns = [*schemas.KEYS[name], *values]
    order = ["position", "place", "min_qty", "part", "group_id", "item_code", "item_type", "remarks"]
    empty = batch.select(*columns).where("false")
    old = merge_batch(empty, batch.where("part % 2 = 0"), name, order)
    return merge_batch(old, batch.where("part % 2 = 1"), name, order)


def _promotion_sql(name: str, values: list[str]) -> str:
    keys = ", ".join(schemas.KEYS[name])
    out = ", ".join([*schemas.KEYS[name], *values])
    order = _by(["position", "place", "min_qty", "part", "group_id", "item_code", "item_type", "remarks"])
    same = " AND ".join(f"new.{k} = old.{k}" for k in schemas.KEYS[name])
    return f"WITH {PROMO_BATCH}, {_top('old', 'b', keys, order, 'part % 2 = 0')}, {_top('new', 'b', keys, order, 'part % 2 = 1')} SELECT {out} FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE {same}) UNION ALL SELECT {out} FROM new"


@query(_promotion_sql("promotions", ["remarks"]))
def upsert_promotions(spark, sf_dir):
    return _promotion_upsert(spark, sf_dir, "promotions", ["remarks"])


@query(_promotion_sql("promotion_groups", ["min_qty"]))
def upsert_promotion_groups(spark, sf_dir):
    return _promotion_upsert(spark, sf_dir, "promotion_groups", ["min_qty"])


@query(_promotion_sql("promotion_items", ["item_type", "min_qty"]))
def upsert_promotion_items(spark, sf_dir):
    return _promotion_upsert(spark, sf_dir, "promotion_items", ["item_type", "min_qty"])


CAST_COLUMNS = {"event_id": "bigint", "amount": "decimal(10,2)", "flag": "boolean", "at": "timestamp_ntz", "count": "int"}


def _text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text; every third amount has a unit, every fifth flag is a word, every eleventh count is empty."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id as string) as event_id", "if(event_id % 3 = 0, concat(cast(cast(value as decimal(10,2)) as string), ' kg'), cast(cast(value as decimal(10,2)) as string)) as amount",
        "case when event_id % 5 = 0 then 'maybe' when event_id % 2 = 0 then '1' else 'No' end as flag", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as at", "case when event_id % 11 = 0 then '' when event_id % 13 = 0 then null else concat(' 0', cast(user_id as string)) end as count",
    )


@query("SELECT event_id, CAST(value AS DECIMAL(10,2)) AS amount, event_id % 2 = 0 AS flag, date_trunc('second', ts) AS at, CASE WHEN event_id % 13 <> 0 THEN CAST(user_id AS INT) END AS count FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0")
def typed_rows(spark, sf_dir):
    return cast_to_table(_text_events(spark, sf_dir), CAST_COLUMNS, "quarantine")[0]


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'amount' END, CASE WHEN event_id % 5 = 0 THEN 'flag' END, CASE WHEN event_id % 11 = 0 THEN 'count' END) AS bad_columns FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 11 = 0")
def rejected_rows(spark, sf_dir):
    return cast_to_table(_text_events(spark, sf_dir), CAST_COLUMNS, "quarantine")[1].select("event_id", F.array_join("bad_columns", ",").alias("bad_columns"))


@query(f"WITH n AS (SELECT o_orderkey, {NAMES_DUCK} AS name FROM orders) SELECT name AS file_name FROM n WHERE name NOT IN (SELECT name FROM n WHERE o_orderkey % 3 = 0)")
def files_to_fetch(spark, sf_dir):
    listed = names(spark, sf_dir).withColumnRenamed("name", "file_name")
    return landing.skip_existing(listed.select("file_name"), listed.where("o_orderkey % 3 = 0"))[0]


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def without_empty_columns(spark, sf_dir):
    return drop_empty_columns(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("nothing"), F.lit("  ").alias("blank")))


@query("SELECT doc_id, nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') AS cleaned, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS id_text, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), source) AS filled FROM documents")
def normalized_text(spark, sf_dir):
    marked = F.when(F.col("doc_id") % 4 == 0, F.lit(f"  {text.UNKNOWN} ")).otherwise(F.concat(F.lit(" "), "source", F.lit("\t")))
    return table(spark, sf_dir, "documents").select("doc_id", text.optional_text(F.concat(F.lit(" \t"), "text", F.lit("\n "))).alias("cleaned"), text.integer_text(marked).alias("id_text"), text.first_filled(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("filled"))


@query(f"WITH {OBS} SELECT count(*) AS rows FROM obs")
def staged_rows(spark, sf_dir):
    return quality.row_count(observations(spark, sf_dir))


@query(f"WITH {STORE_BATCH} SELECT {STORE_OUT} FROM b WHERE {STORE_KNOWN}")
def stores_with_keys(spark, sf_dir):
    return with_keys(store_batch(spark, sf_dir), ["chain_id", "store_id"]).selectExpr(*_columns(STORE_OUT))


@query(f"WITH {OBS}, {_top('old', 'obs', PRICE_KEY, PRICE_ORDER)}, d AS (SELECT extraction_date, lag(item_price) OVER (PARTITION BY chain_id, store_id, item_code ORDER BY extraction_date) AS before, item_price, chain_id, store_id, item_code FROM old) SELECT chain_id, store_id, item_code, extraction_date, item_price, CAST(item_price - before AS DECIMAL(11,2)) AS change FROM d WHERE before IS NOT NULL AND item_price <> before")
def price_changes(spark, sf_dir):
    """Goal named in the design: how a store's price of an item moved from one day that has it to the next."""
    from pyspark.sql import Window

    by_day = Window.partitionBy("chain_id", "store_id", "item_code").orderBy("extraction_date")
    moved = latest_prices(observations(spark, sf_dir)).withColumn("before", F.lag("item_price").over(by_day)).where("before is not null and item_price <> before")
    return moved.select("chain_id", "store_id", "item_code", "extraction_date", "item_price", (F.col("item_price") - F.col("before")).cast("decimal(11,2)").alias("change"))


@query(f"WITH {OBS}, {_top('old', 'obs', PRICE_KEY, PRICE_ORDER)}, n AS (SELECT * FROM old WHERE extraction_date = (SELECT max(extraction_date) FROM old)) SELECT item_code, count(*) AS stores, min(item_price) AS lowest, max(item_price) AS highest FROM n GROUP BY 1")
def price_comparison(spark, sf_dir):
    """Goal named in the design: what an item costs over the stores on the newest day."""
    prices = latest_prices(observations(spark, sf_dir))
    newest = F.broadcast(observations(spark, sf_dir).agg(F.max("extraction_date").alias("extraction_date")))  # one row
    return prices.join(newest, "extraction_date").groupBy("item_code").agg(F.count("*").alias("stores"), F.min("item_price").alias("lowest"), F.max("item_price").alias("highest"))


@query(f"WITH {OBS}, {_top('last', 'obs', 'chain_id', _by(['order_key', *schemas.STAGING]))} SELECT {PRICE_OUT} FROM last")
def last_of_each_chain(spark, sf_dir):
    """The last order of each chain is found by numbers alone; only its lines are joined as a whole and put in order."""
    last = F.when(~F.max(F.col("order_key").isNull()), F.max("order_key"))  # a null order is the first in order
    newest = observations(spark, sf_dir).groupBy(F.col("chain_id").alias("chain")).agg(last.alias("last"))  # a row a chain
    of_last = (F.col("l_suppkey") % 3).eqNullSafe(F.col("chain")) & F.col("l_orderkey").eqNullSafe(F.col("last"))
    lines = table(spark, sf_dir, "lineitem").join(F.broadcast(newest), of_last, "left_semi")
    obs = observations(spark, sf_dir, lines)
    return first_per_key(obs, ["chain_id"], newest_first(obs, "order_key")).selectExpr(*_columns(PRICE_OUT))


# Loads: listings and documents made of the tables go through the jobs; what is then in the tables is the result.


def _new_tables(spark: SparkSession) -> Tables:
    tables = Tables(spark, work_folder(spark))
    tables.create()
    return tables


def _listed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as the price file of one of 97 stores: source_file, content, day (two of three are of an older day),
    order_key."""
    item = {
        "ItemCode": F.col("l_partkey"),
        "ItemName": F.col("l_returnflag"),
        "bIsWeighted": F.lit("0"),
        "QtyInPackage": F.lit(" "),
        "ItemPrice": F.col("l_extendedprice").cast("decimal(10,2)"),
        "ItemStatus": F.col("l_linenumber"),
    }
    docs = _joined(table(spark, sf_dir, "lineitem").select("l_orderkey", _element("Item", item).alias("xml")), ["l_orderkey"])  # the lines of an order
    store = (F.col("l_orderkey") % 97).cast("string")
    day = F.when(F.col("l_orderkey") % 3 == 0, "20260722").otherwise("20260721")
    name = F.concat(F.lit("PriceFull7290027600007-001-"), F.lpad(store, 3, "0"), F.lit("-"), day, F.lit("-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit(".gz"))
    root = _root({"StoreID": store, "ChainID": F.lit("7290027600007"), "SubChainID": F.lit("1")}, "Items")
    return docs.select(name.alias("source_file"), root.alias("content"), day.alias("day"), F.col("l_orderkey").alias("order_key"))


NEWEST_ORDERS = "c AS (SELECT l_orderkey % 97 AS store, max(l_orderkey) AS k FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)"
PRICE_FILE = "'PriceFull7290027600007-001-' || lpad(CAST(store AS VARCHAR), 3, '0') || '-20260722-' || lpad(CAST(k AS VARCHAR), 9, '0') || '.gz'"


@query(
    f"""WITH {NEWEST_ORDERS}
    SELECT l_partkey AS item_code, CAST(store AS INT) AS store_id, max(CAST(l_extendedprice AS DECIMAL(10,2))) AS item_price,
      {PRICE_FILE} AS source_file, DATE '2026-07-22' AS extraction_date
    FROM lineitem JOIN c ON l_orderkey = k WHERE k % 4 <> 1 GROUP BY ALL"""
)
def names_to_load(spark, sf_dir):
    """A name list, of which three of four files have landed: the newest of each store that has landed is loaded."""
    docs = _listed_prices(spark, sf_dir)
    snapshots = landing.snapshots_of_names(docs.select(F.col("source_file").alias("name"), F.col("order_key").alias("position")), text.PRICE_FULL)
    landed = docs.where("order_key % 4 <> 1")
    _, here = landing.select_snapshots(snapshots, landed.select(F.col("source_file").alias("file_name")))
    tables = _new_tables(spark)
    wanted = landed.join(here.select(F.col("file_name").alias("source_file")), "source_file", "left_semi").select("source_file", "content")
    jobs.load_prices_full(tables, here.select("file_name"), wanted, jobs.Options())
    return tables.read("product_prices").select("item_code", "store_id", "item_price", "source_file", "extraction_date")


@query(
    f"""WITH {NEWEST_ORDERS}, p AS (SELECT l_partkey AS item_code, max(l_returnflag) OVER (PARTITION BY l_partkey, k) AS item_name, k, {PRICE_FILE} AS source_file
      FROM lineitem JOIN c ON l_orderkey = k)
    SELECT item_code, arg_max(item_name, source_file) AS item_name FROM p GROUP BY 1"""
)
def manifest_to_load(spark, sf_dir):
    """The same files by a listing with times and branches: the products of the newest ones."""
    docs = _listed_prices(spark, sf_dir)
    at = F.concat(F.regexp_replace("day", "(....)(..)(..)", "$1-$2-$3"), F.lit(" "), F.lpad(F.col("order_key").cast("string"), 9, "0"))
    kind = F.when(F.col("order_key") % 2 == 0, "PriceFull").otherwise("pricefull")
    listed = docs.select(kind.alias("fileType"), F.col("source_file").alias("fileName"), at.alias("fileDate"), (F.col("order_key") % 97).cast("string").alias("branchNumber"), F.col("order_key").alias("position"))
    listed = listed.unionByName(listed.withColumn("fileType", F.lit("promo")).withColumn("fileDate", F.lit("2030-01-01 00")))  # of another type, newer
    snapshots = landing.snapshots_of_manifest(landing.wanted_entries(listed, "PRICEFULL"))
    _, here = landing.select_snapshots(snapshots, docs.select(F.col("source_file").alias("file_name")))
    tables = _new_tables(spark)
    wanted = docs.join(here.select(F.col("file_name").alias("source_file")), "source_file", "left_semi").select("source_file", "content")
    jobs.load_prices_full(tables, None, wanted, jobs.Options())
    return tables.read("products").select("item_code", "item_name")


@query(
    """WITH b AS (SELECT s_nationkey AS store, n_regionkey AS chain, s_name, s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE n_regionkey END AS chain_id
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT CAST(chain_id AS BIGINT) AS chain_id, CAST(store AS INT) AS store_id, arg_max(s_name, s_suppkey) AS store_name, CAST(arg_max(s_suppkey % 4, s_suppkey) AS INT) AS sub_chain_id
    FROM b WHERE chain_id IS NOT NULL GROUP BY ALL"""
)
def stores_to_load(spark, sf_dir):
    """Each supplier as a store file; later files overwrite a store, those without a chain are dropped."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    store = F.struct(F.col("s_nationkey").cast("string").alias("StoreID"), F.col("s_name").alias("StoreName"))
    sub = F.struct((F.col("s_suppkey") % 4).cast("string").alias("SubChainID"), F.struct(F.array(store).alias("Store")).alias("Stores"))
    chain = F.when(F.col("s_suppkey") % 10 == 0, " ").otherwise(F.col("n_regionkey").cast("string"))
    root = F.struct(chain.alias("ChainID"), F.struct(F.array(sub).alias("SubChain")).alias("SubChains"))
    name = F.concat(F.lit("Stores7290027600007-000-20260816-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".xml"))
    tables = _new_tables(spark)
    jobs.load_stores(tables, None, joined.select(name.alias("source_file"), F.to_xml(root, {"rowTag": "Root"}).alias("content")), jobs.Options())
    return tables.read("stores").select("chain_id", "store_id", "store_name", "sub_chain_id")


PROMOTED = """p AS (SELECT 7290027600007 AS chain_id, CAST(o_custkey % 9 AS INT) AS store_id, CAST(o_orderkey AS VARCHAR) AS promotion_id, DATE '2026-08-16' AS extraction_date,
  l_returnflag AS group_id, l_partkey AS item_code, CAST(l_quantity AS DECIMAL(12,2)) AS min_qty, l_linenumber AS place FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)"""


@query(
    f"""WITH {PROMOTED} SELECT chain_id, store_id, promotion_id, group_id, item_code, extraction_date, arg_max(min_qty, place * 1000 + min_qty) AS min_qty FROM p GROUP BY ALL"""
)
def promotions_to_load(spark, sf_dir):
    """Orders as promotion files, through the load into three tables: every seventh has groups without an id, every
    eleventh no promotion id, every thirteenth the excluded store in its header; their items are not there."""
    item = {"ItemCode": F.col("l_partkey"), "MinQty": F.col("l_quantity").cast("decimal(12,2)")}
    placed = F.struct(F.col("l_linenumber"), F.col("l_quantity").cast("decimal(12,2)"), F.col("l_partkey").cast("string"), _element("PromotionItem", item).alias("xml"))
    groups = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", placed.alias("i")).groupBy("l_orderkey", "l_returnflag").agg(F.array_join(F.array_sort(F.collect_list("i"))["xml"], "").alias("items"))
    group = _group({"GroupID": F.when(F.col("l_orderkey") % 7 == 0, " ").otherwise(F.col("l_returnflag"))})
    promos = table(spark, sf_dir, "orders").join(_joined(groups.select("l_orderkey", group.alias("xml")), ["l_orderkey"]), F.col("o_orderkey") == F.col("l_orderkey"))
    excluded = F.col("o_orderkey") % 13 == 0
    store = F.when(excluded, text.EXCLUDED_STORE).otherwise((F.col("o_custkey") % 9).cast("string"))
    root = _promotion_root({"ChainID": F.when(excluded, text.EXCLUDED_CHAIN).otherwise("7290027600007"), "StoreID": store}, {"PromotionID": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey"))})
    name = F.concat(F.lit("PromoFull7290027600007-001-001-20260816-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".gz"))
    tables = _new_tables(spark)
    jobs.load_promo_full(tables, None, promos.select(name.alias("source_file"), root.alias("content")), jobs.Options())
    loaded = tables.read("promotion_items").select(*schemas.KEYS["promotion_items"], F.col("min_qty").cast("decimal(12,2)").alias("min_qty"))
    groups = tables.read("promotion_groups").join(tables.read("promotions").select(*schemas.KEYS["promotions"]), schemas.KEYS["promotions"], "left_semi")
    return loaded.join(groups.select(*schemas.KEYS["promotion_groups"]), schemas.KEYS["promotion_groups"], "left_semi")


@query(
    """SELECT 'products_staging' AS target, 'not of the type of item_status' AS reason, count(*) AS rows
      FROM lineitem WHERE l_linenumber % 4 = 0 AND l_orderkey % 5 <> 0
    UNION ALL SELECT 'products_staging', 'no item_price', count(*) FROM lineitem WHERE l_linenumber % 4 = 1 AND l_orderkey % 5 <> 0
    UNION ALL SELECT 'PriceFull file', 'malformed', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 5 = 0"""
)
def rejected_by_load(spark, sf_dir):
    """A load in quarantine mode: statuses that are no numbers, missing prices, files that are cut off."""
    status = F.when(F.col("l_linenumber") % 4 == 0, "old").otherwise("1")
    item = {"ItemCode": F.col("l_partkey"), "ItemPrice": F.when(F.col("l_linenumber") % 4 != 1, "1.00").otherwise(""), "ItemStatus": status}
    docs = _joined(table(spark, sf_dir, "lineitem").select("l_orderkey", _element("Item", item).alias("xml")), ["l_orderkey"])
    root = _root({"StoreID": F.col("l_orderkey") % 50, "ChainID": F.lit("1")}, "Items")
    name = F.concat(F.lit("PriceFull1-001-001-20260722-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit(".gz"))
    cut = F.when(F.col("l_orderkey") % 5 == 0, F.substr(root, F.lit(1), F.length(root) - 8)).otherwise(root)
    tables = _new_tables(spark)
    jobs.load_prices_full(tables, None, docs.select(name.alias("source_file"), cut.alias("content")), jobs.Options(mode="quarantine"))
    return tables.read("rejected").groupBy("target", "reason").agg(F.count("*").alias("rows"))


# From landed files to tables: the lines of all orders as packed files, one for each store and day.

LANDED_DAYS = ("2026-07-21", "2026-07-22")
STORE_LINES = """lines AS (SELECT CAST(l_suppkey % 40 AS INT) AS store_id, l_partkey AS item_code, CAST(l_extendedprice AS DECIMAL(10,2)) AS item_price, l_returnflag AS item_name,
  CASE WHEN l_orderkey % 3 = 0 THEN DATE '2026-07-22' ELSE DATE '2026-07-21' END AS extraction_date FROM lineitem),
named AS (SELECT *, 'PriceFull7290027600007-001-' || lpad(CAST(store_id AS VARCHAR), 3, '0') || '-' || strftime(extraction_date, '%Y%m%d') || '-030000.gz' AS source_file FROM lines)"""
#: Of the files, those of some stores are cut off, and those of others are no packed files.
CUT, BROKEN = (7, 21), (11, 30)


def _land(spark: SparkSession, sf_dir: str, damaged: bool = False) -> tuple[str, DataFrame]:
    """A folder with the landed files, and their names with store and day."""
    item = {"ItemCode": F.col("l_partkey"), "ItemName": F.col("l_returnflag"), "ItemPrice": F.col("l_extendedprice").cast("decimal(10,2)")}
    store, day = (F.col("l_suppkey") % 40).cast("int"), F.when(F.col("l_orderkey") % 3 == 0, LANDED_DAYS[1]).otherwise(LANDED_DAYS[0])
    lines = table(spark, sf_dir, "lineitem").select(store.alias("store"), day.alias("day"), _element("Item", item).alias("content"))
    head = F.concat(F.lit("<Root>"), _elements({"StoreID": F.col("store"), "ChainID": F.lit("7290027600007"), "SubChainID": F.lit("1")}), F.lit("<Items>"))
    cut = F.when(F.col("store").isin(*CUT), "</Items").otherwise("</Items></Root>") if damaged else F.lit("</Items></Root>")
    name = F.concat(F.lit("PriceFull7290027600007-001-"), F.lpad(F.col("store").cast("string"), 3, "0"), F.lit("-"), F.regexp_replace("day", "-", ""), F.lit("-030000.gz"))
    named = _in_rows(lines, ["store", "day"], head, cut).select(name.alias("source_file"), "place", "content")
    top = work_folder(spark)
    folder = f"{top}/price_full/fresh"
    landing.land_documents(named, folder)
    names = landing.list_files(spark, folder, text.PRICE_FULL).select("file_name", F.split("file_name", "-")[2].cast("int").alias("store"), F.split("file_name", "-")[3].alias("day"))
    if damaged:
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for r in names.where(F.col("store").isin(*BROKEN)).collect():
            out = fs.create(path(f"{folder}/{r['file_name']}"), True)
            out.write(bytearray(b"not packed"))
            out.close()
    return top, names


PRICES_OF = "SELECT item_code, store_id, max(item_price) AS item_price, source_file, extraction_date FROM named WHERE {} GROUP BY ALL"
USABLE = f"store_id NOT IN {CUT + BROKEN}"
NEWEST_OF_TWO_PAGES = "store_id < 30 AND extraction_date = DATE '2026-07-22'"
PRICE_COLUMNS = ("item_code", "store_id", "item_price", "source_file", "extraction_date")


@query(f"WITH {STORE_LINES} {PRICES_OF.format('true')}")
def landed_prices(spark, sf_dir):
    """All files of a folder through the load, from unpacking to history."""
    top, _ = _land(spark, sf_dir)
    tables = _new_tables(spark)
    jobs.run(tables, top, "fresh", "price_full")
    return tables.read("product_prices").select(*PRICE_COLUMNS)


@query(f"WITH {STORE_LINES} {PRICES_OF.format(USABLE)}")
def streamed_prices(spark, sf_dir):
    """The same files as a stream, some of them damaged, in batches of 30 and two runs of one checkpoint."""
    top, _ = _land(spark, sf_dir, damaged=True)
    tables = _new_tables(spark)
    for _ in range(2):
        stream_ingest(tables, f"{top}/price_full/fresh", "price_full", f"{top}/checkpoint", max_files=30).awaitTermination()
    return tables.read("product_prices").select(*PRICE_COLUMNS)


@query(
    f"""WITH {STORE_LINES} SELECT DISTINCT source_file AS file_name, CASE WHEN {USABLE} THEN 'loaded' ELSE 'rejected' END AS state,
    CASE WHEN store_id IN {CUT} THEN 'malformed' WHEN store_id IN {BROKEN} THEN 'unreadable' END AS reason, CASE WHEN {USABLE} THEN 0 ELSE 1 END AS kept_aside FROM named"""
)
def file_states(spark, sf_dir):
    """What a stream, and a job over the same folder that leaves loaded files out, know of each file; and how often it is
    among the rejected ones after the stream alone."""
    top, _ = _land(spark, sf_dir, damaged=True)
    tables = _new_tables(spark)
    stream_ingest(tables, f"{top}/price_full/fresh", "price_full", f"{top}/checkpoint", max_files=30).awaitTermination()
    aside = tables.read("rejected").groupBy(F.col("source_file").alias("file_name")).agg(F.count("*").cast("int").alias("n"))
    aside = spark.createDataFrame([tuple(r) for r in aside.collect()], aside.schema)  # a row a damaged file
    jobs.run(tables, top, "fresh", "price_full", jobs.Options(mode="quarantine", skip_loaded=True))
    return jobs.file_states(tables).join(aside, "file_name", "left").select("file_name", "state", "reason", F.coalesce("n", F.lit(0)).alias("kept_aside"))


@query(f"WITH {STORE_LINES} {PRICES_OF.format(NEWEST_OF_TWO_PAGES)}")
def pages_to_load(spark, sf_dir):
    """Pages of links, fifteen stores a page, to a load of the first two pages: the newest file of each store there."""
    top, names = _land(spark, sf_dir)
    link = F.concat(F.lit('<a href="/files/'), F.col("file_name"), F.lit('?sig='), F.col("store").cast("string"), F.lit('">x</a>'))
    pages = names.groupBy((F.floor(F.col("store") / 15) + 1).cast("int").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("html"))
    tables = _new_tables(spark)
    jobs.run_pages(tables, pages, "https://prices.example/list", top, "fresh", "price_full", jobs.Options(max_pages=2))
    return tables.read("product_prices").select(*PRICE_COLUMNS)


@query(f"WITH {STORE_LINES} {PRICES_OF.format('store_id BETWEEN 3 AND 8 AND item_code <= 200')}")
def prices_in_range(spark, sf_dir):
    """Two loads, a day each, then a read of some stores and items by the least and greatest keys in the manifest."""
    top, names = _land(spark, sf_dir)
    tables = _new_tables(spark)
    for day in LANDED_DAYS:
        wanted = names.where(F.col("day") == day.replace("-", "")).select("file_name")
        jobs.load_prices_full(tables, *jobs.landed_documents(tables, f"{top}/price_full/fresh", text.PRICE_FULL, jobs.Options(), wanted), jobs.Options())
    return tables.read_range("product_prices", store_id=(3, 8), item_code=(0, 200)).select(*PRICE_COLUMNS)


def _refused(load: Callable[[], object]) -> str:
    """What a load that must fail says."""
    try:
        load()
    except ValueError as e:
        return str(e)
    raise RuntimeError("the load did not fail")


@query(
    """SELECT CAST(l_suppkey % 40 AS INT) AS store_id, count(*) AS staged, CAST(count_if(l_linenumber % 4 = 1) AS BIGINT) AS without_price,
      (SELECT count(*) FROM lineitem WHERE l_linenumber % 4 = 1) || ' staged rows lack one of item_code, store_id, extraction_date, item_price' AS said, 0 AS loaded FROM lineitem GROUP BY 1"""
)
def staged_after_failed_check(spark, sf_dir):
    """A batch in which each fourth line has no price: the load ends at its first check, the batch stays staged, and nothing
    is loaded."""
    item = {"ItemCode": F.col("l_partkey"), "ItemPrice": F.when(F.col("l_linenumber") % 4 != 1, "1.00").otherwise("")}
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).cast("int").alias("store"), _element("Item", item).alias("content"))
    head = F.concat(F.lit("<Root>"), _elements({"StoreID": F.col("store"), "ChainID": F.lit("1")}), F.lit("<Items>"))
    name = F.concat(F.lit("PriceFull1-001-"), F.lpad(F.col("store").cast("string"), 3, "0"), F.lit("-20260722-030000.gz"))
    top = work_folder(spark)
    landing.land_documents(_in_rows(lines, ["store"], head, F.lit("</Items></Root>")).select(name.alias("source_file"), "place", "content"), f"{top}/price_full/fresh")
    tables = _new_tables(spark)
    said = _refused(lambda: jobs.run(tables, top, "fresh", "price_full"))
    staged = tables.read("products_staging").groupBy("store_id").agg(F.count("*").alias("staged"), F.count_if(F.col("item_price").isNull()).alias("without_price"))
    return staged.select("*", F.lit(said).alias("said"), F.lit(tables.rows("products") + tables.rows("product_prices")).cast("int").alias("loaded"))


@query(
    f"""WITH {OBS}, p AS (SELECT DISTINCT {PRICE_KEY} FROM obs)
    SELECT extraction_date, count(*) AS lost, (SELECT count(*) FROM p WHERE item_code % 10 = 3) || ' prices have no product' AS said FROM p WHERE item_code % 10 = 3 GROUP BY 1"""
)
def history_without_products(spark, sf_dir):
    """Prices of all days, then products of which a tenth has gone: the check of the whole history says how many prices
    are left without one, by the items of each day."""
    tables = _new_tables(spark)
    obs = observations(spark, sf_dir)
    jobs.merge_into(tables, "product_prices", latest_prices(obs))
    tables.overwrite("products", latest_products(newest_observations(spark, sf_dir)).where("item_code % 10 <> 3"))
    said = _refused(lambda: jobs.validate_history(tables))
    lost = quality.orphan_prices(tables.read("product_prices"), tables.read("products"))
    return lost.groupBy("extraction_date").agg(F.count("*").alias("lost")).withColumn("said", F.lit(said))


# Checks of all tables over whole batches in which keys repeat, values are missing, and parents are missing.


def _all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    obs = observations(spark, sf_dir).withColumn("store_id", F.nullif("store_id", F.lit(3)))
    promo = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(*PROMO_SPARK)
    promo = promo.withColumn("group_id", F.nullif("group_id", F.lit("R")))
    return {
        "products": obs.where("item_code % 3 <> 0"),
        "product_prices": obs,
        "stores": store_batch(spark, sf_dir),
        "promotions": promo.where("part % 5 <> 0"),
        "promotion_groups": promo.where("part % 7 <> 0"),
        "promotion_items": promo,
    }


ALL_TABLES = f"""{OBS.replace("CAST(l_suppkey % 5 AS INT) AS store_id", "nullif(CAST(l_suppkey % 5 AS INT), 3) AS store_id")}, {STORE_BATCH}, {PROMO_BATCH.replace("b AS (", "pb0 AS (", 1)},
pb AS (SELECT * REPLACE (nullif(group_id, 'R') AS group_id) FROM pb0),
products AS (SELECT * FROM obs WHERE item_code % 3 <> 0), product_prices AS (SELECT * FROM obs), stores AS (SELECT * FROM b),
promotions AS (SELECT * FROM pb WHERE part % 5 <> 0), promotion_groups AS (SELECT * FROM pb WHERE part % 7 <> 0), promotion_items AS (SELECT * FROM pb)"""


def _each(parts: list[str]) -> str:
    return f"WITH {ALL_TABLES} " + " UNION ALL ".join(parts)


@query(_each([f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)) AS violations" for t, k in schemas.NOT_NULL.items()]))
def check_keys_of_all_tables(spark, sf_dir):
    return quality.check_keys(_all_tables(spark, sf_dir))


@query(_each([f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", (SELECT count(*) FROM {t} WHERE {c} IS NULL) AS violations" for t, k in schemas.NOT_NULL.items() for c in k]))
def check_not_null_of_all_tables(spark, sf_dir):
    return quality.check_not_null(_all_tables(spark, sf_dir))


@query(
    _each([
        f"SELECT '{child}' AS \"table\", (SELECT count(*) FROM {child} x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)}"
        f" AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE {' AND '.join(f'x.{c} = y.{c}' for c in columns)})) AS violations"
        for child, columns, parent in schemas.REFERENCES
    ])
)
def check_references_of_all_tables(spark, sf_dir):
    return quality.check_references(_all_tables(spark, sf_dir))

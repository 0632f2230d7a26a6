"""Columns, types and keys of the record layers and tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Unbounded numerics of the source model get this bound.
NUMERIC = "decimal(38,10)"
MONEY = "decimal(10,2)"

# Column names and types of the records, in table order.
STAGING = {
    "item_code": "bigint", "item_name": "string", "manufacture_name": "string", "manufacture_country": "string",
    "manufacture_item_description": "string", "unit_qty": "string", "quantity": NUMERIC, "unit_of_measure": "string",
    "is_weighted": "boolean", "qty_in_package": "int", "item_price": MONEY, "unit_of_measure_price": MONEY,
    "allow_discount": "boolean", "item_status": "int", "price_update_time": "timestamp_ntz",
    "last_sale_date_time": "timestamp_ntz", "item_type": "int", "store_id": "int", "chain_id": "bigint",
    "sub_chain_id": "int", "source_file": "string", "extraction_date": "date",
}
PRODUCTS = (
    "item_code", "item_name", "manufacture_name", "manufacture_country", "manufacture_item_description", "unit_qty",
    "quantity", "unit_of_measure", "is_weighted", "qty_in_package", "item_type",
)
PRICES = (
    "item_code", "store_id", "item_price", "unit_of_measure_price", "price_update_time", "last_sale_date_time",
    "item_status", "allow_discount", "chain_id", "sub_chain_id", "source_file", "extraction_date",
)
STORES = {
    "chain_id": "bigint", "store_id": "int", "chain_name": "string", "sub_chain_id": "int", "sub_chain_name": "string",
    "bikoret_no": "int", "store_type": "int", "store_name": "string", "address": "string", "city": "string",
    "zip_code": "string", "source_file": "string", "extraction_date": "date",
}
PROMOTIONS = {
    "chain_id": "bigint", "store_id": "int", "promotion_id": "string", "extraction_date": "date", "sub_chain_id": "int",
    "bikoret_no": "int", "promotion_description": "string", "promotion_start_date_time": "timestamp_ntz",
    "promotion_end_date_time": "timestamp_ntz", "promotion_start_hour": "string", "promotion_end_hour": "string",
    "promotion_update_time": "timestamp_ntz", "allow_multiple_discounts": "boolean", "club_id": "string",
    "min_no_of_item_offered": NUMERIC, "redemption_limit": "int", "is_gift_item": "string",
    "additional_is_coupon": "boolean", "additional_restrictions": "string", "remarks": "string",
    "promotion_days": "string", "source_file": "string",
}
PROMOTION_GROUPS = {
    "chain_id": "bigint", "store_id": "int", "promotion_id": "string", "group_id": "string", "extraction_date": "date",
    "min_purchase_amount": NUMERIC, "discount_type": "string",
}
PROMOTION_ITEMS = {
    "chain_id": "bigint", "store_id": "int", "promotion_id": "string", "group_id": "string", "item_code": "bigint",
    "extraction_date": "date", "item_type": "int", "is_weighted": "boolean", "reward_type": "string",
    "min_qty": NUMERIC, "max_qty": NUMERIC, "discounted_price": MONEY, "discounted_price_per_mida": MONEY,
    "discount_rate": NUMERIC,
}

#: Rows and files that a load set aside: what they were meant for, where from, why, and the row as JSON.
REJECTED = {"target": "string", "source_file": "string", "reason": "string", "row": "string"}

#: What is known of each file: rows are added as its state changes (see FILE_STATES), the last one counts.
FILES = {"extract_type": "string", "chain": "string", "file_name": "string", "state": "string", "reason": "string", "at": "timestamp"}
FILE_STATES = ("listed", "landed", "loaded", "rejected")

TABLES = {
    "products": {c: STAGING[c] for c in PRODUCTS},
    "product_prices": {c: STAGING[c] for c in PRICES},
    "products_staging": STAGING,
    "stores": STORES,
    "promotions": PROMOTIONS,
    "promotion_groups": PROMOTION_GROUPS,
    "promotion_items": PROMOTION_ITEMS,
    "rejected": REJECTED,
    "files": FILES,
    "price_items": {"item_code": "bigint", "extraction_date": "date"},
}
#: Tables that loads keep for themselves: the states of files, and the items that each day's prices have.
INTERNAL = ("files", "price_items")
KEYS = {
    "products": ["item_code"],
    "product_prices": ["chain_id", "store_id", "item_code", "extraction_date"],
    "stores": ["chain_id", "store_id"],
    "promotions": ["chain_id", "store_id", "promotion_id", "extraction_date"],
    "promotion_groups": ["chain_id", "store_id", "promotion_id", "group_id", "extraction_date"],
    "promotion_items": ["chain_id", "store_id", "promotion_id", "group_id", "item_code", "extraction_date"],
    "price_items": ["item_code", "extraction_date"],
}
#: Columns that must have a value; the key columns in each table.
NOT_NULL = {t: keys for t, keys in KEYS.items() if t not in INTERNAL}
#: child table, its columns, parent table.
REFERENCES = (
    ("product_prices", ["item_code"], "products"),
    ("promotion_groups", KEYS["promotions"], "promotions"),
    ("promotion_items", KEYS["promotion_groups"], "promotion_groups"),
)
#: History tables are laid out by day, which is in each of their keys, and within a day in buckets of these columns.
PARTITIONED = {"product_prices": ("chain_id", "store_id"), "promotions": ("chain_id", "store_id"), "promotion_groups": ("chain_id", "store_id"), "promotion_items": ("chain_id", "store_id"), "price_items": ("item_code",)}
#: Buckets of a day.
BUCKETS = 16

# Element names of the documents, by column.
PRICE_TAGS = {
    "item_code": "ItemCode", "item_name": "ItemName", "manufacture_name": "ManufactureName",
    "manufacture_country": "ManufactureCountry", "manufacture_item_description": "ManufactureItemDescription",
    "unit_qty": "UnitQty", "quantity": "Quantity", "unit_of_measure": "UnitOfMeasure", "is_weighted": "bIsWeighted",
    "qty_in_package": "QtyInPackage", "item_price": "ItemPrice", "unit_of_measure_price": "UnitOfMeasurePrice",
    "allow_discount": "AllowDiscount", "item_status": "ItemStatus", "price_update_time": "PriceUpdateTime",
    "last_sale_date_time": "LastSaleDateTime", "item_type": "ItemType",
}
STORE_TAGS = {
    "store_id": "StoreID", "bikoret_no": "BikoretNo", "store_type": "StoreType", "store_name": "StoreName",
    "address": "Address", "city": "City", "zip_code": "ZIPCode",
}
PROMOTION_TAGS = {
    "promotion_id": "PromotionID", "promotion_description": "PromotionDescription",
    "promotion_start_date_time": "PromotionStartDateTime", "promotion_end_date_time": "PromotionEndDateTime",
    "promotion_start_hour": "PromotionStartHour", "promotion_end_hour": "PromotionEndHour",
    "promotion_update_time": "PromotionUpdateTime", "allow_multiple_discounts": "AllowMultipleDiscounts",
    "club_id": "ClubID", "min_no_of_item_offered": "MinNoOfItemOffered", "redemption_limit": "RedemptionLimit",
    "is_gift_item": "IsGiftItem", "additional_is_coupon": "AdditionalIsCoupon",
    "additional_restrictions": "AdditionalRestrictions", "remarks": "Remarks", "promotion_days": "PromotionDays",
}
GROUP_TAGS = {"group_id": "GroupID", "min_purchase_amount": "MinPurchaseAmount", "discount_type": "DiscountType"}
PROMOTION_ITEM_TAGS = {
    "item_code": "ItemCode", "item_type": "ItemType", "is_weighted": "bIsWeighted", "reward_type": "RewardType",
    "min_qty": "MinQty", "max_qty": "MaxQty", "discounted_price": "DiscountedPrice",
    "discounted_price_per_mida": "DiscountedPricePerMida", "discount_rate": "DiscountRate",
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def struct_of(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(ddl(columns))


def _texts(*tags: str) -> str:
    return ", ".join(f"`{t}`: STRING" for t in tags)


#: What from_xml reads. Elements that may repeat within a store or promotion are read as they come; the last one counts.
PRICE_ITEM = f"{_texts(*PRICE_TAGS.values(), 'IsWeighted').replace(':', '')}, _corrupt_record STRING"
PRICE_DOCUMENT = f"StoreID STRING, ChainID STRING, SubChainID STRING, Items STRUCT<Item: ARRAY<STRUCT<{_texts(*PRICE_TAGS.values(), 'IsWeighted')}>>, xs_any: ARRAY<STRING>>, _corrupt_record STRING"
STORE_DOCUMENT = f"ChainID STRING, ChainName STRING, SubChains STRUCT<SubChain: ARRAY<STRUCT<SubChainID: STRING, SubChainName: STRING, Stores: STRUCT<Store: ARRAY<STRUCT<{_texts(*STORE_TAGS.values())}>>>>>>, _corrupt_record STRING"
PROMOTION_DOCUMENT = (
    "ChainID STRING, SubChainID STRING, StoreID STRING, BikoretNo STRING, Promotions STRUCT<Promotion: ARRAY<STRUCT<"
    f"{_texts(*PROMOTION_TAGS.values())}, Groups: STRUCT<`Group`: ARRAY<STRUCT<{_texts(*GROUP_TAGS.values())}, "
    f"PromotionItems: STRUCT<PromotionItem: ARRAY<STRUCT<{_texts(*PROMOTION_ITEM_TAGS.values())}>>>>>>>>>, _corrupt_record STRING"
)

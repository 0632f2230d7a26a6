"""XML documents to raw rows, all text. Nothing that can't be read stops a run: it is listed with a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.functions import text
from basketlake.functions.text import Feed

XML = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt_record"}
DOCUMENTS = {"PriceFull": schemas.PRICE_DOCUMENT, "Stores": schemas.STORE_DOCUMENT, "PromoFull": schemas.PROMOTION_DOCUMENT}


def read_documents(spark: SparkSession, folder: str | list[str], feed: Feed, recursive: bool = True, names: list[str] | None = None) -> DataFrame:
    """source_file, content: one row a file of a folder or of a list of paths, unpacked by its ending; of some file names
    only, the others are not opened. Files that can't be unpacked give no row."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("pathGlobFilter", feed.glob).option("recursiveFileLookup", recursive)
    rows = reader.text(folder, wholetext=True)
    if names is not None:
        rows = rows.where(F.col("_metadata.file_name").isin(names))
    return rows.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))


#: Tags of a price document that are no items: those around them, and those within them.
FRAME = ("Root", "Items", "Item", "StoreID", "ChainID", "SubChainID")
FIELDS = (*FRAME[3:], *schemas.PRICE_TAGS.values(), "IsWeighted")


def other_names_of_text(content: Column) -> Column:
    """Names of a price document's elements that it has no use for, by its text: items of other names are among them, and the
    rest is nowhere read. Null where text may mislead: the root has another name, or there are CDATA, declarations, or tags
    within a value."""
    unknown = rf"(?i)<(?!/|!|\?|(?:{'|'.join((*FRAME, *FIELDS))})[\s/>])([^\s<>/]+)"
    plain = content.rlike(r"(?i)^\s*(?:<\?[^>]*\?>\s*)?<Root[\s>]") & ~content.rlike(rf"(?i)<!\[CDATA|<!DOCTYPE|<(?:{'|'.join(FIELDS)})(?:\s[^<>]*)?>[^<]*<(?!/)")
    return F.when(plain, F.array_distinct(F.regexp_extract_all(content, F.lit(unknown), F.lit(1))))


def other_names_of_items(content: Column) -> Column:
    """Names of the children of Items other than Item, as the parser finds them (the keys of a variant)."""
    children = F.from_xml(content, "Items VARIANT", {"mode": "PERMISSIVE"})["Items"]
    return F.filter(F.map_keys(F.try_variant_get(children, "$", "map<string, variant>")), lambda n: ~n.startswith("_") & (F.lower(n) != "item"))


def as_items(content: Column, names: Column) -> Column:
    """A document in which elements of these names are called Item."""
    quoted = F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E")))
    pattern = F.concat(F.lit("(?i)(</?)(?:"), F.array_join(quoted, "|"), F.lit(r")(?=[\s>/])"))
    return F.regexp_replace(content, pattern, F.lit("$1Item"))


def parse_documents(documents: DataFrame, feed: Feed) -> DataFrame:
    """source_file, doc (null if the XML is malformed), extraction_date (null if the name has none). A byte-order mark
    is no part of a document."""
    content = F.regexp_replace("content", "^\\uFEFF", "")
    read = lambda c: F.from_xml(c, DOCUMENTS[feed.label], XML)
    # the generators keep later projections from parsing again for each field
    parsed = documents.select("source_file", content.alias("content"), F.explode(F.array(read(content))).alias("doc"))
    if feed is text.PRICE_FULL:
        # xs_any: children of Items of other names; documents without them, as is usual, are parsed once, others are well-formed
        # and parsed with these as Item: their names are looked for in the text, and if some are left, by a parse
        for other_names in (other_names_of_text, other_names_of_items):
            names = F.when(F.col("doc.Items.xs_any").isNotNull(), other_names(F.col("content")))
            named = parsed.select("source_file", "content", "doc", F.explode(F.array(names)).alias("names"))
            again = F.when(F.size("names") > 0, read(as_items(F.col("content"), F.col("names")))).otherwise(F.col("doc"))
            parsed = named.select("source_file", "content", F.explode(F.array(again)).alias("doc"))
    good = F.when(F.col("doc._corrupt_record").isNull(), F.col("doc"))
    return parsed.select("source_file", good.alias("doc"), text.day_of(F.col("source_file"), feed).alias("extraction_date"))


def _has_rows(feed: Feed) -> Column:
    """Whether the element that holds a document's rows is there; stores and promotions need a row in it, too."""
    if feed is text.PRICE_FULL:
        return F.col("doc.Items").isNotNull()
    if feed is text.STORES:
        return F.exists(F.coalesce(F.col("doc.SubChains.SubChain"), F.array()), lambda s: F.size(F.coalesce(s["Stores"]["Store"], F.array())) > 0)
    return F.size(F.coalesce(F.col("doc.Promotions.Promotion"), F.array())) > 0


def judged(parsed: DataFrame, feed: Feed) -> DataFrame:
    """parsed with `reason`, null for a document that is used."""
    excluded = text.is_excluded_file(F.col("source_file")) | text.is_excluded_header(F.col("doc.ChainID"), F.col("doc.StoreID")) if feed is text.PROMO_FULL else F.lit(False)
    reason = F.when(F.col("doc").isNull(), "malformed").when(F.col("extraction_date").isNull(), "no date in name").when(excluded, "excluded store").when(~F.coalesce(_has_rows(feed), F.lit(False)), "empty")
    return parsed.withColumn("reason", reason)


def usable(parsed: DataFrame, feed: Feed, strict_names: bool = False) -> DataFrame:
    """The documents that are used. `strict_names`: a price file without a date in its name ends the job."""
    if strict_names and feed is text.PRICE_FULL:
        parsed = parsed.withColumn("extraction_date", F.when(F.col("extraction_date").isNull(), F.raise_error(F.concat(F.lit("no date in the file name "), F.col("source_file")))).otherwise(F.col("extraction_date")))
    return judged(parsed, feed).where("reason is null").drop("reason")


def quarantine(listing: DataFrame | None, parsed: DataFrame, feed: Feed) -> DataFrame:
    """file_name, reason of each listed file that gives no rows. Without a listing the documents are all there is, and their
    names are looked up nowhere."""
    found = judged(parsed, feed).select(F.col("source_file").alias("file_name"), "reason")
    if listing is None:
        return found.where("reason is not null")
    unread = listing.join(found.select("file_name"), "file_name", "left_anti").select("file_name", F.lit("unreadable").alias("reason"))
    return unread.unionByName(found.where("reason is not null"))


def _header(*names: str) -> list[Column]:
    tags = {"chain_id": "ChainID", "chain_name": "ChainName", "sub_chain_id": "SubChainID", "store_id": "StoreID", "bikoret_no": "BikoretNo"}
    return [F.col(f"doc.{tags[n]}").alias(n) for n in names]


def price_rows(parsed: DataFrame) -> DataFrame:
    """The staging columns and `position`, one row for each child of Items, whatever its name. Values are not trimmed; an
    empty element is null, and a child without elements a row of nulls."""
    ids = ("store_id", "chain_id", "sub_chain_id")
    # what a row takes of its document is picked before the generator, or each row would hold the whole document
    docs = parsed.select("source_file", "extraction_date", *_header(*ids), F.col("doc.Items.Item").alias("items"))
    return _price_columns(docs.select("source_file", "extraction_date", *ids, F.posexplode("items").alias("position", "i")))


def _price_columns(items: DataFrame) -> DataFrame:
    tag = lambda column: text.none_if_empty(F.col(f"i.{schemas.PRICE_TAGS[column]}"))
    columns = {c: tag(c) for c in schemas.PRICE_TAGS}
    columns["is_weighted"] = text.first_filled(F.col("i.bIsWeighted"), text.none_if_empty(F.col("i.IsWeighted")))
    columns["qty_in_package"] = text.integer_text(F.col("i.QtyInPackage"))
    rows = items.select(*(c.alias(n) for n, c in columns.items()), "store_id", "chain_id", "sub_chain_id", "source_file", F.col("extraction_date").cast("string").alias("extraction_date"), "position")
    return rows.select(*schemas.STAGING, "position")


def price_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(price_rows, judged files) of price documents of any size: items are read one by one as the file is unpacked, so no
    document is ever one value.

    A first pass reads the files cut at each `<`, a row a tag, for the header and whether the document is whole; it gives a
    row a file: source_file, store_id, chain_id, sub_chain_id, extraction_date, reason (null: used). A document is whole if
    each tag is ended and each element closed; where comments, CDATA or quoted `>` may hold what looks like tags, this is
    asked of the tags around the items alone. Files in which tags of other names stand around elements are set aside ("other
    items"): records are read by the name Item."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    # what is counted of each tag is numbers, by the text before its first ">", so a pass keeps a row for each kind of tag
    header = {"store_id": "storeid", "chain_id": "chainid", "sub_chain_id": "subchainid"}
    cut = reader.option("lineSep", "<").text(paths).select(F.col("_metadata.file_name").alias("source_file"), "value", F.substring_index("value", ">", 1).alias("mark"), F.instr("value", ">").alias("end"))
    tags = cut.select("source_file", "mark", (F.col("end") == 0).alias("cut"), F.when(F.col("end") > 0, F.substr("value", F.col("end") + 1)).otherwise("").alias("said"))
    begins = F.lower(F.left("mark", F.lit(max(map(len, header.values())))))
    shown = F.when(reduce(lambda a, b: a | b, (F.startswith(begins, F.lit(t)) for t in header.values())), text.strip(F.col("said")))
    filled = F.when(F.ascii("said").between(33, 126), True).otherwise(F.col("said").rlike(r"(?U)\S"))
    marks = tags.groupBy("source_file", "mark", shown.alias("shown")).agg(F.count("*").alias("n"), F.max(filled).alias("filled"), F.max("cut").alias("cut"))
    found = F.regexp_extract("mark", r"^(/?[^\s>/!?]+)", 1)
    known = [t.lower() for t in (*FRAME, *schemas.PRICE_TAGS.values(), "IsWeighted")]
    closing = F.startswith("tag", F.lit("/"))
    opening, alone = (F.col("tag") != "") & ~closing, F.endswith("mark", F.lit("/"))
    hides = F.startswith("mark", F.lit("!")) | ((F.length("mark") - F.length(F.replace("mark", F.lit('"')))) % 2 > 0) | ((F.length("mark") - F.length(F.replace("mark", F.lit("'")))) % 2 > 0)
    of = lambda which, c: F.max(F.when(which, c))
    left = F.sum(F.when(closing, -F.col("n")).when(opening & ~alone, F.col("n")).otherwise(0))
    kinds = marks.withColumn("tag", found).groupBy("source_file", F.ltrim("tag", F.lit("/")).alias("name")).agg(  # a row an element's name
        F.sum(F.when(opening, F.col("n"))).alias("opened"), F.sum(F.when(closing, F.col("n"))).alias("closed"), left.alias("left"), of(F.col("tag") != "", F.col("cut")).alias("cut"),
        of(opening, F.col("shown")).alias("said"), of(opening, F.col("filled")).alias("filled"), of(opening, alone).alias("empty"), F.max(hides).alias("hides"),
    ).withColumn("tag", F.lower("name"))
    around = F.col("opened").isNotNull() & ~F.col("tag").isin(known) & ~F.col("filled") & ~F.col("empty")
    one = lambda t, c: F.max(F.when(F.col("tag") == t, F.col(c)))
    total = lambda t, c: F.sum(F.when(F.col("tag") == t, F.col(c)))
    broken = (F.col("left") != 0) | F.coalesce("cut", F.lit(False))
    torn = F.max(broken & F.col("tag").isin(["root", "items", *header.values()])) | (F.max(broken) & ~F.max("hides"))
    heads = kinds.groupBy("source_file").agg(*(text.none_if_empty(one(t, "said")).alias(c) for c, t in header.items()), total("items", "opened").alias("opened"), total("items", "closed").alias("closed"), total("root", "closed").alias("ended"), F.max(around).alias("others"), torn.alias("torn"))
    items = reader.format("xml").options(rowTag="Item", ignoreSurroundingSpaces="false", columnNameOfCorruptRecord="_corrupt_record").schema(schemas.PRICE_ITEM).load(paths)
    rows = items.select(F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("position"), F.struct(*(c for c in items.columns if c != "_corrupt_record")).alias("i"), "_corrupt_record")
    broken = rows.groupBy("source_file").agg(F.max(F.col("_corrupt_record").isNotNull()).alias("broken"), F.count("i.ItemCode").alias("coded"))
    day = text.day_of(F.col("source_file"), text.PRICE_FULL)
    whole = (F.col("opened") == 1) & (F.col("closed") == 1) & ~F.coalesce("broken", F.lit(False))
    reason = F.when(F.col("torn"), "malformed").when(F.col("opened").isNull() & F.col("ended").isNotNull(), "empty").when(~F.coalesce(whole, F.lit(False)), "malformed").when(day.isNull(), "no date in name").when(F.col("others"), "other items")
    files = heads.join(broken, "source_file", "left").select("source_file", *header, day.alias("extraction_date"), reason.alias("reason"), F.coalesce("coded", F.lit(0)).alias("coded"))
    return rows, files


def price_rows_of_records(rows: DataFrame, files: DataFrame) -> DataFrame:
    """price_rows of records and judged files, a row a file."""
    used = files.where("reason is null").drop("reason", "coded")
    return _price_columns(rows.where("_corrupt_record is null").join(F.broadcast(used), "source_file"))


def store_rows(parsed: DataFrame) -> DataFrame:
    """The store columns and `position`, one row a store. Ids are cleaned, other text stays as it is."""
    head = ("source_file", "extraction_date", "chain_id", "chain_name")
    docs = parsed.select("source_file", "extraction_date", *_header("chain_id", "chain_name"), F.col("doc.SubChains.SubChain").alias("subs"))
    groups = docs.select(*head, F.posexplode("subs").alias("group", "g")).select(*head, "group", "g.SubChainID", "g.SubChainName", F.col("g.Stores.Store").alias("stores"))
    stores = groups.select(*head, "group", "SubChainID", "SubChainName", F.posexplode("stores").alias("place", "s"))
    ids = {"chain_id": F.col("chain_id"), "sub_chain_id": F.col("SubChainID")} | {c: F.col(f"s.{schemas.STORE_TAGS[c]}") for c in ("store_id", "bikoret_no", "store_type")}
    names = {"sub_chain_name": F.col("SubChainName")} | {c: F.col(f"s.{schemas.STORE_TAGS[c]}") for c in ("store_name", "address", "city")}
    rows = stores.select(
        *(text.integer_text(c).alias(n) for n, c in ids.items()), "chain_name", *(c.alias(n) for n, c in names.items()), F.col("s.ZIPCode").alias("zip_code"),
        "source_file", F.col("extraction_date").cast("string").alias("extraction_date"), (F.col("group").cast("long") * (1 << 32) + F.col("place")).alias("position"),
    )
    return rows.select(*schemas.STORES, "position")


def promotion_trees(parsed: DataFrame) -> DataFrame:
    """One row a promotion: cleaned columns, `position`, and `groups`, an array of structs with an array `items`; both
    arrays are empty, not null, where there is nothing."""
    clean = lambda c: text.optional_text(c)
    ids = ("chain_id", "sub_chain_id", "store_id", "bikoret_no")
    docs = parsed.select("source_file", "extraction_date", *(clean(c).alias(n) for n, c in zip(ids, _header(*ids), strict=True)), F.col("doc.Promotions.Promotion").alias("promotions"))
    rows = docs.select("source_file", "extraction_date", *ids, F.posexplode("promotions").alias("position", "p"))
    fields = lambda e, tags: [clean(e[t]).alias(c) for c, t in tags.items()]
    items = lambda g: F.transform(F.coalesce(g["PromotionItems"]["PromotionItem"], F.array()), lambda i: F.struct(*fields(i, schemas.PROMOTION_ITEM_TAGS)))
    groups = F.transform(F.coalesce(F.col("p.Groups.Group"), F.array()), lambda g: F.struct(*fields(g, schemas.GROUP_TAGS), items(g).alias("items")))
    rows = rows.select("*", *fields(F.col("p"), schemas.PROMOTION_TAGS), groups.alias("groups"))
    return rows.withColumn("extraction_date", F.col("extraction_date").cast("string")).select(*schemas.PROMOTIONS, "position", "groups")


def flatten_promotions(trees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(promotions, groups, items) with the keys of what they belong to. A promotion without its key goes with all below
    it, a group without an id with its items, an item without a code alone. Persist the trees before; all three read them."""
    known = trees.dropna(subset=["chain_id", "store_id", "promotion_id"])
    key = ["chain_id", "store_id", "promotion_id", "extraction_date", "source_file", "position"]
    groups = known.select(*key, F.posexplode("groups").alias("group_at", "g")).where("g.group_id is not null")
    inner = groups.select(*key, "group_at", F.col("g.group_id").alias("group_id"), F.col("g.items").alias("items"))
    items = inner.select(*key, "group_at", "group_id", F.posexplode("items").alias("item_at", "i")).where("i.item_code is not null")
    return (
        known.drop("groups"),
        groups.select(*(c for c in key), "group_at", *(f"g.{c}" for c in schemas.GROUP_TAGS)),
        items.select(*key, "group_at", "item_at", "group_id", *(f"i.{c}" for c in schemas.PROMOTION_ITEM_TAGS)),
    )

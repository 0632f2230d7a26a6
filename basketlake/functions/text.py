"""Column functions on the text of feeds: blanks, file names, addresses, typed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNKNOWN = "לא ידוע"
EXCLUDED_CHAIN, EXCLUDED_STORE = "7290058140886", "039"


@dataclass(frozen=True)
class Feed:
    """How the files of one data set are named: glob, lower-case name prefix, parts at least, endings."""

    label: str
    glob: str
    prefix: str
    least_parts: int
    endings: tuple[str, ...]
    strict_day: bool  # the day is a part of exactly 8 characters; else its first 8 count


PRICE_FULL = Feed("PriceFull", "*PriceFull*", "pricefull", 5, (".gz",), True)
STORES = Feed("Stores", "*Stores*", "stores", 4, (".gz", ".xml"), False)
PROMO_FULL = Feed("PromoFull", "*PromoFull*", "promofull", 5, (".gz",), False)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end. Most values have none and are not searched for it."""
    plain = lambda x: F.ascii(x).between(33, 126)
    return F.when(plain(c) & plain(F.substring(c, -1, 1)), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def optional_text(c: Column) -> Column:
    """Stripped; null if nothing is left."""
    return none_if_empty(strip(c))


def integer_text(c: Column) -> Column:
    """Stripped; null if nothing is left or the text says "unknown"."""
    return F.nullif(optional_text(c), F.lit(UNKNOWN))


def first_filled(a: Column, b: Column) -> Column:
    return F.coalesce(none_if_empty(a), b)


def is_excluded_store(c: Column, store: str = EXCLUDED_STORE) -> Column:
    """Equal to the store after spaces and leading zeros are gone; null is not."""
    return F.coalesce(F.ltrim(strip(c), F.lit("0")) == store.lstrip("0"), F.lit(False))


def _stem_parts(name: Column, feed: Feed) -> Column:
    """The parts of a name between hyphens, without its ending; null if it has none of the feed's endings."""
    out = F.lit(None).cast("array<string>")
    for ending in reversed(feed.endings):
        out = F.when(F.endswith(F.lower(name), F.lit(ending)), F.split(F.substr(name, F.lit(1), F.length(name) - len(ending)), "-")).otherwise(out)
    return out


def snapshot_of(name: Column, feed: Feed) -> Column:
    """struct(store_id, date, time) of a file name of the feed, null for other names."""
    parts = _stem_parts(name, feed)
    fits = F.startswith(F.lower(name), F.lit(feed.prefix)) & (F.size(parts) >= feed.least_parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when(fits, F.struct(at(-3).alias("store_id"), at(-2).alias("date"), at(-1).alias("time")))


def day_of(name: Column, feed: Feed) -> Column:
    """The date in a file name, null where there is none."""
    stem = F.regexp_replace(name, r"(?i)\.[^.]*$", "")
    parts = F.split(stem, "-")
    text = F.try_element_at(parts, F.lit(-2))
    day = F.when(F.length(text) == 8, text) if feed.strict_day else F.left(text, F.lit(8))
    return F.when((F.size(parts) >= feed.least_parts) & day.rlike("^[0-9]{8}$"), F.try_to_date(day, "yyyyMMdd"))


def is_excluded_file(name: Column, chain: str = EXCLUDED_CHAIN, store: str = EXCLUDED_STORE) -> Column:
    """A promotion file of the chain whose name has the excluded store."""
    found = snapshot_of(name, PROMO_FULL)
    return F.startswith(F.lower(name), F.lit(PROMO_FULL.prefix + chain)) & is_excluded_store(found["store_id"], store)


def is_excluded_header(chain_id: Column, store_id: Column, chain: str = EXCLUDED_CHAIN, store: str = EXCLUDED_STORE) -> Column:
    """A document whose own header says so."""
    return F.coalesce(strip(chain_id) == chain, F.lit(False)) & is_excluded_store(store_id, store)


def file_name_of(url: Column) -> Column:
    """Last segment of an address's path; a query or fragment is not part of it."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/]*", "")
    return F.regexp_extract(path, r"([^/]*)$", 1)


def absolute_url(base: str, href: Column) -> Column:
    """An address as seen from a base page: absolute, of the same scheme, host or folder; dots in its path resolved."""
    base_col = F.lit(base)
    origin = F.regexp_extract(base_col, r"^([^:/]+://[^/?#]*)", 1)
    page = F.regexp_extract(base_col, r"^([^?#]*)", 1)
    folder = F.when(F.regexp_extract(page, r"^[^:/]+://[^/]*(/.*)?$", 1) == "", F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    joined = (
        F.when(href == "", base_col)
        .when(href.rlike(r"^(?i:[a-z][a-z0-9+.-]*:)"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base_col, r"^([^:/]+:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(href.rlike(r"^[?#]"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
    path = F.regexp_extract(joined, r"^[^:/]+://[^/?#]*([^?#]*)", 1)
    dotted = path.rlike(r"/\.\.?(/|$)")
    keep = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    clean = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), keep), "/")
    return F.when(dotted, F.concat(F.regexp_extract(joined, r"^([^:/]+://[^/?#]*)", 1), clean, F.regexp_extract(joined, r"([?#].*)$", 1))).otherwise(joined)


def manifest_time(file_date: Column) -> Column:
    """struct(date, time) of a listing's time, cut at the first space; null without one."""
    parts = F.split(file_date, " ", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("date"), parts[1].alias("time")))


def boolean_of(c: Column) -> Column:
    """0/1 and the usual words; null for others."""
    return _boolean(strip(c))


def _boolean(stripped: Column) -> Column:
    word = F.lower(stripped)
    return F.when(word.isin("1", "t", "true", "y", "yes", "on"), F.lit(True)).when(word.isin("0", "f", "false", "n", "no", "off"), F.lit(False))


def may_be_number(c: Column) -> Column:
    """False for text with characters that no number has; most numbers, from their first and last digit, aren't searched."""
    digit = lambda x: F.ascii(x).between(48, 57)
    return (digit(c) & digit(F.substring(c, -1, 1))) | ~c.rlike(r"(?U)[^\s\p{Cntrl}\deE+.-]")


def is_number(kind: str) -> bool:
    return kind.startswith(("int", "bigint", "long", "decimal"))


def castable(c: Column, number: bool) -> Column:
    """Text as `cast_stripped` takes it. A cast that fails costs as much as a hundred others, so words don't become numbers."""
    return F.when(may_be_number(c), strip(c)) if number else strip(c)


def cast_stripped(c: Column, kind: str) -> Column:
    return _boolean(c) if kind == "boolean" else c.try_cast(kind)


def typed(c: Column, kind: str) -> Column:
    """Text as a typed value, null where it is not one."""
    return c if kind == "string" else cast_stripped(castable(c, is_number(kind)), kind)

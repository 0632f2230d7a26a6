"""Landed files and listings: which files there are, which are wanted, which are new."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from basketlake.functions import text
from basketlake.functions.text import Feed
from basketlake.operators.latest import first_per_key, latest_daily_snapshots

LISTING = "path string, file_name string, extract_type string, chain string, length long, modified timestamp"
#: Caps of a trial run; a full run has none.
TRIAL_FILES, TRIAL_PAGES = 3, 2
MANIFEST = "fileType string, fileName string, fileDate string, branchNumber string"


def list_files(spark: SparkSession, folder: str, feed: Feed, recursive: bool = False) -> DataFrame:
    """The feed's files in a folder, by path, with data set and chain from .../<data set>/<chain>/<file>. Contents are
    not read. A folder that isn't there has no files."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", feed.glob).option("recursiveFileLookup", recursive).load(folder)
    except AnalysisException:
        return spark.createDataFrame([], LISTING)
    parts = F.split("path", "/")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return found.select("path", part(-1).alias("file_name"), part(-3).alias("extract_type"), part(-2).alias("chain"), "length", F.col("modificationTime").alias("modified")).orderBy("path")


def list_all_files(spark: SparkSession, root: str, feed: Feed = text.PRICE_FULL) -> DataFrame:
    """The feed's files under all chains' folders."""
    return list_files(spark, root, feed, recursive=True)


def require_files(listing: DataFrame, folder: str, feed: Feed) -> DataFrame:
    if listing.isEmpty():
        raise FileNotFoundError(f"no {feed.label} files in {folder}")
    return listing


def _placed(files: DataFrame, entries: Column) -> DataFrame:
    """One row for each entry of whole files (path, value), with `position`: its place over all files in order of path."""
    order = files.select("path").withColumn("file", F.row_number().over(Window.orderBy("path")) - 1)  # a row a listing file
    listed = files.select("path", F.posexplode(entries).alias("place", "entry"))
    placed = listed.join(F.broadcast(order), "path")
    return placed.select("entry", (F.col("file").cast("long") * (1 << 32) + F.col("place")).alias("position"))


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_manifest_json(spark: SparkSession, path: str, file_type: str) -> DataFrame:
    """Entries of a JSON listing of one type, in any case; position is their place in the whole listing."""
    entries = F.from_json("value", f"array<struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in MANIFEST.split(', '))}>>")
    return wanted_entries(_placed(_whole_files(spark, path), entries).select("entry.*", "position"), file_type)


def wanted_entries(listed: DataFrame, file_type: str) -> DataFrame:
    return listed.where(F.lower(F.coalesce("fileType", F.lit(""))) == file_type.lower())


def read_manifest_names(spark: SparkSession, path: str) -> DataFrame:
    """`name`, one a line; position as above. Blank lines are no names."""
    return _placed(_whole_files(spark, path), F.split("value", "\r?\n")).select(F.col("entry").alias("name"), "position").where("name <> ''")


def snapshots_of_names(names: DataFrame, feed: Feed, chain: str | None = None, store: str | None = None) -> DataFrame:
    """(name, position) to (store_id, date, time, position, payload). Names of another form are left out; with a chain
    and store, so are that store's, before any date is looked at."""
    found = names.select("position", F.col("name").alias("payload"), text.snapshot_of(F.col("name"), feed).alias("s")).where("s is not null")
    if chain is not None and store is not None:
        found = found.where(~text.is_excluded_file(F.col("payload"), chain, store))
    return found.select("s.store_id", "s.date", "s.time", "position", "payload")


def snapshots_of_links(links: DataFrame, feed: Feed) -> DataFrame:
    """(url, position) to snapshots; the file name is the address's last segment."""
    named = links.select("position", F.col("url").alias("payload"), text.snapshot_of(text.file_name_of(F.col("url")), feed).alias("s"))
    return named.where("s is not null").select("s.store_id", "s.date", "s.time", "position", "payload")


def snapshots_of_manifest(entries: DataFrame) -> DataFrame:
    """(fileName, fileDate, branchNumber, position) to snapshots; entries without a branch or a time are left out."""
    timed = entries.select("position", F.col("fileName").alias("payload"), F.col("branchNumber").cast("string").alias("store_id"), text.manifest_time(F.col("fileDate")).alias("t"))
    return timed.where("t is not null and store_id is not null").select("store_id", "t.date", "t.time", "position", "payload")


def links_of(html: Column) -> Column:
    """The href of each <a>, in order, quoted either way or not at all."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    plain = F.transform(raw, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    return F.transform(plain, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def extract_links(pages: DataFrame, base_url: str, token: str = "") -> DataFrame:
    """(page, html) to (page, position, href, url): the links whose address has the token in any case."""
    found = pages.select("page", F.posexplode(links_of(F.col("html"))).alias("position", "href")).where(F.contains(F.lower("href"), F.lit(token.lower())))
    return found.withColumn("url", text.absolute_url(base_url, F.col("href")))


def new_links(links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(page, position, url) to the first link of each file name, of the pages before the first page without a new
    name (a page without links counts as one); `file_name` is added. A signed address's query may change, its name not."""
    named = links.withColumn("file_name", text.file_name_of(F.col("url")))
    if max_pages is not None:
        named = named.where(F.col("page") <= max_pages)
    first = first_per_key(named, ["file_name"], [F.asc("page"), F.asc("position"), F.asc("url")])
    # pages count from their least number on; the first one without a new name ends the listing
    fresh = first.select("page").distinct()
    after = fresh.select((F.col("page") + 1).alias("page")).unionByName(named.agg(F.min("page").alias("page")))
    end = after.join(fresh, "page", "left_anti").agg(F.min("page")).first()[0]
    return first.where(F.col("page") < F.lit(end)).select(*named.columns)


def select_snapshots(snapshots: DataFrame, landed: DataFrame, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(to fetch, already landed): the newest snapshot of each store, of the newest day; `max_files` of them in a trial.
    Payloads are names or addresses; file_name, a name's last segment, tells whether it has landed."""
    chosen = latest_daily_snapshots(snapshots, max_files).withColumn("file_name", text.file_name_of(F.col("payload")))
    return skip_existing(chosen, landed)


def land_documents(docs: DataFrame, folder: str) -> int:
    """Writes documents (source_file, content) as files of these names, packed if a name ends in .gz; returns how many.
    Tasks write the contents; the driver gives each file its name, a rename a file. With a column `place`, a document comes in
    rows, which are written one after the other in its order, so no document is ever one value."""
    order = ["place"] if "place" in docs.columns else []
    spark = docs.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(folder))
    n = 0
    for packed in (True, False):
        some = docs.where(F.endswith(F.lower("source_file"), F.lit(".gz")) == packed)
        written = f"{folder}/_landing-{uuid.uuid4().hex}"
        named = some.select("source_file", *order, F.col("content").alias("value")).repartition("source_file")
        named = named.sortWithinPartitions("source_file", *order).drop(*order)
        named.write.partitionBy("source_file").option("compression", "gzip" if packed else "none").text(written)
        for status in fs.listStatus(fs_path(written)):
            name = status.getPath().getName()
            if name.startswith("source_file="):
                (part,) = [f.getPath() for f in fs.listStatus(status.getPath()) if not f.getPath().getName().startswith(("_", "."))]
                fs.rename(part, fs_path(f"{folder}/{name.removeprefix('source_file=')}"))
                n += 1
        fs.delete(fs_path(written), True)
    return n


def skip_existing(selected: DataFrame, landed: DataFrame, key: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(to fetch, already landed) of the selected files; both are parsed later."""
    names = landed.select(key)
    return selected.join(names, key, "left_anti"), selected.join(names, key, "left_semi")

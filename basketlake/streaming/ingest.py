"""Landed files as a stream: each file is merged once; a later run takes only what has come since.

The stream's source is the listing of files, not their contents: a batch is so many paths, and the documents are read from
them as a folder's are. So a file that can't be unpacked is still a file of its batch, and is stored as rejected.

A batch counts once. The query's id and the batch's number stand in the manifest of each table that the batch has
committed, with the data; when a batch is run again because the last run ended before its checkpoint, commits that are
there already are left out, and the others are made.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketlake.plans import jobs
from basketlake.sources import documents
from basketlake.sources.tables import Tables

LISTED = "path string, modificationTime timestamp, length long, content binary"


def query_id(tables: Tables, checkpoint: str) -> str:
    """The id that a checkpoint folder keeps for its query over all runs."""
    return json.loads(tables.spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]


def stream_ingest(tables: Tables, folder: str, extract_type: str, checkpoint: str, max_files: int = 1000, options: jobs.Options | None = None) -> StreamingQuery:
    """Starts a run over all files of a data set that no earlier run with this checkpoint has merged, `max_files` a batch.
    Each batch goes through the same load, with the same checks, as a folder does; rows and files that can't be used are
    stored as rejected, and the state of each file is noted in `files`. With `skip_loaded`, files that a job has loaded are
    left out."""
    feed = jobs.FEEDS[extract_type]
    options = options or jobs.Options(mode="quarantine")
    reader = tables.spark.readStream.format("binaryFile").schema(LISTED).option("pathGlobFilter", feed.glob).option("recursiveFileLookup", True)
    files = reader.option("maxFilesPerTrigger", max_files).load(folder).select("path", "length")

    def merge(batch: DataFrame, number: int) -> None:
        files = sorted((r["path"], r["length"]) for r in batch.collect())  # max_files at most
        paths = [path for path, _ in files]
        parts = F.split("path", "/")
        listing = tables.spark.createDataFrame(files, "path string, length long").select(
            "path", "length", F.element_at(parts, -1).alias("file_name"), F.coalesce(F.try_element_at(parts, F.lit(-3)), F.lit("")).alias("extract_type"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("chain")
        )
        if options.skip_loaded:
            known = {tuple(r) for r in jobs.file_states(tables).where("state = 'loaded'").join(listing, ["extract_type", "chain", "file_name"], "left_semi").select("extract_type", "chain", "file_name").collect()}
            paths = [p for p in paths if tuple(p.split("/")[-3:]) not in known]
            listing = listing.where(F.col("path").isin(paths))
        if paths:
            with tables.batch(query_id(tables, checkpoint), number):
                large = jobs.large_files(listing, feed, options)
                small = [p for p in paths if p not in large]
                contents = documents.read_documents(tables.spark, small, feed) if small else tables.spark.createDataFrame([], "source_file string, content string")
                jobs.LOADS[extract_type](tables, listing, contents, options)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

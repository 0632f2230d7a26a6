"""The queries of this subpackage's operators, each over the whole of its tables, and their SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.llm import chat, decontam, fill_middle, filter_audit, jaccard, media, packing, pii, quality, recompression, sharding, shared, token_files, toxicity


def vocabulary() -> str:
    """The public byte-level BPE vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


#: Blocks of an image's side and pixels of a block's side.
BLOCKS, BLOCK = 8, 6
SIDE = BLOCKS * BLOCK


def mosaic(top: int, left: int, height: int, width: int, gain: float, lift: float):
    """Pixels of a part of the mosaic that an embedding makes: one grey block a value."""
    value = lambda i: F.get("embedding", (F.floor((top + F.floor(i / width)) / BLOCK) * BLOCKS + F.floor((left + i % width) / BLOCK)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: (value(i) * 400 * gain + lift).cast("float"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings drawn as mosaics. Queries: the rows whose vec_id is divisible by 100, cropped, darkened and with
    another contrast. One row for each row of the table, with the class of queries that it is a copy of; further rows for
    further classes: vec_id, image_class (the smallest row of the same image), copy_of (the class, null for none), links
    (queries in that class), matches (keypoints that agree). A query also has its own class, asked_class. Row i is a copy
    of query q where copy_of of i is asked_class of q, so all links are here, in rows that grow with the table."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    scratch = shared.Scratch(spark, "mosaics")
    keys = [F.xxhash64("embedding").alias("k1"), F.hash("embedding").alias("k2")]
    images = rows.groupBy("embedding").agg(F.min("vec_id").alias("class")).select("*", *keys)
    images = scratch.save(images, "images")
    dealt = images.repartition(4 * spark.sparkContext.defaultParallelism, "class")  # drawing is the work, not reading
    whole = dealt.select("class", mosaic(0, 0, SIDE, SIDE, 1.0, 0.0).alias("pixels"), F.lit(SIDE).alias("height"))
    edited = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), mosaic(5, 3, SIDE - 8, SIDE - 6, 0.8, -12.0).alias("pixels"), F.lit(SIDE - 8).alias("height"))
    classes, found = media.copy_classes(whole, edited)
    links = classes.groupBy("asked_class").agg(F.count("*").alias("links"))
    found = found.join(links, "asked_class").join(images.select("class", "k1", "k2"), "class")
    found = scratch.save(found.select("k1", "k2", F.col("class").alias("image_class"), F.col("asked_class").alias("copy_of"), "links", "matches"), "found")
    own = classes.withColumnRenamed("query", "vec_id")
    out = rows.select("vec_id", *keys).join(shared.bounded(found), ["k1", "k2"], "left").join(shared.bounded(own), "vec_id", "left")
    return out.select("vec_id", "image_class", "copy_of", "links", "matches", "asked_class")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 8)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mails: each message below the quoted one before it, and that one's own quotation. The table
    has no quotes itself. The result has the conversations in reply order: each message's own text again, and which message
    it replies to; what each row links to is in the counts."""
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quoted = lambda mark: F.concat(F.lit(mark), F.regexp_replace("text", "\n", f"\n{mark}"))
    last = plain.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    one = last.select("conv_id", (F.col("turn") + 1).alias("turn"), quoted("> ").alias("one"))
    two = last.select("conv_id", (F.col("turn") + 2).alias("turn"), quoted(">> ").alias("two"))
    mails = plain.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.concat_ws("\n", "two", "one", "text").alias("text"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias(c)
    return chat.assembled(chat.unquoted_conversations(mails)).select("conv_id", "piece", joined("turns"), joined("replies"), "text", "n_passages", "n_linked")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared.shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), path, vocabulary())
    return token_files.token_file_digests(spark, path)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), n=4, percent=85)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.remove_repeats(documents(spark, sf_dir), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), labels(spark, sf_dir))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_middle(documents(spark, sf_dir))
    digest = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"), digest(back, "restored_sha256"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_media": op2_media,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_decontam": op7_decontam,
    "op8_token_files": op8_token_files,
    "op9_jaccard": op9_jaccard,
    "op10_packing": op10_packing,
    "op11_recompression": op11_recompression,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_middle": op13_fill_middle,
}

#: Word n-gram sets of documents, their links, and the smallest doc_id that links reach.
OP9_SQL = r"""
WITH RECURSIVE
tokens AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM tokens),
sizes AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN grams USING (doc_id) GROUP BY d.doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n
"""

#: What unquoting the mails must give back, from the plain conversations.
OP5_SQL = r"""
WITH m AS (SELECT conv_id, turn, role, text, regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS own FROM conversations),
pieces AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(p), '[ \t\r\n]+', ' ', 'g')) AS piece
  FROM (SELECT conv_id, turn, unnest(list_concat([own], string_split_regex(own, '\n[ \t]*\n'), string_split(own, chr(10)))) AS p FROM m)),
firsts AS (SELECT conv_id, piece, min(turn) AS at FROM pieces WHERE piece <> '' GROUP BY 1, 2),
quoted AS (SELECT conv_id, turn, trim(regexp_replace(lower(min(text)), '[ \t\r\n]+', ' ', 'g')) AS q FROM m GROUP BY 1, 2),
linked AS (SELECT q.conv_id, q.turn, q.q, f.at FROM quoted q LEFT JOIN firsts f ON f.conv_id = q.conv_id AND f.piece = q.q),
turned AS (SELECT m.conv_id, m.turn, row_number() OVER (PARTITION BY m.conv_id, m.turn ORDER BY m.own NULLS FIRST, m.role NULLS FIRST) - 1 AS repeat,
  '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || m.own || chr(10) AS formatted, coalesce(a.at, b.at, a.turn) AS reply_to_turn,
  CAST((coalesce(a.q, '') <> '') AS BIGINT) + CAST((coalesce(b.q, '') <> '') AS BIGINT) AS n_passages,
  CAST(a.at IS NOT NULL AS BIGINT) + CAST(b.at IS NOT NULL AS BIGINT) AS n_linked
  FROM m LEFT JOIN linked a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN linked b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
pieces_of AS (SELECT conv_id, turn // 1000 AS block, repeat // 1000 AS again, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn, repeat) AS turns,
  string_agg(coalesce(CAST(reply_to_turn AS VARCHAR), '-'), ',' ORDER BY turn, repeat) AS replies,
  string_agg(formatted, '' ORDER BY turn, repeat) AS text, CAST(sum(n_passages) AS BIGINT) AS n_passages, CAST(sum(n_linked) AS BIGINT) AS n_linked FROM turned GROUP BY 1, 2, 3)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY block, again) - 1 AS piece, turns, replies, text, n_passages, n_linked FROM pieces_of
"""

#: CRC-32 by its rule: a table of 256 values, and a step for each byte of the text.
_CRC_TABLE = [functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]

#: The shard of each row by the middle of its bytes among all bytes.
OP3_SQL = f"""
WITH sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
  list_transform(regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '..'), lambda x: CAST(('0x' || x) AS BIGINT)) AS bytes FROM documents),
summed AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, {_CRC_TABLE}[1 + (xor(c, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM sized),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS place,
  sum(size) OVER () AS whole FROM summed),
dealt AS (SELECT *, CAST(CAST(2 * upto - size AS HUGEINT) * 8 // (2 * whole) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM dealt
"""

#: Every window of 20 words that has an earlier equal one, and the words that such windows cover.
OP11_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM words WHERE len(w) >= 20),
keyed AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS k FROM windows),
numbered AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM numbered WHERE nth > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

#: The five filters, all orders of them, and what each step does to the rows of a mask.
OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN split.doc_id > least THEN 'E' ELSE '' END AS f
  FROM split LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT o, s, substr(o, s, 1) AS letter, substr(o, 1, s - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
met AS (SELECT *, contains(f, letter) AS fails, length(f) > length(translate(f, earlier, '')) AS gone FROM counted, steps),
summed AS (SELECT part, o, s, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (f = letter), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM met GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM summed
"""

#: Cuts from the hash of the id, and the parts in their order; what is restored is the text itself.
OP13_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, len(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (SELECT doc_id, t, CAST(n AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS b,
  CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS e FROM hashed),
formed AS (SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, m) AS middle, substr(t, p + m + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(m AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
"""

ORACLE: dict[str, str] = {"op3_sharding": OP3_SQL, "op5_chat": OP5_SQL, "op9_jaccard": OP9_SQL, "op11_recompression": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_middle": OP13_SQL}

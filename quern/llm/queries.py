"""The thin queries of this subpackage: each derives its contract's columns from an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chains, compaction, decontam, html_extract, langid, near_vectors, packing, simhash, token_store, warc
from quern.llm.common import discard, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = packing.pieces(docs, path, 1024, digest=lambda ids: token_store.crc32(ids)[0], with_ids=False)
    placed, _ = packing.place(parts, 1024)
    return placed.select("doc_id", "piece", "start", "length", F.col("digest").alias("ids_crc32"), "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is written, looked up by its URL in the index, and read back."""
    folder, pages = warc.new_folder(spark), table(spark, sf_dir, "pages")
    directory = warc.write_index(warc.write_archives(pages, folder), folder)
    back = warc.read_records(warc.find(directory, pages), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of over 50 words that a document shares with one of a lesser id."""
    return chains.passages(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = decontam.index(table(spark, sf_dir, "documents"))
    found = decontam.search(shards, table(spark, sf_dir, "benchmark"))
    discard(shards)
    return found.select(
        F.col("id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_store.write_shards(table(spark, sf_dir, "documents"), token_store.new_folder(spark), path)
    return token_store.read_shards(manifest, token_store.crc32, "ids_crc32 long")


def held_out() -> Column:
    """Whether a document takes no part in fitting."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(table(spark, sf_dir, "documents").where(~held_out()))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = langid.identify(docs, language_model(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op9_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches of small shards, are compacted, and are read from the newest version."""
    store = compaction.ShardStore(spark, compaction.new_folder(spark), target_bytes=64 << 20)
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    store.append_arrivals(table(spark, sf_dir, "documents"), arrival)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op1_best_fit_packing"] = op1_best_fit_packing
QUERIES["op2_warc_index"] = op2_warc_index
ORACLES["op2_warc_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""
QUERIES["op3_html_extraction"] = op3_html_extraction
QUERIES["op4_substring_dedup"] = op4_substring_dedup
QUERIES["op5_embedding_near_dedup"] = op5_embedding_near_dedup
QUERIES["op6_decontamination"] = op6_decontamination
ORACLES["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM di),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
QUERIES["op7_token_binary"] = op7_token_binary
QUERIES["op8_language_id"] = op8_language_id
QUERIES["op9_size_tiered_sharding"] = op9_size_tiered_sharding
ORACLES["op9_size_tiered_sharding"] = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
QUERIES["op10_simhash_near_dedup"] = op10_simhash_near_dedup

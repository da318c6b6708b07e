"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.llm import best_fit, bpe_count, cas_store, chat_format, decontam, flac, html_density, packing, repair, simhash_trie, spelling, toxicity, warc
from ticksmith.llm.tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas_store.store_and_read(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


#: Conversation -1: both turns' text is made of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.format_and_read(chat_format.turn_records(rows.unionByName(extra)))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(_table(spark, sf_dir, "pages"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.to_json("offending").alias("offending"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(_table(spark, sf_dir, "pages"))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.store_and_read(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(_table(spark, sf_dir, "documents"), typo_every=97))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, limit=1024)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.edits(repair.damaged(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_store, op2_token_counts, op3_chat_format, op4_html_text, op5_vector_packing, op6_toxicity, op7_warc_revisits, op8_simhash_trie, op9_flac_media, op10_decontamination]
    found += [op11_spelling_variants, op12_best_fit_packing, op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """WARC revisits are plain grouping; the others need tokenizers, hashes or parsers that SQL lacks."""
    return {"op7_warc_revisits": OP7_SQL}


#: DuckDB has hexadecimal SHA-1 only: five bits at a time, the digits of base32.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexes FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, hexes,
        array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda i:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hexes, (1 + 10 * g)::INT, 10))::UBIGINT) >> (35 - 5 * i)::UBIGINT) & 31)::INT, 1)), '')), '') AS payload_digest
      FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hexes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""

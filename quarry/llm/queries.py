"""The queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, class_lm, exact_dedup, minhash, packing, pii, simhash, toxicity, warc, wordpiece
from quarry.llm.common import materialize, scratch_path, table



def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates: ``spark.quarry.pii.key`` of the session; the default is for tests."""
    return spark.conf.get("spark.quarry.pii.key", "quarry")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.BPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    lexicon = toxicity.learn(toxicity.sample(docs, table(spark, sf_dir, "labels"), part != 1))
    found = toxicity.scored(docs, lexicon)
    return found.select("doc_id", (part == 1).alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = materialize(warc.read_archives(spark, path, payloads=False))
    return warc.capture_digests(warc.transactions(found))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edit_check(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model, counts = class_lm.train(docs.where(~held_out))
    found = class_lm.score(docs, model, counts, mark=held_out)
    return found.select("doc_id", F.col("mark").alias("held_out"), "n_tokens", "n_known", F.lit(model.items.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, pii_key(spark)).select("doc_id", "text", "n_entities", F.to_json("kinds").alias("kinds"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
            q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS lead FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
                   CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN lead <> page_id THEN lead END AS refers_to
            FROM q
        """,
        "op7_exact_dedup": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY text)
        """,
    }

"""From raw documents to packed training sequences.

``STAGES`` lists the stages in order.  Each takes ``(spark, docs, sf_dir)`` and
works on all that its predecessor kept; all but the last return the columns of
``documents``.  Between stages the rows are written as Parquet in the
session's shared folder, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, packing, pii, simhash, toxicity
from quarry.llm.common import materialize, quoted, released, table, unused
from quarry.llm.queries import pii_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity score rejects go; labels of one part in three are left out of learning, as in the operator's query."""
    learned_from = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    lexicon = toxicity.learn(toxicity.sample(docs, table(spark, sf_dir, "labels"), learned_from))
    score, predicted = unused("score", "predicted")
    return toxicity.scored(docs, lexicon, score=score, predicted=predicted).where(F.col(predicted) == 0).select(quoted(docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays.

    Groups are those of the operator's query (four words, four bits), and among
    what they leave those of texts whose five-word shingles are similar to 0.8 or more.
    """
    return simhash.drop_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; ``n_chars`` follows the text."""
    count, kinds = unused("count", "kinds")
    done = pii.surrogates(docs, pii_key(spark), count=count, kinds=kinds)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(quoted(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised rows with their places in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", replace_personal_data),
    ("best-fit packing", pack),
]

#: A learned score and fingerprints have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir))
        if k:
            released(docs)  # its successor is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

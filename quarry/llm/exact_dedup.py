"""Exact dedup over a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by the text's SHA-256.  A batch is
first reduced to one row per digest (partial aggregation, so a digest that a
third of all rows share costs one row per task), anti-joined with the index by
sort-merge without moving the index, and its new digests are appended.  The
verdict of each digest then joins the documents; that join has a plain
exchange on both sides, so adaptive execution can split a hot digest.

Defined results: a null text counts as empty; of equal texts within a batch
the largest ``doc_id`` stays (a null id only when all are null); rows that
repeat both id and text are all marked ``kept`` when their id is, and of those ``drop_copies``
keeps the one whose columns come first as JSON; a text that
an earlier batch brought in is dropped and ``keep_id`` names the earlier row.
Further columns, whatever their names, are carried along; those that bear a result's name, in any case, give way
in ``exact_dedup`` and stay in ``drop_copies``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_path, materialize, partitions, quoted, scratch_path, text_or_empty, unused, without


RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


class DigestIndex:
    """Digests seen so far: ``digest binary, keep_id, batch string``, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, "digests")
        self.buckets = buckets or max(1, partitions(spark))
        self.id_type = id_type
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)


def verdicts(docs: DataFrame, index: DigestIndex, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per distinct digest of ``docs``: ``digest, keep_id, group_size, fresh``; appends the fresh ones to ``index``."""
    batch = uuid.uuid4().hex
    seen = (
        docs.select(F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"), F.col(id).alias("own_id"))
        .groupBy("digest").agg(F.max("own_id").alias("own_id"), F.count(F.lit(1)).alias("group_size"))
    )
    known = index.read().select(F.col("digest").alias("known_digest"), F.col("keep_id").alias("known_id"))
    # An anti-join finds what is new, and an inner one the earlier keepers; one
    # left join of the reduced batch against the unmoved index gives both.
    both = seen.join(known.hint("merge"), F.col("digest") == F.col("known_digest"), "left")
    rows = materialize(
        both.select("digest", F.when(F.col("known_digest").isNull(), F.col("own_id")).otherwise(F.col("known_id")).alias("keep_id"), "group_size", F.col("known_digest").isNull().alias("fresh"))
    )
    fresh = rows.where("fresh").select("digest", "keep_id", F.lit(batch).alias("batch"))
    index.append(fresh.join(index.read().select("digest").hint("merge"), "digest", "left_anti"))
    return rows


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with ``keep_id, group_size, kept, text_sha256`` for every row, dropped ones too."""
    own = None if index else DigestIndex(docs.sparkSession, id_type=dict(docs.dtypes)[id])
    mark = f"_{uuid.uuid4().hex}"
    found = verdicts(docs, index or own, text=text, id=id)
    if own:
        own.drop()  # the verdicts are written
    found = found.select(*[F.col(c).alias(f"{mark}_{c}") for c in found.columns])
    old = without(docs.columns, *RESULTS)
    rows = docs.withColumn(f"{mark}_own", F.unhex(F.sha2(text_or_empty(text), 256))).join(found.hint("merge"), F.col(f"{mark}_own") == F.col(f"{mark}_digest"))
    return rows.select(
        *quoted(old),
        F.col(f"{mark}_keep_id").alias("keep_id"),
        F.col(f"{mark}_group_size").alias("group_size"),
        (F.col(f"{mark}_fresh") & F.col(id).eqNullSafe(F.col(f"{mark}_keep_id"))).alias("kept"),
        F.lower(F.hex(f"{mark}_own")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, one for each text, in the columns of ``docs``."""
    own = None if index else DigestIndex(docs.sparkSession, id_type=dict(docs.dtypes)[id])
    digest, mark = unused("digest", "mark")
    found = verdicts(docs, index or own, text=text, id=id)
    if own:
        own.drop()
    stay = found.where("fresh").select(F.col("digest").alias(digest), F.col("keep_id").alias(mark))
    own_digest = F.unhex(F.sha2(text_or_empty(text), 256))
    kept = docs.withColumn(f"{digest}_own", own_digest).join(stay.hint("merge"), F.col(f"{digest}_own") == F.col(digest))
    kept = kept.where(F.col(quoted([id])[0]).eqNullSafe(F.col(mark)))
    # Rows that repeat id and text are rare: narrow rows tell whether there are any.
    again = materialize(docs.groupBy(own_digest.alias(f"{mark}_digest"), F.col(id).alias(f"{mark}_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(f"{mark}_digest"))
    if again.isEmpty():
        return kept.select(quoted(docs.columns))
    rows = kept.withColumn(mark, F.struct(*quoted(docs.columns)))
    alone = rows.join(again, F.col(f"{digest}_own") == F.col(f"{mark}_digest"), "left_anti").select(mark)
    repeated = rows.join(again.distinct(), F.col(f"{digest}_own") == F.col(f"{mark}_digest"), "left_semi")
    first = repeated.groupBy(f"{digest}_own").agg(F.min_by(mark, F.to_json(mark)).alias(mark)).select(mark)
    return alone.unionAll(first).select(*[F.col(mark).getField(c).alias(c) for c in docs.columns])

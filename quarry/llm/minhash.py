"""MinHash fingerprints of documents, and near duplicates by bands.

A document is the set of its five-word shingles (words are runs of anything
but ASCII white space, A-Z lower-cased; with fewer words the whole sequence).
Each shingle is a 64-bit number mixed from its words' hashes; ``PERMUTATIONS``
universal hash functions ``a * x + b mod 2**64`` (a odd, so each permutes the
numbers) are taken over all shingles at once in numpy, and of each function
the least value is kept as 16 bits of a mixture of all its bits (its upper bits alone tend to
zero as texts grow).  The likeness of two fingerprints,
the share of equal places, estimates the Jaccard similarity of the sets.

Near duplicates: places are cut into bands; documents with an equal band are
candidates and their Jaccard similarity is taken from the shingle sets.  A band that only
one document has goes first, on the bare key; the groups of the others are searched as in
``simhash.similar_links``, which keeps rows linear in copies and splits large groups.

Defined results: null text counts as empty; texts without words have a
fingerprint of their own, alike among themselves; equal texts have equal
fingerprints; rows that share an id each get a row; a document's neighbour in
the chain of descending ids is found by range, not by one global sort, and
rows with equal ids follow each other by the hash of their text, null ids last.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import id_type, join_hot, map_batches, materialize, partitions, set_hash, shingles
from quarry.llm.components import components

PERMUTATIONS, SEED = 128, 20240229
_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, PERMUTATIONS, dtype=np.uint64)
#: Shingles hashed at once: their table of values stays in a core's cache.
BLOCK = 512


def signature(text: str | None) -> np.ndarray:
    """The fingerprint as ``PERMUTATIONS`` 16-bit numbers."""
    x = shingles(text)
    least = np.full(PERMUTATIONS, ~np.uint64(0))
    for k in range(0, len(x), BLOCK):
        np.minimum(least, (x[k : k + BLOCK, None] * _A + _B).min(axis=0), out=least)
    least = (least ^ (least >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((least ^ (least >> np.uint64(32))) & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) gives way to as much of ``following``'s start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def chained(docs: DataFrame, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows ``part, sentinel, doc_id, text`` whose partitions hold whole ranges of ids in descending order.

    After the rows of a range comes, as a sentinel, the first row of the next
    range (after the last range: of the first).  Range bounds are the largest
    ids of a range partitioning of the ids alone, a value for each range, which a
    task looks up by bisection; texts are moved once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = 4 * partitions(spark)
    tops = rows.select("doc_id").where("doc_id is not null").repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top"))
    bounds = sorted(r.top for r in tops.collect())  # at most ``ranges`` values
    if bounds:
        sent, last = spark.sparkContext.broadcast(bounds), len(bounds)  # ``ranges`` values at most

        @F.pandas_udf("long")
        def place(ids: pd.Series) -> pd.Series:
            """Twice the range, and one more for the range's largest id."""
            found = []
            for i in ids.tolist():
                k = 0 if pd.isna(i) else min(bisect.bisect_left(sent.value, i), last - 1)
                found.append(2 * k + (not pd.isna(i) and sent.value[k] == i))
            return pd.Series(found, dtype="int64")

        kind = id_type(rows, "doc_id")
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        # Whole numbers cross as such: with a null among them pandas would make fractions.
        code = place(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(bounds[0]).cast("bigint")) if whole else F.col("doc_id"))
        rows = rows.withColumn("code", code).withColumn("part", F.shiftright("code", 1).cast("int"))
        top = F.col("doc_id").isNotNull() & (F.col("code") % 2 == 1)
        own = F.struct("part", F.lit(0).alias("sentinel"))
        again = F.struct(((F.col("part") + 1) % last).alias("part"), F.lit(1).alias("sentinel"))
        rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("part")))
        rows = rows.select("doc_id", "text", F.explode(F.when(top, F.array(own, again)).otherwise(F.array(own))).alias("at")).select("at.part", "at.sentinel", "doc_id", "text")
    else:
        rows = rows.select(F.lit(0).alias("part"), F.lit(0).alias("sentinel"), "doc_id", "text")
    return rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "sentinel", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def edit_check(docs: DataFrame, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of the text edited with its neighbour, and how alike they are."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {id_type(docs, id)}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first = held = None  # (part, id, text, signature): of the part's first row, and of the row that waits for its neighbour
        done = False  # the part's sentinel has come

        def pair(row: tuple, following: tuple) -> None:
            new = edited(row[2], following[2])
            own, other = row[3], signature(new)
            out.append((row[1], len(row[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following[3])))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for part, sentinel, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if done and held is None and first and first[0] == part:
                    continue  # a further sentinel, of a row that shares its id
                row = (part, i.as_py(), t.as_py())
                row = (*row, held[3] if held and held[2] == row[2] else signature(row[2]))
                if held and held[0] != part:
                    pair(held, first)
                    held = None
                if held:
                    pair(held, row)
                held, done = (None, True) if sentinel else (row, False)
                if not first or first[0] != part:
                    first = row
                if len(out) >= 1000:
                    yield flush()
        if held:
            pair(held, first)
        if out:
            yield flush()

    return chained(docs, text=text, id=id).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, rows: int = 5, bands: int = 16, group_limit: int = 4096, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, class_id`` of every row: documents of similarity ``threshold`` or more are in one class, directly or through others.

    ``class_id`` is the smallest id in the class (null ids count only if it has no other).  Texts without words
    are one class, equal texts are always.  At similarity 0.8 a pair has some of the 16 bands of 5 places
    in common 998 times in 1000; every pair that has is verified, unless verified links join it already.
    """

    def make():
        def own(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch.column(0), "own": [], "words": [], "shingles": [], "fp": [], "anchors": []}
            for t in batch.column(1):
                x = shingles(t.as_py())
                print_, x = signature(t.as_py()), np.unique(x)
                keys = [xxhash.xxh3_64_intdigest(print_[k * rows : (k + 1) * rows].tobytes(), k) for k in range(bands)]
                out["own"].append(set_hash(x))
                out["words"].append(len(x) > 0)
                out["shingles"].append(len(x))
                out["fp"].append(int(print_[:4].view(">i8")[0]))  # an order that puts like fingerprints side by side
                out["anchors"].append(np.array(keys, np.uint64).view(np.int64))
            return out

        return own

    if rows * bands > PERMUTATIONS:
        raise ValueError(f"{bands} bands of {rows} places are more than {PERMUTATIONS}")
    schema = f"doc_id {id_type(docs, id)}, own bigint, words boolean, shingles bigint, fp bigint, anchors array<bigint>"
    plain = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    features = materialize(map_batches(plain, schema, make))
    links = simhash.similar_links(plain, features.where("words and doc_id is not null"), threshold=threshold, radius=64, group_limit=group_limit)
    roots = components(links)
    rooted = materialize(features.join(roots, F.col("own") == F.col("node"), "left").select("doc_id", F.coalesce("root", "own").alias("root")))
    named = materialize(rooted.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("times")))
    return join_hot(rooted, "root", named, "of", "times", rooted.count()).select("doc_id", "class_id")

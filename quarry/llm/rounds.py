"""Best-fit packing in bulk-synchronous rounds, for sizes of any kind: whole numbers beyond counting, or fractions.

A round range-sorts open documents and gaps together, the largest first and gaps before documents of their
size.  A sweep down each range gives each document its best fit, the smallest gap that the sweep has met and that holds it; what is
left of a gap goes on in the same sweep.  Between ranges, what a range leaves open has a depth, the rank that settles who gets what:
a document without a gap takes the last gap before it at its depth.  Gaps are updated, and such a gap goes to the range of the documents that
asked for it.  Documents that no gap holds by then open new sequences - those over half the
capacity, else as many of the longest as the volume needs - and the next round begins.

A round moves open documents and gaps twice, by range and by depth, and the driver sees two counts of each range.  Within a range
a gap takes any number of documents in a round.

Defined results: a null size counts as 0; a size over the capacity is an error; an empty table gives no rows; ties go by the
numbers that rows get when they are first written.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, released, unused

_SWEPT = "part int, kind int, key bigint, size double, mate bigint, offset double, place bigint"


def _sweep(capacity: float):
    """Documents (kind 1) with the gaps that they take within the range, and what is left of both, with its place from the open end where another range may have use for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), ["part", "kind", "key", "size", "mate", "offset", "place"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
        gaps: list[tuple[float, int]] = []  # in order
        lone, low = 0, capacity

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for low, kind, key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    insort(gaps, (size, key))
                    continue
                at = bisect_left(gaps, (size, -1))
                if at == len(gaps):
                    rows.append((part, 1, key, size, None, None, lone))
                    lone += 1
                    continue
                gap, mate = gaps.pop(at)
                rows.append((part, 1, key, size, mate, capacity - gap, None))
                if gap > size:
                    insort(gaps, (gap - size, mate))
            if rows:
                yield given(rows)
        # Ranges to come hold documents of at most ``low``: gaps below rest for a round.
        first = bisect_left(gaps, (low, -1))
        left = [(part, 0, key, gap, None, None, None) for gap, key in gaps[:first]]
        left += [(part, 0, key, gap, None, None, k) for k, (gap, key) in enumerate(reversed(gaps[first:]))]
        for start in range(0, len(left), 10_000):
            yield given(left[start : start + 10_000])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by depth and range: each document with the last gap before it, and the gaps that are left."""
    held = None
    for batch in batches:
        rows = []
        for level, kind, key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and (held[0] != level or not kind):
                rows.append((0, held[1], held[2], None, None))
                held = None
            if kind:
                rows.append((1, key, size, held[1], held[2]))
                held = None
            else:
                held = (level, key, size)
        if rows:
            yield _settled(rows)
    if held is not None:
        yield _settled([(0, held[1], held[2], None, None)])


def _settled(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "size", "mate", "gap"])


def _depths(tallies: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Of each range: gaps open before it, and how many of them stay below its own; from its documents without a gap and its gaps left."""
    out, open_ = [], 0
    for part in sorted(tallies):
        documents, gaps = tallies[part]
        out.append((part, open_, max(0, open_ - documents)))
        open_ = out[-1][2] + gaps
    return out


def _longest(alone: DataFrame, number: int, of: int) -> Column:
    """About ``number`` of the longest documents, at least one; of those of the last size a share, by hash."""
    size = F.col("size")
    least = alone.agg(F.percentile_approx("size", max(0.0, 1 - number / of), 10_000).alias("x")).first().x
    told = alone.agg(F.count_if(size > least).alias("over"), F.count_if(size == least).alias("at"), F.min(F.when(size == least, F.col("key"))).alias("first")).first()
    share = max(0.0, number - told.over) / max(1, told.at)
    return (size > least) | (size == least) & ((F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)) | F.lit(not told.over) & (F.col("key") == told.first))


def place(left: DataFrame, capacity: float) -> DataFrame:
    """``key, sequence_id, offset`` for ``left(key, size)``, which is read from files; a sequence bears the key of its first document."""
    spark = left.sparkSession
    gaps = spark.createDataFrame([], "key bigint, gap double, at double")
    placed, past, least = [], [], 0.0
    while True:
        events = left.select(F.col("size").alias("at"), F.lit(1).alias("kind"), "key", "size").unionAll(gaps.where(F.col("gap") >= least).select("at", F.lit(0), "key", "gap"))
        order = [F.desc("at"), F.asc("kind"), F.asc("key")]
        swept = materialize(events.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep(capacity), _SWEPT))
        alone, files = swept.where("mate is null and place is not null"), [swept]
        tallies = {r.part: (r.d, r.g) for r in alone.groupBy("part").agg(F.sum("kind").alias("d"), F.sum(1 - F.col("kind")).alias("g")).collect()}  # a row for each range
        taken = swept.where("mate is not null").select("key", F.col("mate").alias("sequence_id"), "offset", "size")
        resting = swept.where("kind = 0 and place is null").select("key", F.col("size").alias("gap"), F.col("size").alias("at"))
        within = taken.limit(0)
        if len(tallies) > 1:
            depths = F.broadcast(spark.createDataFrame(_depths(tallies), "of int, before bigint, below bigint"))
            level = F.when(F.col("kind") == 0, F.col("below") + F.col("place")).otherwise(F.col("before") - 1 - F.col("place"))
            deep = alone.join(depths, F.col("part") == F.col("of")).withColumn("level", level)
            settled = deep.where("level >= 0").repartition("level").sortWithinPartitions("level", "part", F.desc("kind")).select("level", "kind", "key", "size")
            met = materialize(settled.mapInArrow(_settle, "kind int, key bigint, size double, mate bigint, gap double"))
            within = met.where("kind = 1").select("key", F.col("mate").alias("sequence_id"), (capacity - F.col("gap")).alias("offset"), "size")
            kept, alone = met.where("kind = 0"), deep.where("kind = 1 and level < 0")
            files.append(met)
        else:  # in one range nothing is left to settle
            kept, alone = alone.where("kind = 0"), alone.where("kind = 1")
        rest = capacity - F.col("offset") - F.col("size")
        kept = kept.select("key", F.col("size").alias("gap"), F.col("size").alias("at")).unionAll(resting)
        kept = kept.unionAll(within.select(F.col("sequence_id").alias("key"), rest.alias("gap"), F.least(rest, "size").alias("at"))).where("gap > 0")
        alone = alone.select("key", "size")
        widest = kept.agg(F.max("gap")).first()[0]
        # What fits a gap as it is by now waits for the next round.
        widest = -1.0 if widest is None else widest
        over, large = F.col("size") > widest, F.col("size") > max(widest, capacity / 2)
        told = alone.agg(F.count(F.lit(1)).alias("all"), F.min("size").alias("least"), F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size"))).alias("volume"), F.count_if(large).alias("large")).first()
        opens = large
        if told.n and not told.large:
            opens = over & _longest(alone.where(over), int(max(1, -(-told.volume // capacity))), told.n)
        opened = alone.where(opens).select("key", F.col("key").alias("sequence_id"), F.lit(0.0).alias("offset"), "size")
        new = materialize(taken.unionAll(within).unionAll(opened))
        placed.append(new.select("key", "sequence_id", "offset"))
        for done in past:
            released(done)
        past = files
        if told["all"] == told.large:  # none is left
            break
        fresh = new.where("offset = 0 and key = sequence_id").select("key", rest.alias("gap"), F.when(F.col("size") > capacity / 2, rest).otherwise(F.least(rest, "size")).alias("at"))
        gaps = kept.unionAll(fresh.where("gap > 0"))
        left, least = alone.where(~opens), told.least  # smaller gaps are of no use any more
    for done in past:
        released(done)
    return reduce(DataFrame.unionAll, placed)


def pack_in_rounds(items: DataFrame, capacity: float, *, id: str = "id", size: str = "size") -> DataFrame:
    """``id, sequence_id, offset`` of every row of ``items``; offsets within a sequence are gapless from 0."""
    own = materialize(items.select(F.col(id).alias("id"), F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("size"), F.monotonically_increasing_id().alias("key")))
    if not own.where(F.col("size") > capacity).isEmpty():
        raise ValueError(f"a size is over the capacity of {capacity}")
    key, sequence = unused("key", "sequence")
    places = place(own.select("key", "size"), capacity).toDF(key, sequence, "offset")
    return own.join(places, F.col("key") == F.col(key)).select("id", F.col(sequence).alias("sequence_id"), "offset")

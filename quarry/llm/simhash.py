"""SimHash fingerprints and their Hamming neighbours through a Gray-order hierarchical index.

Fingerprint: A-Z are lower-cased, words are runs of anything but ASCII white
space, a shingle is ``size`` words joined by spaces (with fewer words the
whole sequence), repeats count, and a bit is 1 if it is set in over half of
the shingles' XXH64 (seed 42).  No words: zero.

Links: fingerprints at ``radius`` or fewer differing bits.  Cut into m > ``radius``
blocks of bits, two such agree on all bits of some m - ``radius`` blocks, so each
distinct fingerprint goes to one group for each choice of that many.  m
grows with the number of fingerprints (5 to 8 for radius 4: 5, 15, 35, 70
choices of 13, 21, 27, 32 bits), so that groups stay small at any size.
In a group fingerprints are sorted by Gray
rank, which puts those with shared bits side by side; runs of eight become a
node that keeps the bits on which all agree (mask and pattern), runs of eight
nodes the next level, up to one root.  The search descends over pairs of
nodes, from (root, root), and drops a pair - whole groups of fingerprints - as
soon as the differences on shared bits exceed the radius.

Bounds: a task holds one group at a time.  Of a group of more than
``group_limit`` distinct fingerprints (a dense cluster) first each is linked to those next to it in
Gray order, over ranges, which mostly leaves one component; a group of one component is
done.  Of others the largest component is dealt by hash into parts and what is not in it meets every part
(where that is over ``group_limit`` too, each pair of parts becomes a group); no pair is lost.  Of
the pairs found in a group only a spanning forest leaves the task, so rows stay linear.
Exact copies share a fingerprint and are one row from the start.

Texts of similarity ``threshold`` (``similar_links``): candidates agree on the
four least of their shingles under some of twelve groups of four hash functions, and within a
group are searched by the same index over 64-bit fingerprints; what is found is
verified from the shingle sets within the task, and only a spanning forest of the verified links leaves it.  Blocks of bits can't make these groups: at similarity 0.8 fifteen bits
in a hundred differ, so that 48 rows a text with blocks of 16 bits find 97
pairs in a hundred, and blocks that are narrow enough to find a pair are too wide
to keep groups small in a large corpus.

Defined results: null text counts as empty; all texts without words share the
fingerprint zero; rows with equal ids each get a row; ``component_id`` is the
smallest id reachable (null ids count only if a component has no other).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_type, join_hot, map_batches, materialize, quoted, released, set_hash, shingles
from quarry.llm.components import components

SEED = 42
FANOUT = 8
#: Fingerprints of a group, where they are dealt evenly.
GROUP = 256
#: Members of a block that each is compared with in Gray order.
NEXT = 3
#: Sets that one is compared with at once.
CHECKED = 256
#: Node pairs expanded at once; bounds the memory of a descent.
SLICE = 8192


def fingerprint(text: str | None, size: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    digest = xxhash.xxh64_intdigest
    total, n, bits = np.zeros(64, np.int64), len(starts), None
    for k in range(0, n, 65536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + 65536], ends[size - 1 + k : size - 1 + k + 65536], strict=False)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    ones = (2 * total > n).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, size: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, fp bigint`` of every row."""
    kind = id_type(docs, id)

    def make():
        def own(batch: pa.RecordBatch) -> dict:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            return {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

        return own

    return map_batches(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), f"doc_id {kind}, fp bigint", make)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """Levels of (mask, pattern) nodes over codes that are sorted by group and Gray rank."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        """``starts``: where each group begins in ``codes``."""
        sizes = np.diff(np.append(starts, len(codes)))
        local = np.arange(len(codes)) - np.repeat(starts, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
        self.firsts = [np.arange(len(codes))]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        width, below = 1, np.arange(len(codes) + 1)
        while len(self.levels[-1][1]) > len(starts):
            width *= FANOUT
            first = np.flatnonzero((local % width == 0) | (np.r_[True, group[1:] != group[:-1]]))
            both, some = np.bitwise_and.reduceat(codes, first), np.bitwise_or.reduceat(codes, first)
            mask = ~(both ^ some)
            self.levels.append((mask, both & mask))
            self.firsts.append(first)
            # Children are nodes of the level below that begin within this node.
            place = np.searchsorted(below[:-1], first)
            self.children.append((place, np.append(place[1:], len(below) - 1)))
            below = np.append(first, len(codes))

    def pairs(self, radius: int, settled: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of the pairs i < j within one group at no more than ``radius`` differences.

        ``settled(level, a, b)`` tells of pairs of nodes that need no look any more; with
        it neighbours in Gray order come first, so that a dense cluster settles early.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        stack = [(top, roots[k : k + SLICE], roots[k : k + SLICE]) for k in range(0, len(roots), SLICE)]
        step = np.arange(FANOUT)
        while stack:
            level, a, b = stack.pop()
            if settled is not None:
                keep = ~settled(level, a, b)
                a, b = a[keep], b[keep]
            if level == 0:
                keep = a < b
                if keep.any():
                    yield a[keep], b[keep]
                continue
            lo, hi = self.children[level - 1]
            x = (lo[a][:, None, None] + step[None, :, None]) + np.zeros((1, 1, FANOUT), int)
            y = (lo[b][:, None, None] + step[None, None, :]) + np.zeros((1, FANOUT, 1), int)
            keep = (x < hi[a][:, None, None]) & (y < hi[b][:, None, None]) & (x <= y)
            x, y = x[keep], y[keep]
            mask, pattern = self.levels[level - 1]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= radius
            x, y = x[near], y[near]
            if settled is not None and len(x) > SLICE:
                order = np.argsort(x - y, kind="stable")  # the last come first
                x, y = x[order], y[order]
            stack += [(level - 1, x[k : k + SLICE], y[k : k + SLICE]) for k in range(0, len(x), SLICE)]


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the components of all pairs; a label is the smallest member's place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def forest(codes: np.ndarray, starts: np.ndarray, radius: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each group, beyond those that ``label`` stands for.

    Two nodes whose members are all in one component need no look, so a dense
    cluster of n fingerprints costs far less than its n * n links.
    ``label``: the place of the first member of the component that is known of each.
    """
    index, first = GrayIndex(codes, starts), np.arange(len(codes)) if label is None else label
    label = first.copy()
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def settled(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if level not in seen:
            seen[level] = tuple(f.reduceat(label, index.firsts[level]) for f in (np.minimum, np.maximum))
        low, high = seen[level]
        return (low[a] == high[b]) & (high[a] == low[b]) & (low[a] == high[a]) & ((a != b) | (level > 0))

    for a, b in index.pairs(radius, settled):
        label = join(label, a, b)
        seen.clear()
    heads = np.flatnonzero(first == np.arange(len(codes)))
    tied = heads[label[heads] != heads]
    return codes[label[tied]], codes[tied]


def choices(radius: int, number: int) -> list[int]:
    """Masks of 64 bits; codes at ``radius`` or fewer differences agree under one of them at least.

    The more codes, the more bits: groups of at most ``GROUP`` where codes are dealt evenly.
    """
    for m in range(radius + 1, radius + 5):
        edges = [round(64 * k / m) for k in range(m + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(chosen) for chosen in combinations(blocks, m - radius)]
        if number >> min(x.bit_count() for x in masks) <= GROUP:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 4, group_limit: int = 8192) -> DataFrame:
    """``u, v``: links that connect whatever fingerprints of ``distinct(fp)`` are connected at all; a frame that is written already."""
    masks = choices(radius, distinct.count())
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])
    keyed = distinct.select(F.col("fp").alias("node"), "fp", F.explode(keys).alias("block"))
    large = materialize(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).select("block"))

    def ties(rows: np.ndarray, change: np.ndarray) -> list[pa.RecordBatch]:
        codes, group, order = _in_order(rows, change)
        label = _first_places(group, rows[order, 4]) if rows.shape[1] > 4 else None  # components that are known
        u, v = forest(codes, change, radius, label)
        return [pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])]

    def searched(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_by_group(ties), "u bigint, v bigint")

    if large.isEmpty():
        rows = keyed.select("fp", "block", F.lit(0).alias("part"), "node")
        return materialize(searched(rows.repartition("block").sortWithinPartitions("block")))
    rows = keyed.join(large, "block", "left_anti").select("fp", "block", F.lit(0).alias("part"), "node")
    ordinary = materialize(searched(rows.repartition("block").sortWithinPartitions("block")))
    hot = materialize(keyed.join(large, "block", "left_semi").select("fp", "block", "node"))
    beside = materialize(_beside(hot, radius))
    roots = components(beside)
    labelled = materialize(hot.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("fp", "block", "node", F.coalesce("root", "node").alias("label")))
    return ordinary.unionAll(beside).unionAll(materialize(searched(_sorted(_dealt(labelled, group_limit)))))


def _in_order(rows: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in Gray order within their groups, the groups' numbers, and the places of the rows."""
    codes = rows[:, 0].astype(np.int64).view(np.uint64)
    group = np.zeros(len(rows), np.int64)
    group[change[1:]] = 1
    group = np.cumsum(group)
    order = np.lexsort((gray_rank(codes), group))
    return codes[order], group, order


def _first_places(group: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of each row the place of the first one of its group and label."""
    known, back = np.unique(np.stack([group, label]), axis=1, return_inverse=True)
    place = np.full(known.shape[1], len(label))
    np.minimum.at(place, back.ravel(), np.arange(len(label)))
    return place[back.ravel()]


def _gray(fp: Column) -> Column:
    """The Gray rank of a fingerprint, as a number that sorts like it."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _beside(keyed: DataFrame, radius: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``u, v`` within ``radius``: of each member of a block the next ``NEXT`` in Gray order, as far as they lie in one range.

    ``keyed``: ``fp, block, node`` and at most one number, which ``fits`` compares.  Linear in the rows, however large a block.
    """
    ranked = keyed.withColumn("rank", _gray(F.col("fp")))
    rows = ranked.repartitionByRange("block", "rank").sortWithinPartitions("block", "rank", "node").drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            own = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            old = 0 if before is None else before.shape[1]
            x = own if before is None else np.concatenate([before, own], axis=1)
            for step in range(1, NEXT + 1):
                first = max(0, old - step)  # pairs of rows that came before are told already
                a, b = x[:, first:-step], x[:, first + step :]
                near = (a[1] == b[1]) & (np.bitwise_count((a[0] ^ b[0]).view(np.uint64)) <= radius)
                if fits is not None:
                    near &= fits(a[3], b[3])
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[2][near]), pa.array(b[2][near])], names=["u", "v"])
            before = x[:, -NEXT:]

    return rows.mapInArrow(run, "u bigint, v bigint")


def _dealt(keyed: DataFrame, group_limit: int, weight: Column | None = None, weight_limit: int = 1) -> DataFrame:
    """``fp, block, part, node`` and what else ``keyed`` has, to be sorted by group: a block of more than one ``label``, or of a large one its parts.

    ``keyed`` is read from files.  Of a large block, by rows or by ``weight``, the rows of the most frequent label are dealt by hash into parts and
    all others meet each part; where those are too many as well, each pair of parts is a group.
    """
    weight = F.lit(0) if weight is None else weight
    more = [c for c in keyed.columns if c not in ("fp", "block", "node")]
    facts = (
        keyed.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
        .groupBy(F.col("block").alias("of")).agg(F.sum("n").alias("members"), F.sum("w").alias("w"), F.max(F.struct("n", "label", "w")).alias("top"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select("of", "members", F.ceil(F.greatest(F.col("members") / F.lit(group_limit), F.col("w") / F.lit(weight_limit))).cast("int").alias("parts"),
                ((F.col("members") - F.col("top.n") > group_limit) | (F.col("w") - F.col("top.w") > weight_limit)).alias("others"), F.col("top.label").alias("giant"))
    )
    rows = join_hot(keyed, "block", facts, "of", "members", keyed.count())
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(every, lambda k: F.least(k, part) * F.lit(1 << 20) + F.greatest(k, part))
    at = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(F.col("others"), pairs).when(F.col("label") == F.col("giant"), F.array(part)).otherwise(every)
    return rows.select("fp", "block", F.explode(at).alias("part"), "node", *more)


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("block", "part").sortWithinPartitions("block", "part")


def _by_group(found):
    """A ``mapInArrow`` function that gives ``found`` whole groups, many small ones at once: the rows, and where groups begin.

    ``found`` gives batches one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(rows: np.ndarray) -> Iterable[pa.RecordBatch]:
            return found(rows, np.flatnonzero(np.r_[True, (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(batch.num_columns)], axis=1))
            size += batch.num_rows
            if size >= 65536:
                rows = np.concatenate(held)
                cut = int(np.argmax((rows[:, 1:3] == rows[-1, 1:3]).all(axis=1)))  # the last group may go on in the next batch
                if cut:
                    yield from flush(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield from flush(np.concatenate(held))

    return run


def _groups(prints: DataFrame, radius: int, group_limit: int) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``prints(doc_id, fp)``, which is read from files."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), radius, group_limit))
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = materialize(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("times")))
    known = join_hot(rooted, "root", named, "of", "times", rooted.count()).select(F.col("fp").alias("own"), "n", "component_id")
    return join_hot(prints.select("doc_id", "fp"), "fp", materialize(known), "own", "n", prints.count())


def simhash_groups(docs: DataFrame, *, size: int = 4, radius: int = 4, group_limit: int = 8192, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    groups = _groups(materialize(fingerprints(docs, size=size, text=text, id=id)), radius, group_limit)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the search by similarity: groups of hash functions, and how many a group has.
ANCHORS, LEAST = 12, 4
_rng = np.random.default_rng(64)
_A = _rng.integers(0, 2**63, ANCHORS * LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, ANCHORS * LEAST, dtype=np.uint64) * np.uint64(2)
_MIX = _rng.integers(0, 2**63, LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles hashed at once.
BLOCK = 512


def set_fingerprint(grams: np.ndarray) -> int:
    """SimHash of a set of shingles; zero without any."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(grams), 65536):
        total += np.unpackbits(grams[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(grams), bitorder="little").view(np.uint64)[0])


def anchors(grams: np.ndarray) -> np.ndarray:
    """``ANCHORS`` numbers, each mixed from the least values of ``LEAST`` hash functions over a set of shingles.

    Sets of similarity s agree on one of these in s ** LEAST of all cases: at 0.8 they share some anchor 998 times in 1000.
    """
    least = np.full(ANCHORS * LEAST, ~np.uint64(0))
    for k in range(0, len(grams), BLOCK):
        np.minimum(least, (grams[k : k + BLOCK, None] * _A + _B).min(axis=0), out=least)
    mixed = ((least ^ (least >> np.uint64(29))).reshape(ANCHORS, LEAST) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(ANCHORS, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


#: Shingles that a group holds, but for one text that has more by itself.
HELD_SHINGLES = 2_000_000


def _fits(threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Numbers of shingles that don't rule the similarity out."""
    return lambda a, b: np.minimum(a, b) >= threshold * np.maximum(a, b)


def _alike(sizes: np.ndarray, grams: np.ndarray, threshold: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some sets are alike to one, by a table of marks over the shingles of all."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, ids = np.unique(grams, return_inverse=True)
    marks = np.zeros(len(grams) + 1, np.int64)

    def check(a: int, others: np.ndarray) -> np.ndarray:
        mine = ids[starts[a] : ends[a]]
        marks[mine] = 1
        before = np.cumsum(sizes[others]) - sizes[others]
        at = np.arange(sizes[others].sum()) + np.repeat(starts[others] - before, sizes[others])
        shared = np.add.reduceat(marks[ids[at]], before)
        marks[mine] = 0
        return shared >= threshold * (sizes[a] + sizes[others] - shared)

    return check


def _verified_forest(radius: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows ``fp, block, part, shingles, label, node, grams``, sorted by group, the links ``u, v`` that join what isn't joined yet, group by group."""
    fits = _fits(threshold)

    def links(columns: list[np.ndarray], grams: np.ndarray) -> pa.RecordBatch:
        fp, sizes, label, node = columns
        codes = fp.view(np.uint64)
        order = np.argsort(gray_rank(codes), kind="stable")
        codes, size, node = codes[order], sizes[order], node[order]
        first = _first_places(np.zeros(len(codes), np.int64), label[order])
        ends = np.cumsum(sizes)
        check = _alike(size, np.concatenate([grams[ends[k] - sizes[k] : ends[k]] for k in order]), threshold)
        index, known, seen, out = GrayIndex(codes, np.zeros(1, np.int64)), [first.copy()], {}, []

        def settled(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if level not in seen:
                seen[level] = tuple(f.reduceat(known[0], index.firsts[level]) for f in (np.minimum, np.maximum))
            low, high = seen[level]
            return (low[a] == high[b]) & (high[a] == low[b]) & (low[a] == high[a]) & ((a != b) | (level > 0))

        for a, b in index.pairs(radius, settled):
            keep = fits(size[a], size[b])
            a, b = a[keep], b[keep]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
            for x, others in zip(a[cuts], np.split(b, cuts[1:]), strict=True) if len(a) else ():
                while len(others := others[known[0][others] != known[0][x]]):  # in parts, as what is found joins others too
                    now, others = others[:CHECKED], others[CHECKED:]
                    alike = now[check(x, now)]
                    if len(alike):
                        heads, at = np.unique(known[0][alike], return_index=True)
                        out += [(node[x], node[y]) for y in alike[at]]
                        known[0] = join(known[0], np.full(len(heads), x), alike[at])
                        seen.clear()
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams, key = [], [], None

        def flush() -> pa.RecordBatch:
            return links([np.concatenate([h[k] for h in held]) for k in range(4)], np.concatenate(grams))

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, block, part, size, label, node = (batch.column(k).to_numpy().astype(np.int64) for k in range(6))
            lists = batch.column(6)
            flat, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
            for start, end in zip(cuts, np.append(cuts[1:], len(fp)), strict=True):
                if key is not None and key != (block[start], part[start]):
                    yield flush()
                    held, grams = [], []
                key = (block[start], part[start])
                held.append([x[start:end] for x in (fp, size, label, node)])
                grams.append(flat[offsets[start] : offsets[end]])
        if held:
            yield flush()

    return run


def _features(docs: DataFrame, copies: int | None, size: int, text: str, id: str) -> DataFrame:
    """``doc_id, words, own, shingles, fp, anchors`` of every row, and with ``copies`` the fingerprint ``copy`` over so many words."""

    def make():
        def own(batch: pa.RecordBatch) -> dict:
            texts = [t.as_py() for t in batch.column(1)]
            sets = [np.unique(shingles(t, size)) for t in texts]
            out = {"doc_id": batch.column(0), "words": [len(x) > 0 for x in sets], "own": [set_hash(x) for x in sets], "shingles": [len(x) for x in sets], "fp": [_signed(set_fingerprint(x)) for x in sets], "anchors": [anchors(x).view(np.int64) for x in sets]}
            return out | ({} if copies is None else {"copy": [_signed(fingerprint(t, copies)) for t in texts]})

        return own

    schema = f"doc_id {id_type(docs, id)}, words boolean, own bigint, shingles bigint, fp bigint, anchors array<bigint>" + ", copy bigint" * (copies is not None)
    return map_batches(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), schema, make)


def similar_links(docs: DataFrame, features: DataFrame, *, threshold: float = 0.8, size: int = 5, radius: int = 20, group_limit: int = 4096, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Links ``u, v`` of Jaccard similarity ``threshold`` or more between the nodes of ``features``, which is read from files.

    Texts with one shingle set are one node, ``own``, the hash of the set.  Nodes
    that share an anchor meet in a group; an anchor that only one node has
    goes before anything else moves.  First the next few in Gray order are verified, over ranges of all groups, which
    settles most groups of near copies at a cost linear in their rows.  In each group that then has more than one
    component, every pair whose fingerprints differ in ``radius`` bits or fewer is verified
    unless verified links join it already or the numbers of shingles rule it out.  The links together
    connect whatever such pairs connect.  At similarity 0.8 a pair meets 998 times in
    1000; 2 in 10,000 are beyond the radius.
    """
    nodes = materialize(features.groupBy("own").agg(F.min("doc_id").alias("shown"), *[F.first(c).alias(c) for c in ("fp", "shingles", "anchors")]))
    bare = materialize(nodes.select(F.col("own").alias("node"), F.explode("anchors").alias("block")))
    times = materialize(bare.groupBy(F.col("block").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = join_hot(bare, "block", times, "of", "n", bare.count())
    keyed = materialize(members.join(nodes.select("own", "fp", "shingles"), F.col("node") == F.col("own")).select("fp", "block", "node", "shingles"))
    released(bare)

    def grams():
        def own(batch: pa.RecordBatch) -> dict:
            sets = [np.unique(shingles(t.as_py(), size)) for t in batch.column(1)]
            return {"own": batch.column(0), "made": [set_hash(x) for x in sets], "grams": [x.view(np.int64) for x in sets]}

        return own

    shown = nodes.join(keyed.select("node").distinct(), F.col("own") == F.col("node"), "left_semi").select("own", "shown")
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(shown, F.col("doc_id") == F.col("shown")).select("own", "text")
    made = materialize(map_batches(texts, "own bigint, made bigint, grams array<bigint>", grams).where("own = made").drop("made").dropDuplicates(["own"]))

    ties = _beside(keyed, radius, _fits(threshold)).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sets = lambda n, g: made.select(F.col("own").alias(n), F.col("grams").alias(g))
    both = ties.join(sets("x", "xs"), F.col("u") == F.col("x")).join(sets("y", "ys"), F.col("v") == F.col("y"))
    shared = F.size(F.array_intersect("xs", "ys"))
    first = materialize(both.where(shared >= threshold * (F.size("xs") + F.size("ys") - shared)).select("u", "v"))

    roots = components(first)
    labelled = materialize(keyed.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(*keyed.columns, F.coalesce("root", "node").alias("label")))
    dealt = materialize(_dealt(labelled, group_limit, F.col("shingles"), HELD_SHINGLES))
    # Sets travel only to groups that still have something to join.
    whole = dealt.join(made.withColumnRenamed("own", "of"), F.col("node") == F.col("of")).select("fp", "block", "part", "shingles", "label", "node", "grams")
    second = materialize(_sorted(whole).mapInArrow(_verified_forest(radius, threshold), "u bigint, v bigint"))
    for done in (nodes, times, keyed, made, labelled, dealt):
        released(done)
    return first.unionAll(second)


def _without(docs: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    """``docs`` without the ids that ``gone`` holds."""
    name = f"_{uuid.uuid4().hex}"
    return docs.join(gone.toDF(name), docs[quoted([id])[0]] == F.col(name), "left_anti")


def _similar_gone(docs: DataFrame, features: DataFrame, **options) -> DataFrame:
    """Ids of the rows that a similar one with a smaller id stands for."""
    held = features.where("words and doc_id is not null")
    roots = components(similar_links(docs, held, **options))
    named = materialize(held.select("doc_id", "own").join(roots, F.col("own") == F.col("node"), "left").select("doc_id", F.coalesce("root", "own").alias("root")))
    least = materialize(named.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("stays"), F.count(F.lit(1)).alias("times")))
    return join_hot(named, "root", least, "of", "times", named.count()).where("doc_id <> stays").select("doc_id")


def drop_similar(docs: DataFrame, *, threshold: float = 0.8, size: int = 5, group_limit: int = 4096, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each group of similar texts, that with the smallest id, in the columns of ``docs``.

    Texts without words are left alone, and so are rows with a null id; rows that
    share an id stand or fall together.
    """
    features = materialize(_features(docs, None, size, text, id))
    gone = _similar_gone(docs, features, threshold=threshold, size=size, group_limit=group_limit, text=text, id=id)
    return _without(docs, materialize(gone.distinct()), id)


def drop_near_copies(docs: DataFrame, *, size: int = 4, radius: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each group, that with the smallest id, in the columns of ``docs``.

    Rows that share an id stand or fall together; rows with a null id stay.
    """
    groups = simhash_groups(docs, size=size, radius=radius, text=text, id=id)
    return _without(docs, groups.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct(), id)


def drop_near_duplicates(docs: DataFrame, *, copies: int = 4, radius: int = 4, threshold: float = 0.8, size: int = 5, text: str = "text", id: str = "doc_id") -> DataFrame:
    """What ``drop_near_copies`` (``copies`` words) and then ``drop_similar`` leave, in the columns of ``docs``.

    The texts are read once for all fingerprints, and once more where shingle sets are compared.
    """
    features = materialize(_features(docs, copies, size, text, id))
    groups = _groups(features.select("doc_id", F.col("copy").alias("fp")), radius, 8192)
    first = materialize(groups.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct())
    left = materialize(_without(features.drop("copy"), first, "doc_id"))
    second = _similar_gone(docs, left, threshold=threshold, size=size, text=text, id=id)
    return _without(docs, materialize(first.unionAll(second.distinct())), id)

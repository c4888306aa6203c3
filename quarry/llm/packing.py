"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents are tokenised, closed by one id and cut where they exceed the
capacity (the first piece takes the remainder).  Lengths and gaps are whole
numbers up to the capacity, so the range-sorted documents and the range-sorted
gaps are runs of equals, and a bulk-synchronous round treats a run at once:

1. one pass tokenises and writes the pieces, each with its rank among the
   pieces of its length in its partition; partition counts by length, summed
   in partition order, make that a rank among all pieces of the length;
2. lengths go from the longest to the shortest.  A successor sweep offers the
   run of documents to the smallest gap that holds them, then to the next;
   where documents and gaps compete, ranks decide: the lowest ranks take the
   gaps of the lowest sequences, the rest goes on; gaps are updated and the
   next round begins.  Documents that no gap holds open new sequences;
3. each piece finds its place by length and rank.

Step 2 is one sequential loop over the lengths in the driver's Python (``plan``), from the counts by length alone; no
Spark job sweeps, settles conflicts or updates gaps.  It stands in for distributed rounds because the
counts are at most one row per length whatever the input.  The rounds are best-fit decreasing on runs.  A run of gaps is split at most
three times a length and each visit more than halves its gap, so the plan has
at most 3 * capacity * log2(capacity) rows whatever the number of documents (67,584 for 2048):
that is what is broadcast.  Pieces themselves never leave the executors, and
no key but (partition, length) is shuffled.

Defined results: a null or empty text is the closing id alone; rows that
repeat an id are packed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import Memo, pieces
from quarry.llm.common import id_type, map_batches, materialize


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizer:
    """Ids of whole texts by a byte-level BPE in the tokenizers library's JSON format, special tokens not added.

    Where ids follow the order of merges (checked), the faster ranks coder
    gives the same ids; else the library itself encodes.  Tokens that the vocabulary adds, special ones too,
    have their own ids where they stand in a text, as in the library, and the text is cut there first.
    Pieces between spaces are kept in a bounded memo.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        self.fast = self._ranked(spec)
        if self.fast is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_str(source)
        added = sorted((t for t in spec.get("added_tokens", []) if t["content"]), key=lambda t: -len(t["content"]))  # of two at one place the longer
        self.added = {t["content"]: np.array([t["id"]], np.uint32).tobytes() for t in added}
        self.cuts = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if added else None
        self.starts = Memo(self._ids)
        self.inner = Memo(lambda piece: self._ids(" " + piece))

    @staticmethod
    def _ranked(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return None  # the library knows their rules
        if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return None
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}  # never made by merges
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        if any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != 256 + len(merges) or made and min(made) <= max(ranks[bytes([b])] for b in range(256)):
            return None
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.fast:
            return self._ids(text)
        if self.cuts is None or not self.cuts.search(text):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.cuts.split(text) if part)

    def _plain(self, text: str) -> bytes:
        first, *rest = pieces(text)
        return self.starts[first] + b"".join(map(self.inner.__getitem__, rest))


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(source: str) -> Tokenizer:
    """One for each Python worker, so that its memo outlives a task."""
    if source not in _tokenizers:
        _tokenizers[source] = Tokenizer(source)
    return _tokenizers[source]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    rest = n % capacity
    return [(0, rest)] * (rest > 0) + [(s, capacity) for s in range(rest, n, capacity)]


def cut_documents(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, dealt, place`` (and ``ids``).

    ``dealt`` and ``place``: the partition, and the rank among its pieces of that length.
    """
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    close = np.array([end_id], np.uint32).tobytes()

    def make():
        own, seen, dealt = tokenizer(source.value), defaultdict(int), TaskContext.get().partitionId()

        def one(batch: pa.RecordBatch) -> dict:
            out = defaultdict(list)
            rows = []
            for row, t in enumerate(batch.column(1)):
                ids = own.encode_bytes(t.as_py()) + close
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(row)
                    for name, value in (("piece", k), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(part)), ("place", seen[length])):
                        out[name].append(value)
                    seen[length] += 1
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, np.int32))
            return {**out, "doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "dealt": np.full(len(rows), dealt)}

        return one

    schema = f"doc_id {id_type(docs, id)}, piece int, start bigint, length bigint, ids_crc32 bigint, dealt bigint, place bigint" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), schema, make)


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Places for ``counts[length]`` pieces, and the number of sequences.

    For each length rows (rank, each, sequence, offset): from ``rank`` on,
    every ``each`` pieces go to the next sequence, from ``sequence`` on,
    side by side from ``offset``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    present: list[int] = []  # its keys in order
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def leave(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(present, gap)
            gaps[gap].append(run)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank, rows = counts[length], 0, []

        def place(first: int, number: int, gap: int, left: int, rank: int, rows: list = rows, length: int = length) -> tuple[int, int]:
            """Fill ``number`` sequences that have ``gap``; what stays open goes back."""
            each = gap // length
            full = min(number, left // each)
            if full:
                rows.append((rank, each, first, capacity - gap))
                leave(gap - each * length, (first, full))
                left, rank = left - full * each, rank + full * each
            if left and full < number:
                rows.append((rank, left, first + full, capacity - gap))
                leave(gap - left * length, (first + full, 1))
                full, rank, left = full + 1, rank + left, 0
            leave(gap, (first + full, number - full))
            return left, rank

        sweep = [g for g in present[bisect.bisect_left(present, length) :]]
        for gap in sweep:
            if not left:
                break
            runs = sorted(gaps.pop(gap))
            present.remove(gap)
            for first, number in runs:
                if left:
                    left, rank = place(first, number, gap, left, rank)
                else:
                    leave(gap, (first, number))
        if left:
            number = -(-left // (capacity // length))
            place(opened, number, capacity, left, rank)
            opened += number
        out[length] = rows
    return out, opened


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    cuts = materialize(cut_documents(docs, path, capacity=capacity, end_id=end_id, with_ids=with_ids, text=text, id=id))
    by_part = materialize(cuts.groupBy("dealt", "length").agg(F.count(F.lit(1)).alias("n")))
    totals = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length
    rows, _ = plan({r.length: r.n for r in totals}, capacity)
    sent = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).reshape(-1, 4).T for k, v in rows.items()})
    earlier = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select(F.col("dealt").alias("d"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The bases grow with the partitions: never broadcast.
    ranked = cuts.join(bases.hint("merge"), (F.col("dealt") == F.col("d")) & (F.col("length") == F.col("l"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"), *(["ids"] if with_ids else []))

    names = ranked.columns

    def make():
        places = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for own in np.unique(length):
                here = length == own
                first, each, seq, off = places[int(own)]
                at = np.searchsorted(first, rank[here], side="right") - 1
                nth = rank[here] - first[at]
                sequence[here] = seq[at] + nth // each[at]
                offset[here] = off[at] + nth % each[at] * own
            return {n: batch.column(k) for k, n in enumerate(names)} | {"sequence_id": sequence, "offset": offset}

        return one

    schema = f"doc_id {id_type(docs, id)}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return map_batches(ranked, schema, make)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets`` from ``pack(..., with_ids=True)``; a row holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))

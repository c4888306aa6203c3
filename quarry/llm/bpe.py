"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by the tokenizer's pattern and each is encoded
by itself.  Tier one is a minimal perfect hash over the vocabulary, which gives
the id of a pre-token that is a vocabulary entry as a whole.  Tier two merges
the bytes of the others: a linked list of parts and a heap of neighbouring
pairs by rank.

Pre-tokens never cross a space that follows a non-space character, so texts
are first cut there, and what a piece encodes to is kept in a memo of bounded
size: a piece costs one lookup when it comes again.

Defined results: null text counts as empty (no ids); special tokens' strings are
ordinary text; decoding gives back the bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_type, map_batches

#: A space after white space: there a cut before the space isn't safe.
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Entries of a memo and the longest piece that goes there; bounds it to some 200 MB.
MEMO_ENTRIES = 600_000
MEMO_PIECE = 64

_MASK = (1 << 64) - 1


def pieces(text: str) -> list[str]:
    """``text`` cut before each space that follows a non-space character; that space is left out of each piece but the first."""
    if _RUN.search(text):
        first, *rest = _CUT.split(text)
        return [first, *(p[1:] for p in rest)]
    return text.split(" ")


class Memo(dict):
    """What ``make`` gives for a key; emptied when it is full."""

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= MEMO_PIECE:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = value
        return value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read().splitlines()) if a}


def _mix(h: int, seed: int) -> int:
    h = (h ^ (seed * 0x9E3779B97F4A7C15)) & _MASK
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return h ^ (h >> 32)


def _mix_all(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    h = h ^ (seeds * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots.

    Keys fall in buckets; the largest bucket first, each gets the first seed
    that sends all its keys to free slots.  Buckets of one key are sent
    straight to the slots that remain.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys share a hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.seeds = [0] * self.buckets
        slots = np.full(n, -1)
        taken = np.zeros(n, bool)
        singles = []
        for b in np.argsort(first[:-1] - first[1:], kind="stable").tolist():
            own = order[first[b] : first[b + 1]]
            if len(own) <= 1:
                singles += [(b, i) for i in own.tolist()]
                continue
            seeds = np.arange(1, 65, dtype=np.uint64)
            while True:
                at = np.sort((_mix_all(hashes[own][:, None], seeds[None, :]) % np.uint64(n)).astype(np.int64), axis=0)
                fits = ~taken[at].any(axis=0) & (at[1:] != at[:-1]).all(axis=0)
                if fits.any():
                    break
                seeds = seeds + np.uint64(len(seeds))
            self.seeds[b] = seed = int(seeds[fits.argmax()])
            for i in own.tolist():
                slots[s := _mix(int(hashes[i]), seed) % n], taken[s] = i, True
        for (b, i), s in zip(singles, np.flatnonzero(slots < 0).tolist(), strict=True):
            self.seeds[b], slots[s] = -s - 1, i
        self.values = slots.tolist()
        self.keys = [keys[i] for i in self.values]

    def find(self, key: bytes) -> int:
        """Place of ``key`` among the keys given, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        slot = -seed - 1 if seed < 0 else _mix(h, seed) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


class ByteBPE:
    """Encoder and decoder of one vocabulary of ``token bytes -> rank``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        import regex

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.keys = list(ranks)
        self.ids = list(ranks.values())
        self.table = table or PerfectHash(self.keys)
        self.words = Memo(self._word)
        self.starts = Memo(lambda piece: self._encode(piece))
        self.inner = Memo(lambda piece: self._encode(" " + piece))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merge the neighbours of lowest rank, leftmost first, while any has a rank."""
        ranks, n = self.ranks, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = part[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(part[j]) != size:
                continue  # a neighbour has been merged since
            part[i] = left = left + part[j]
            part[j] = None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := ranks.get(left + part[j])) is not None:
                    heapq.heappush(heap, (r, i, size + len(part[j])))
            h = before[i]
            if h >= 0 and (r := ranks.get(part[h] + left)) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + size))
        return [ranks[p] for p in part if p is not None]

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        at = self.table.find(raw)
        return np.array([self.ids[at]] if at >= 0 else self.merge(raw), np.uint32).tobytes()

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        first, *rest = pieces(text)
        return self.starts[first] + b"".join(map(self.inner.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.uint32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_coders: dict[tuple, ByteBPE] = {}
_tables: dict[bytes, PerfectHash] = {}


def coder(vocabulary: dict[bytes, int], pattern: str, table: PerfectHash) -> ByteBPE:
    """One coder for each vocabulary and Python worker, so that its memo outlives a task."""
    key = (len(vocabulary), pattern, hashlib.sha256(b"".join(table.keys[:1000])).digest())
    if key not in _coders:
        _coders[key] = ByteBPE(vocabulary, pattern, table)
    return _coders[key]


class BPE:
    """A vocabulary that is sent to the executors: its size is that of its file, a few MB."""

    def __init__(self, spark, path: str, pattern: str):
        ranks = read_ranks(path)
        key = hashlib.sha256(b"".join(ranks)).digest()
        if key not in _tables:
            _tables[key] = PerfectHash(list(ranks))
        self.pattern = pattern
        self.sent = spark.sparkContext.broadcast((ranks, _tables[key]))

    def coder(self) -> ByteBPE:
        ranks, table = self.sent.value
        return coder(ranks, self.pattern, table)


def encode(docs: DataFrame, bpe: BPE, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, ids array<int>`` of every row."""

    def make():
        own = bpe.coder()

        def one(batch: pa.RecordBatch) -> dict:
            found = [own.encode_bytes(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(found), np.int32))
            return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), flat).cast(pa.list_(pa.field("element", pa.int32())))}

        return one

    return map_batches(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), f"doc_id {id_type(docs, id)}, ids array<int>", make)


def decode(coded: DataFrame, bpe: BPE) -> DataFrame:
    """``doc_id, bytes binary`` of rows ``doc_id, ids``; null ids give no bytes."""

    def make():
        own = bpe.coder()
        return lambda batch: {"doc_id": batch.column(0), "bytes": [own.decode(x.as_py() or []) for x in batch.column(1)]}

    return map_batches(coded.select("doc_id", "ids"), f"doc_id {id_type(coded, 'doc_id')}, bytes binary", make)


def round_trip(docs: DataFrame, bpe: BPE, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids, and of the bytes that they decode to."""

    def make():
        own = bpe.coder()
        digits = {i: b"%d" % i for i in own.tokens}.__getitem__

        def one(batch: pa.RecordBatch) -> dict:
            n, coded, plain = [], [], []
            for t in batch.column(1):
                ids = own.encode(t.as_py())
                n.append(len(ids))
                coded.append(hashlib.sha256(b",".join(map(digits, ids))).hexdigest())
                plain.append(hashlib.sha256(own.decode(ids)).hexdigest())
            return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": coded, "decoded_sha256": plain}

        return one

    return map_batches(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), f"doc_id {id_type(docs, id)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)

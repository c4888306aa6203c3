import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, packing

TEXTS = [None, "", " ", "  a  b \n\n c", "a \n b", "don't you'll I'm", "\xa0 x   y", "a\x1c b \x85 c", "日本語 テキスト ①②", "x" * 3000, "tail  ", "<|endoftext|> a", "x <|endoftext|>  y<|endoftext|><|endoftext|>\n", "<|endoftext", "naïve Ωmega 12 345", "ab " * 4000]


@pytest.fixture(scope="module")
def multi():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.ByteBPE(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(multi):
    table = multi[0].table
    assert sorted(table.values) == list(range(table.n))
    assert all(table.find(k) == i for i, k in enumerate(multi[0].keys))
    assert table.find(b"not in any vocabulary") == -1 and bpe.PerfectHash([]).find(b"a") == -1


def test_known_texts(multi):
    for t in TEXTS:
        assert multi[0].encode(t) == multi[1].encode_ordinary(t or "")
        assert multi[0].decode(multi[0].encode(t)) == (t or "").encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab eéß\n\t 1'!日s \x1c"), max_size=60))
def test_any_text(multi, t):
    assert multi[0].encode(t) == multi[1].encode_ordinary(t)


def test_frames(spark, multi):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    vocabulary = bpe.BPE(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = bpe.round_trip(docs, vocabulary).collect()
    want = []
    for i, t in rows:
        ids = multi[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = bpe.encode(docs, vocabulary)
    assert sorted(bytes(r.bytes) for r in bpe.decode(coded, vocabulary).collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(docs.where("false"), vocabulary).count() == 0


def test_tokenizer_matches_the_library():
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    own = packing.Tokenizer(open(path, encoding="utf-8").read())
    assert own.fast
    for t in TEXTS:
        assert np.frombuffer(own.encode_bytes(t), np.uint32).tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert 50256 in np.frombuffer(own.encode_bytes("a<|endoftext|>b"), np.uint32).tolist()
    other = packing.Tokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert other.fast is None and other.encode_bytes("plain words")


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(5, 60))
        lengths = sorted(rng.integers(1, capacity + 1, rng.integers(0, 200)).tolist(), reverse=True)
        gaps = []
        for n in lengths:  # one document at a time
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(capacity - n)
        rows, opened = packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity)
        assert opened == len(gaps)


def test_pack_covers_every_document(spark):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as offset", "2 as length").repartition(5)
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes()) and r.length == len(r.ids)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted(str(library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows if i not in (3, None))
    by = defaultdict(list)
    for r in sorted((r for r in got if r.doc_id not in (3, None)), key=lambda r: r.piece):
        assert r.start == len(by[r.doc_id]) and (r.piece == 0 or r.length == 64)
        by[r.doc_id] += r.ids
    assert sorted(map(str, by.values())) == want
    assert packing.pack(docs.where("false"), path).count() == 0
    whole = packing.sequences(packing.pack(docs, path, capacity=64, with_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got) and all(len(r.ids) <= 64 for r in whole)

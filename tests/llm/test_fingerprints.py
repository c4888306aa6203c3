import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from quarry.llm import common, minhash, wordpiece

WORDS = [f"w{k}" for k in range(3000)]
LONG = " ".join(WORDS)
ROWS = [(k, " ".join(np.random.default_rng(k % 17).choice(WORDS[:400], 5 + 40 * (k % 9)))) for k in range(60)] + [(70, None), (71, ""), (72, "two words"), (73, LONG), (74, "ä" * 9), (5, "a second row with this id"), (5, "a second row with this id"), (None, "no id at all"), (None, None)]


def chain(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_edits_follow_the_chain(spark):
    rows = [r for r in ROWS if r[0] not in (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as part", "'x' as sentinel").repartition(6)
    got = {r.doc_id: r for r in minhash.edit_check(docs).collect()}
    order = [(i, t or "") for i, t in chain(rows)]
    assert len(got) == len(order)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        new, r = t[: len(t) - half] + u[:half], got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == minhash.signature(t).tobytes().hex() and r.edited_fingerprint == minhash.signature(new).tobytes().hex()
        assert r.near_edited == minhash.likeness(minhash.signature(t), minhash.signature(new)) and r.near_next == minhash.likeness(minhash.signature(t), minhash.signature(u))


@pytest.mark.parametrize("rows", [ROWS, [(1, "only one")], [(None, "a b"), (None, "c d e")], []])
def test_every_row_once(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.edit_check(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert sum(r.n_chars for r in got) == sum(len(t or "") for _, t in rows)


def jaccard(a, b):
    a, b = (set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_likeness_estimates_jaccard():
    for share in (0.2, 0.5, 0.9):
        other = " ".join(WORDS[: int(3000 * share)] + [f"v{k}" for k in range(int(3000 * (1 - share)))])
        assert abs(minhash.likeness(minhash.signature(LONG), minhash.signature(other)) - jaccard(LONG, other)) < 0.15
    assert minhash.likeness(minhash.signature(""), minhash.signature(None)) == 1
    assert minhash.likeness(minhash.signature(""), minhash.signature("a b")) < 0.1


def plain_signature(text):
    """Function by function, shingle by shingle, in whole numbers of Python."""
    words, full = (text or "").encode().lower().split(), 2**64 - 1
    size = min(5, len(words))
    grams = [words[k : k + size] for k in range(len(words) - size + 1)] if words else []
    numbers = []
    for g in grams:
        x = sum((xxhash.xxh3_64_intdigest(w) ^ (k + 1)) * int(common._PLACE[k]) for k, w in enumerate(g)) & full
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & full
        numbers.append(x ^ x >> 32)
    out = []
    for a, b in zip(minhash._A, minhash._B, strict=True):
        x = min(((n * int(a) + int(b)) & full for n in numbers), default=full)
        x = ((x ^ x >> 32) * 0x9E3779B97F4A7C15) & full
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & full
        out.append((x ^ x >> 32) & 0xFFFF)
    return out


def test_signature_matches_plain_version():
    for t in (None, "", "One two", "a b c d e", " ".join(WORDS[:700]), "ä ö\tü " * 30):
        assert minhash.signature(t).tolist() == plain_signature(t)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9])
def test_long_texts_are_told_apart(share):
    rng, n = np.random.default_rng(6), 200_000
    x, y = rng.integers(0, 10**9, n).astype(str), rng.integers(0, 10**9, n).astype(str)
    y[: int(share * n)] = x[: int(share * n)]
    x, y = " ".join(x), " ".join(y)
    assert abs(minhash.likeness(minhash.signature(x), minhash.signature(y)) - jaccard(x, y)) < 0.1


def test_near_duplicates(spark):
    base = WORDS[:400]
    near = [*base[:200], "changed", *base[201:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(WORDS[1000:1400])), (5, ""), (6, None), (7, " ".join(base[:200])), (None, " ".join(base)), (None, "alone"), (4, "another row of an id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as own", "'x' as class_id")
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 5), (7, 7), (None, 1), (None, None)], key=str)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng, rows = np.random.default_rng(21), []
    for _ in range(25):
        text = list(rng.choice(WORDS, rng.integers(40, 300)))
        for edits in (0, 0, 1, 3, 6, 20):
            other = list(text)
            for at in rng.choice(len(text), edits, replace=False):
                other[at] = str(rng.choice(WORDS))
            rows.append((len(rows), " ".join(other)))
    up = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8 and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = [low if x == high else x for x in up]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), group_limit=20).collect()}
    apart = [i for i in got if got[i] != up[i]]
    assert all(up[got[i]] == up[i] for i in got) and len(apart) <= 2  # nothing is joined that isn't alike, and 998 in 1000 are


def test_word_pieces_match_the_library(spark):
    from tokenizers import models, pre_tokenizers

    path = P.path("piece_bpe_32k.model")
    starts, inner = wordpiece.vocabulary(path)
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*starts, *(f"##{p}" for p in inner), "[UNK]"]))}
    library = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9)
    cut = pre_tokenizers.BertPreTokenizer()
    own = wordpiece.LongestMatch(starts, inner)
    texts = ["Hello, unbelievable world! don't", "日本語 naïve ŁÓDŹ ½ €5 x_y", "a\x1cb \x85 c d", "", "  ", "\U0001F600 smile ", "antidisestablishmentarianism " * 50, LONG, "ouancthereßung, éèque | und."]
    for t in texts:
        words = [w for w, _ in cut.pre_tokenize_str(t)]
        tokens = [x.value for w in words for x in library.tokenize(w)]
        assert own.count(t) == (len(words), len(tokens), tokens.count("[UNK]")), t
    rng = np.random.default_rng(0)
    for _ in range(300):  # a small vocabulary, where failure links matter
        some = lambda: sorted({"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(12)})  # noqa: B023, E731
        first, rest = some(), some()
        small, plain = wordpiece.LongestMatch(first, rest), "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        at, n, entries = 0, 0, first
        while at < len(plain):
            size = max((len(e) for e in entries if plain.startswith(e, at)), default=0)
            if not size:
                n = -1
                break
            at, n, entries = at + size, n + 1, rest
        assert small.length(plain) == n
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, None), (None, "a b")]
    got = wordpiece.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 n_words"), path).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in got) == sorted((str(i), *own.count(t)) for i, t in rows)

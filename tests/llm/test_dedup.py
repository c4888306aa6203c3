import hashlib
from collections import defaultdict

import numpy as np
import xxhash

from quarry.llm import components, exact_dedup, simhash
from quarry.llm.common import materialize

ROWS = [(1, "a b c d e"), (2, None), (3, ""), (4, "a b c d e"), (5, "x" * 300_000), (5, "x" * 300_000), (6, "A b"), (7, "a B"), (8, "é ß"), (None, "a b c d e")]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def test_exact_against_grouping(spark):
    docs = frame(spark, ROWS).selectExpr("*", "1 as keep_id", "2 as digest")
    got = exact_dedup.exact_dedup(docs).collect()
    by = defaultdict(list)
    for i, t in ROWS:
        by[t or ""].append(i)
    assert len(got) == len(ROWS)
    for r in got:
        ids = by[r.text or ""]
        assert r.keep_id == max(i for i in ids if i is not None) and r.group_size == len(ids)
        assert r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_index_drops_what_an_earlier_batch_had(spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.drop_copies(frame(spark, [(1, "a"), (2, "b"), (3, "a")]), index).collect()
    assert sorted(r.doc_id for r in first) == [2, 3]
    second = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(9, "a"), (8, "c")]), index).collect()}
    assert (second[9].kept, second[9].keep_id) == (False, 3) and second[8].kept
    assert index.read().count() == 3
    index.drop()


def test_exact_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_fingerprint_matches_plain_version():
    rng = np.random.default_rng(1)
    words = ["the", "Of", "ÄB", "x y", "naïve", "Z" * 40]
    for n in (0, 1, 3, 4, 5, 40, 400):
        t = " \t\n".join(rng.choice(words, n))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def clustered(rng, n):
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2)
    out = []
    for _ in range(n):
        x = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out + [int(v) for v in rng.integers(0, 2**63, n, dtype=np.uint64)]


def test_links_against_all_pairs(spark):
    codes = sorted(set(clustered(np.random.default_rng(5), 400)))
    want = plain_components(codes, [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 4])
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    for limit in (8192, 50):  # the second splits every group into parts
        found = simhash.links(frame(spark, signed, "fp bigint"), 4, limit).collect()
        got = plain_components(codes, [(r.u % 2**64, r.v % 2**64) for r in found])
        assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(500, 560)] + [(3, 3), (-5, 140)]
    got = {r.node: r.root for r in components.components(frame(spark, edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: -5 for k in [-5, *range(100, 141)]}, **{k: 7 for k in [7, *range(500, 560)]}}


def test_groups_and_survivors(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(10, base), (11, base + " end"), (12, "other words here entirely now"), (13, ""), (14, None), (15, base), (16, "one")]
    docs = frame(spark, rows).selectExpr("*", "'s' as own", "'t' as component_id")
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert got[15].component_id == 10 and got[11].fingerprint == f"{plain_fingerprint(base + ' end'):016x}"
    assert got[14].component_id == 13 and got[13].fingerprint == "0" * 16
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {10, 12, 13, 16} and 15 not in {r.doc_id for r in kept.collect()}


def edited_copies(rng):
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(words, rng.integers(60, 300)))
        for edits in (0, 0, 1, 2, 4, 30):
            copy = list(base)
            for at in rng.choice(len(copy), min(edits, len(copy) // 2), replace=False):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(texts)] + [(1000, ""), (1001, None), (1002, "one two"), (1003, "one two"), (None, texts[0])]


def test_similar_texts(spark):
    rows = edited_copies(np.random.default_rng(11))
    docs = frame(spark, rows).selectExpr("*", "1 as own", "'r' as root").repartition(3)
    grams = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows if i is not None and i < 1000}
    ids = sorted(grams)
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    pairs = [(a, b, alike(a, b)) for k, a in enumerate(ids) for b in ids[k + 1 :] if grams[a] & grams[b]]
    want = plain_components(ids, [(a, b) for a, b, j in pairs if j >= 0.8])
    out = simhash.drop_similar(docs)
    assert out.columns == docs.columns
    got = {r.doc_id for r in out.collect()}
    for limit in (5,):
        assert {r.doc_id for r in simhash.drop_similar(docs, group_limit=limit).collect()} == got
    assert {1000, 1001, 1002, None} <= got and 1003 not in got
    got -= {1000, 1001, 1002, None}
    first = {i for i in ids if want[i] == i}
    assert first <= got and len(got - first) <= 0.02 * len(first)
    assert not [(a, b) for a, b, j in pairs if j >= 0.9 and a in got and b in got]
    assert simhash.drop_similar(docs.where("false")).count() == 0


def shadowed(rng, partners=250):
    """Texts on one long shared passage that are 0.78 alike, of each a partner at 0.8 or a little more."""
    passage, rows = [f"p{k}" for k in range(1000)], []
    for k in range(partners):
        own = [f"t{k}x{j}" for j in range(140)]
        copy = list(passage + own)
        for at in rng.choice(range(0, 1000, 10), 23, replace=False):
            copy[at] = f"e{k}x{at}"
        rows += [" ".join(passage + own), " ".join(copy)]
    return list(enumerate(rows))


def test_no_candidate_shadows_another(spark):
    """Whatever meets within the radius and is alike is joined, however many nearer texts are not alike."""
    rows = shadowed(np.random.default_rng(3))
    grams = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    assert alike(0, 2) < 0.8  # and so are all that are no partners: they share the passage alone
    sets = {i: np.unique(simhash.shingles(t, 5)) for i, t in rows}
    anchors, prints = {i: simhash.anchors(x) for i, x in sets.items()}, {i: simhash.set_fingerprint(x) for i, x in sets.items()}
    pairs = [(a, a + 1) for a in range(0, len(rows), 2) if alike(a, a + 1) >= 0.8]
    meet = [(a, b) for a, b in pairs if (anchors[a] == anchors[b]).any() and (prints[a] ^ prints[b]).bit_count() <= 20]
    assert len(meet) >= 0.99 * len(pairs) >= 200
    want = plain_components(grams, meet)
    docs = frame(spark, rows)
    features = materialize(simhash._features(docs, None, 5, "text", "doc_id"))
    own = {r.own: r.doc_id for r in features.collect()}
    for limit in (100,):
        links = simhash.similar_links(docs, features, group_limit=limit)
        assert plain_components(grams, [(own[r.u], own[r.v]) for r in links.collect()]) == want


def test_large_dense_block_is_dealt(spark):
    """A cluster that is over the limit in every block, with others that are not linked to it, at all kinds of parts."""
    rng = np.random.default_rng(9)
    centre, far = 0x123456789ABCDEF0, 0x123456789ABCDEF0 ^ 0b111111111
    codes = {centre, far} | {x ^ 1 << int(b) for x in (centre, far) for b in range(64)}
    codes |= {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) ^ (1 << int(d)) for a, b, c, d in rng.integers(0, 64, (600, 4))}
    codes = sorted(codes)
    want = plain_components(codes, [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 4])
    for limit in (300, 60):
        found = simhash.links(frame(spark, [(c - 2**64 if c >> 63 else c,) for c in codes], "fp bigint").repartition(4), 4, limit).collect()
        assert plain_components(codes, [(r.u % 2**64, r.v % 2**64) for r in found]) == want


def test_choices_hold_every_pair_and_grow():
    rng = np.random.default_rng(2)
    for number, m in ((10**6, 5), (10**8, 15), (10**10, 35), (10**12, 70)):
        masks = simhash.choices(4, number)
        assert len(masks) == m
        for _ in range(200):
            d = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(d & x == 0 for x in masks)


def test_both_steps_at_once(spark):
    rows = edited_copies(np.random.default_rng(4)) + [(2000, "x y " * 40_000), (2001, "x y " * 40_000 + "z"), (7, "a second row of an id")]
    docs = frame(spark, rows).selectExpr("*", "1 as own", "2 as _gone", "3 as `node`", "4 as `odd name.x`")
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, simhash.drop_similar(simhash.drop_near_copies(docs)).collect()))
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0

import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import simhash, toxicity
from quarry.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        out.append(docs)
    return [table(spark, SF, "documents"), *out]


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns_and_order(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    for docs in steps[1:-1]:
        assert docs.schema.simpleString() == steps[0].schema.simpleString()


def test_stages_against_plain_versions(spark, steps):
    raw, clean, single, apart, masked = map(rows, steps[:-1])
    lexicon = toxicity.learn(toxicity.sample(steps[0], table(spark, SF, "labels"), F.expr("crc32(cast(doc_id as string)) % 3 <> 1")))
    assert set(clean) == {i for i, r in raw.items() if lexicon.score(r.text) < toxicity.THRESHOLD}
    last = {}
    for i in sorted(clean):
        last[clean[i].text or ""] = i
    assert set(single) == set(last.values())
    prints = {i: simhash.fingerprint(r.text) for i, r in single.items()}
    root = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
                    changed = True
    left = [i for i in ids if root[i] == i]
    grams = {i: set(zip(*[single[i].text.split()[k:] for k in range(5)])) or {single[i].text} for i in left}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    assert set(apart) <= set(left)
    for b in set(left) - set(apart):  # what went has a like text, directly or through others
        assert max(alike(a, b) for a in left if a != b) >= 0.8
    stay = sorted(apart)
    assert all(alike(a, b) < 0.9 for k, a in enumerate(stay) for b in stay[k + 1 :] if grams[a] & grams[b])
    assert set(masked) == set(apart)
    for i, r in masked.items():
        assert r.n_chars == len(r.text)
        assert "@mail" not in r.text and len(re.findall(r"token = ", r.text)) == len(re.findall(r"token = ", apart[i].text))


def test_packing_holds_everything(steps):
    fill = defaultdict(list)
    pieces = steps[-1].collect()
    for r in pieces:
        fill[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in pieces} == set(rows(steps[-2]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= 1.02 * sum(r.length for r in pieces) / 2048 + 2


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, steps[-1].select("doc_id", "piece", "length", "ids_crc32").collect()))

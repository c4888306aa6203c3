import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity as tox


def test_folding():
    assert tox.fold("Ｉdiоt 1d10t MOR0N 5tupid sc​um") == "idiot idiot moron stupid scum"
    assert tox.fold("run 100% at 3 a.m. $$$ naïve!!") == "run 100% at 3 a.m. $$$ naïve!!"
    assert tox.fold(None) == ""


def plain(lexicon, text):
    """Every place, every entry, by hand."""
    folded, total, hits = tox.fold(text), 0.0, 0
    free = [True] * len(folded)
    starts = [k for k in range(len(folded)) if k == 0 or not folded[k - 1].isalpha()]
    for k in starts:
        for phrase in map(tox.fold, lexicon.exceptions):
            end = k + len(phrase)
            if folded.startswith(phrase, k) and (end == len(folded) or not folded[end].isalpha()):
                free[k:end] = [False] * len(phrase)
    for k in starts:
        best = max((e for e in lexicon.weights if folded.startswith(e, k)), key=len, default=None)
        if best and free[k]:
            total, hits = total + lexicon.weights[best], hits + 1
    return total, hits, len(folded.split())


def test_matches_every_place():
    lexicon = tox.Lexicon({"scum": 2.0, "scumm": 3.0, "idiot": 4.0, "he": 1.0, "clown": 1.5}, ("pond scum", "class clown"))
    rng = np.random.default_rng(2)
    parts = ["scum", "scummy", "pond scum", "pond scumbag", "1d10t", "he", "she", "the", "class clown", "clown", "!", "\n", "x" * 50]
    for n in (0, 1, 5, 60, 2000):
        text = " ".join(rng.choice(parts, n))
        assert lexicon.measure(text) == pytest.approx(plain(lexicon, text))


def test_long_texts_in_linear_time():
    lexicon = tox.Lexicon({"idiot": 4.0, "clown": 1.5}, ("class clown", "sore loser"))
    start = time.time()
    assert lexicon.measure("class clown 1d10t " * 40_000) == (160_000.0, 40_000, 120_000)
    assert lexicon.measure("x" * 3_000_000 + " clown") == (1.5, 1, 2) and lexicon.measure("idiot" * 200_000)[1] == 1
    assert len(lexicon.phrases("so clown here " * 40_000)) == 2 and time.time() - start < 20


def test_learns_words_and_stems(spark):
    rng = np.random.default_rng(7)
    common = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu") for b in ("ra", "son", "tin", "vel", "zor", "min")]
    docs, labels = [], []
    for i in range(900):
        words = list(rng.choice(common, rng.integers(20, 200)))
        bad = i % 6 == 0
        if bad:
            for _ in range(1 + len(words) // 25):
                words.insert(rng.integers(0, len(words)), str(rng.choice(["Blort", "snarkel" + str(rng.choice(common)), "bl0rt"])))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    for i in range(3000, 3030):  # harmless around a word that is toxic elsewhere
        docs.append((i, " ".join([*rng.choice(common, 30), "the Blort machine", *rng.choice(common, 30)])))
        labels.append((i, 0))
    docs += [(2000, None), (2001, ""), (None, "blort blort"), (5, "repeated id")]
    labels += [(2000, 0), (2001, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0.5D as score", "'x' as label")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    lexicon = tox.learn(tox.sample(docs, labels, F.expr("doc_id % 3 <> 1")))
    assert "blort" in lexicon.weights and any("snarkel".startswith(k) or k.startswith("snarkel") for k in lexicon.weights)
    assert "blort machine" in lexicon.exceptions and lexicon.measure("a blort machine")[1] == 0 and lexicon.measure("a blort")[1] == 1
    got = tox.scored(docs, lexicon)
    assert got.count() == docs.count()
    rows = {r.doc_id: r for r in got.collect()}
    held = [i for i in range(900) if i % 3 == 1 and i != 5]
    assert np.mean([rows[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert rows[2000].score == rows[2001].score < 0.7
    bounded = tox.sample(docs, labels, F.lit(True), size=50)
    assert bounded.count() <= 51


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        lexicon = tox.learn(tox.sample(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.lit(True)))
        assert [r.predicted for r in tox.scored(docs, lexicon).collect()] == [0, 0]
    assert tox.scored(docs.where("false"), lexicon).count() == 0

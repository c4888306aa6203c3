"""Operators that carry all columns: names that clash, odd names, every kind of column, nulls in each."""

import datetime

from quarry.llm import exact_dedup, pii, simhash, toxicity

SCHEMA = "doc_id bigint, text string, `odd name.x` string, score array<double>, kept map<string,int>, made timestamp, day date, digest binary, part struct<a:int,b:string>, amount decimal(10,2), found boolean"
AT = datetime.datetime(2024, 2, 3, 4, 5, 6, 7)
ROWS = [
    (1, "one two three four five six", "a", [1.0, None], {"k": 1}, AT, AT.date(), bytearray(b"x"), (1, "b"), None, True),
    (2, None, None, None, None, None, None, None, None, None, None),
    (None, "mail me at a.b@c.org", "", [], {}, AT, None, bytearray(b""), (None, None), None, False),
]


def values(frame):
    return sorted((str(tuple(r)) for r in frame.collect()))


def test_all_columns_come_through(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    whole = values(docs)
    scored = toxicity.scored(docs, toxicity.Lexicon({"nothing": 1.0}), score="s1", predicted="p1")
    assert values(scored.drop("s1", "p1")) == whole
    assert toxicity.scored(docs, toxicity.Lexicon()).columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert toxicity.scored(docs.withColumnRenamed("score", "Score"), toxicity.Lexicon()).columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert values(exact_dedup.drop_copies(docs)) == whole
    assert values(simhash.drop_near_copies(docs)) == whole and values(simhash.drop_similar(docs)) == whole
    done = pii.surrogates(docs, "k")
    assert values(done.drop("n_entities", "kinds", "text")) == values(docs.drop("text"))
    assert [r.n_entities for r in done.orderBy("doc_id").collect()] == [1, 0, 0]


def test_results_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b@c.org", "x", 5, True, "mine")], "doc_id bigint, text string, Keep_ID string, group_size int, kept boolean, Kinds string")
    assert exact_dedup.exact_dedup(docs).columns == ["doc_id", "text", "Kinds", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.drop_copies(docs).collect() == docs.collect()
    assert pii.surrogates(docs, "k").columns == ["doc_id", "text", "Keep_ID", "group_size", "kept", "n_entities", "kinds"]
    assert pii.surrogates(docs, "k", count="c1", kinds="k1").first().Kinds == "mine"


def test_stages_keep_every_column(spark):
    """The stages of the pipeline on names that their operators use, nulls, empty, long and repeated rows."""
    import corpus_pipeline

    words = "some plain words that say nothing of anybody at all and go on for a while"
    rows = [(k, f"{words} {k} " + " ".join(f"w{k * j}" for j in range(40)), "en", "s", 7, 0.5, 1, "mine", 3, k) for k in range(12)]
    rows += [(20, None, None, None, None, 7.0, 1, "mine", 3, 1), (21, "", "en", "s", 0, None, None, None, None, None), (None, words, "en", "s", 3, 1.0, 0, "m", 1, 2)]
    rows += [(22, "long " * 100_000 + "mail me at x@y.org", "de", "t", 500_018, 2.0, 0, "m", 1, 4)] * 3 + [(23, rows[3][1] + " end", "en", "s", 1, 3.0, 0, "k", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted int, kinds string, n_entities int, `_gone` int").repartition(3)
    folder = "/root/testdata/sf0.001"
    for empty in (False, True):
        now = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.schema.simpleString() == docs.schema.simpleString(), name
        got = now.collect()
        if empty:
            assert got == []
            continue
        by = {r.doc_id: r for r in got}
        # Of the two without text the exact copy goes; the row that ends 3's text is near it; repeated rows leave one.
        assert sorted(by, key=str) == sorted([*range(12), 21, 22, None], key=str) and len(got) == len(by)
        for r in rows:
            if r[0] in by and r[0] != 22:
                assert tuple(by[r[0]]) == r
        assert tuple(by[22])[5:] == rows[15][5:] and "x@y.org" not in by[22].text and by[22].n_chars == len(by[22].text)
        assert stage_pack(spark, corpus_pipeline, now, folder) == {r.doc_id for r in got}


def stage_pack(spark, pipeline, docs, folder):
    return {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, folder).collect()}

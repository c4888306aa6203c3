import datetime
import json
import time
import urllib.request
from io import StringIO

import numpy as np
import pandas as pd
import pytest

from quarry.cli import Prompt
from quarry.dialect.options import options
from quarry.dialect.tokenizer import Group, parse, render
from quarry.engine import Engine
from quarry.errors import ParsingException
from quarry.notebook import run_cell


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.create_table("df", pd.DataFrame({"a": [1, 2, 3, None], "b": [4.0, np.nan, 5.0, 6.0], "s": ["a b", "x\\y", "it's", None]}))
    e.create_table("t2", pd.DataFrame({"a": [1, 2, 2], "d": pd.to_datetime(["2021-10-03 15:53:42.000047", "2014-08-01", "2015-01-01"], format="ISO8601"), "i": [7, 8, 9]}))
    e.create_table("strings", pd.DataFrame({"k": range(4), "s": ["a normal string", "%_%", "^|()-*[]$", "^|()-*[]$\n%_%\na normal string"]}))
    return e


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_nan_is_null_and_null_order(engine):
    assert rows(engine.sql("SELECT a FROM df WHERE b IS NULL")) == [(2.0,)]
    assert [r[0] for r in rows(engine.sql("SELECT a FROM df ORDER BY a"))] == [1, 2, 3, None]
    assert [r[0] for r in rows(engine.sql("SELECT a FROM df ORDER BY a DESC"))] == [None, 3, 2, 1]
    assert [r[0] for r in rows(engine.sql("SELECT a FROM df ORDER BY a DESC NULLS LAST, b"))] == [3, 2, 1, None]


def test_strings_and_identifiers(engine):
    assert rows(engine.sql("SELECT s FROM df WHERE s = 'it''s'")) == [("it's",)]
    assert rows(engine.sql("SELECT 'x\\y' AS v, \"a\" AS \"1 st\" FROM df WHERE a = 2")) == [("x\\y", 2.0)]
    assert engine.sql("SELECT l.a, r.a FROM df l JOIN t2 r ON l.a = r.a").columns == ["l.a", "r.a"]
    assert rows(engine.sql("SELECT a -- note\n FROM df /* more */ WHERE a = 1")) == [(1.0,)]


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ("s LIKE '%n[a-z]rmal%'", []), ("s LIKE '%normal%'", [0, 3]), ("s LIKE '\\%\\_\\%'", [1]), ("s LIKE '!%!_!%' ESCAPE '!'", [1]), ("s LIKE '^|()-*r[r]$' ESCAPE 'r'", [2]),
        ("s ILIKE 'A NORMAL%'", [0]), ("s SIMILAR TO '%n[a-z]rmal st_i%'", [0, 3]), ("s SIMILAR TO 'a normal string|%_%'", [0, 1, 2, 3]), ("s NOT LIKE '%string%'", [1, 2]),
    ],
)
def test_patterns(engine, condition, want):
    assert [r[0] for r in rows(engine.sql(f"SELECT k FROM strings WHERE {condition} ORDER BY k"))] == want


def test_whole_division(engine):
    frame = engine.sql("SELECT 1/2, 3/2 AS x, 1.0/2 AS y, (1/2)+1 AS z, i/2 h FROM t2 WHERE i = 7")
    assert frame.columns == ["1 / 2", "x", "y", "z", "h"]
    assert [float(v) for v in rows(frame)[0]] == [0, 1, 0.5, 1, 3]  # a column of whole numbers is whole, whatever is computed on the way
    assert rows(engine.sql("WITH c AS (SELECT 7/2 AS x) SELECT x, (SELECT 9/2) AS y FROM c UNION ALL SELECT 5/2, 3 FROM (SELECT 7/3 AS z) t WHERE z = 2")) == [(3, 4), (2, 3)]
    assert rows(engine.sql("SELECT i/(a-a) AS x, i*1.0/(i-7) AS y, MOD(i, i-7) AS m, i % (i-7) AS r FROM t2 WHERE i = 7")) == [(None, None, None, None)]


def test_windows_count_rows(engine):
    assert rows(engine.sql("SELECT a, COUNT(*) OVER (ORDER BY i / 100) AS n FROM t2")) == [(1, 1), (2, 2), (2, 3)]
    assert [r[0] for r in rows(engine.sql("SELECT COUNT(*) FILTER (WHERE i > 7) OVER (ORDER BY i) AS n FROM t2"))] == [0, 1, 2]


def test_time_functions(engine):
    sql = """SELECT EXTRACT(CENTURY FROM d) AS c, EXTRACT(DECADE FROM d) AS de, EXTRACT(MILLENNIUM FROM d) AS ml, EXTRACT(DOW FROM d) AS dow, EXTRACT(MILLISECOND FROM d) AS ms, EXTRACT(MICROSECOND FROM d) AS us,
        CEIL(d TO DAY) AS cd, CEIL(d TO SECOND) AS cs, FLOOR(d TO HOUR) AS fh, LAST_DAY(d) AS l, TIMESTAMPADD(MONTH, 2, d) AS t, EXTRACT(DATE FROM d) AS dt FROM t2 WHERE a = 1"""
    at = datetime.datetime
    assert rows(engine.sql(sql)) == [(20, 202, 2, 0, 47000, 47, at(2021, 10, 4), at(2021, 10, 3, 15, 53, 43), at(2021, 10, 3, 15), at(2021, 10, 31, 15, 53, 42, 47), at(2021, 12, 3, 15, 53, 42, 47), datetime.date(2021, 10, 3))]
    assert rows(engine.sql("SELECT TO_TIMESTAMP('02/28/1997', \"%m/%d/%Y\") AS a, TO_TIMESTAMP(1203073300) AS b, TIMESTAMPDIFF(QUARTER, TIMESTAMP '2002-09-01 00:00:00', TIMESTAMP '2003-06-05 00:00:00') AS c")) == [(at(1997, 2, 28), at(2008, 2, 15, 11, 1, 40), 3)]
    assert len(rows(engine.sql("SELECT * FROM t2 WHERE d + 5 > TIMESTAMP '2015-01-02 00:00:00'"))) == 2
    for bad, error in (("SELECT FLOOR(d TO YEAR) FROM t2", NotImplementedError), ("SELECT TIMESTAMPADD(DAY, -1, d) FROM t2", RuntimeError), ("SELECT TO_TIMESTAMP(1, '%Y') FROM t2", RuntimeError)):
        with pytest.raises(error):
            engine.sql(bad)


def test_text_functions(engine):
    sql = """SELECT MOD(-7, 3) AS a, MOD(5, -3) AS a2, ROUND(2.5) AS b, TRUNCATE(-1.7) AS c, SUBSTRING('abc' FROM -1 FOR 2) AS d, OVERLAY('abcd' PLACING 'X' FROM 2 FOR 1) AS e, OVERLAY('abcd' PLACING 'XY' FROM -1) AS e2,
        POSITION('b' IN 'abcb' FROM 3) AS f, INITCAP('o''neil mc-x') AS g, LTRIM('aab', 'a') AS h, TRIM(TRAILING 'b' FROM 'abb') AS i"""
    assert [str(v) for v in rows(engine.sql(sql))[0]] == ["2", "-1", "2.0", "-1.0", "ab", "aXcd", "XYcd", "4", "O'Neil Mc-X", "b", "a"]


def test_schemas_and_tables(engine):
    for sql in ("CREATE SCHEMA foo", "CREATE TABLE foo.x AS (SELECT a FROM df)", "CREATE TABLE IF NOT EXISTS foo.x AS (SELECT 1 AS z)", "CREATE OR REPLACE VIEW foo.v AS SELECT a FROM foo.x WHERE a > 1"):
        engine.sql(sql)
    assert len(rows(engine.sql("SELECT x.a FROM foo.x"))) == 4 and len(rows(engine.sql("SELECT * FROM quarry.foo.v"))) == 2
    assert rows(engine.sql("SHOW SCHEMAS LIKE 'foo'")) == [("foo",)] and rows(engine.sql("SHOW TABLES FROM foo")) == [("x",), ("v",)]
    engine.sql("USE SCHEMA foo")
    engine.sql("ALTER TABLE x RENAME TO y")
    assert rows(engine.sql("SELECT COUNT(*) AS n FROM Y")) == [(4,)]
    engine.sql("DROP TABLE y")
    engine.sql("DROP TABLE IF EXISTS y")
    for bad, error in (("DROP TABLE y", RuntimeError), ("CREATE SCHEMA foo", RuntimeError), ("DROP SCHEMA root", RuntimeError), ("USE SCHEMA nope", RuntimeError), ("SELECT * FROM y", ParsingException), ("CREATE TABLE z WITH (format = 'csv')", AttributeError)):
        with pytest.raises(error):
            engine.sql(bad)
    engine.sql("DROP SCHEMA foo")
    assert engine.schema_name == "root"
    with pytest.raises(RuntimeError):
        engine.sql("SELECT 1; SELECT 2")


@pytest.mark.parametrize("form", ["csv", "json", "parquet", "orc"])
def test_locations(engine, tmp_path, form):
    place = f"{tmp_path}/t.{form}"
    writer = engine.table("t2").select("a", "i").write
    (writer.option("header", True) if form == "csv" else writer).format(form).save(place)
    engine.sql(f"CREATE TABLE x WITH (location = '{place}', persist = True)")
    assert sorted(rows(engine.sql("SELECT a, i FROM x"))) == [(1, 7), (2, 8), (2, 9)]
    engine.create_table("two", [place, place])
    assert engine.sql("SELECT COUNT(*) AS n FROM two").first().n == 6
    for bad in (f"{tmp_path}/none.xyz", 12):
        with pytest.raises((AttributeError, ValueError)):
            engine.create_table("bad", bad)


def test_options_grammar():
    text = "(a = 1, b = 'x', c = ARRAY[1, 2.5, 'z'], d = MAP['k', 1, 'l', ARRAY[2]], e = (f = True, g = -3), h = MULTISET[1, 1], i = \"q\", j = (1, 2))"
    group = parse(text).items[0]
    assert isinstance(group, Group)
    assert options(group) == {"a": 1, "b": "x", "c": [1, 2.5, "z"], "d": {"k": 1, "l": [2]}, "e": {"f": True, "g": -3}, "h": {1}, "i": "q", "j": (1, 2)}
    assert render(parse("SELECT  a FROM (b)")) == "SELECT a FROM (b)"
    for bad in ("SELECT (1", "SELECT 1)", "SELECT 'a"):
        with pytest.raises(ParsingException):
            parse(bad)


def test_functions(engine):
    double = lambda x: x * 2
    engine.register_function(double, "f", [("x", np.int64)], np.int64)
    engine.register_function(lambda row, k: row["x"] + k, "g", [("x", np.int64), ("k", np.int64)], np.int64, row_udf=True)
    engine.register_aggregation(lambda s: s.max() - s.min(), "span", [("x", np.int64)], np.float64)
    assert rows(engine.sql("SELECT F(i) AS x, g(i, 2) AS y FROM t2 ORDER BY i")) == [(14, 9), (16, 10), (18, 11)]
    assert rows(engine.sql("SELECT a, span(i) AS x FROM t2 GROUP BY a ORDER BY a")) == [(1, 0.0), (2, 1.0)]
    with pytest.raises(ValueError, match="different"):
        engine.register_function(lambda x: x, "f", [("x", np.int64)], np.int64)
    engine.register_function(lambda x: x, "f", [("x", np.int64)], np.int64, replace=True)
    assert rows(engine.sql("SELECT f(i) AS x FROM t2 WHERE i = 7")) == [(7,)]
    with pytest.raises(NotImplementedError):
        engine.register_function(double, "h", [("x", "no such type")], np.int64)

    class Steps:
        chunk = staticmethod(lambda g: g.sum())
        agg = staticmethod(lambda g: g.sum())

    engine.register_aggregation(Steps(), "total", [("x", np.int64)], np.int64)
    assert rows(engine.sql("SELECT total(i) AS x FROM t2")) == [(24,)]
    assert rows(engine.sql("SELECT a, COUNT(*) AS n, total(i) AS x FROM t2 GROUP BY a ORDER BY a")) == [(1, 1, 7), (2, 2, 17)]
    assert rows(engine.sql("SELECT total(i) AS x FROM t2 WHERE i > 100")) == [(None,)]
    by = engine.sql("SELECT NULLIF(a, 1) AS k, s, total(i) AS x FROM (SELECT t2.a, t2.i, df.s FROM t2 LEFT JOIN df ON t2.a = df.a AND t2.i < 9) t GROUP BY NULLIF(a, 1), s")
    assert sorted(map(str, rows(by))) == sorted(map(str, [(None, "a b", 7), (2, "x\\y", 8), (2, None, 9)]))
    both = engine.sql("SELECT a, span(i) AS d, SUM(i) / COUNT(*) AS m, total(i) AS x FROM t2 GROUP BY a ORDER BY a DESC LIMIT 1")
    assert rows(both) == [(2, 1.0, 8, 17)]
    plan = engine.explain("SELECT a, total(i) AS x FROM t2 GROUP BY a")
    assert "MapInArrow" in plan and "ArrowAggregatePython" not in plan and "AggregateInPandas" not in plan


def test_models(engine, tmp_path):
    engine.sql("CREATE MODEL m WITH (model_class = 'LinearRegression', target_column = 'i') AS (SELECT a, i FROM t2)")
    assert [round(r.target, 6) for r in engine.sql("SELECT a, target FROM PREDICT(MODEL m, SELECT a FROM t2) WHERE target > 8").collect()] == [8.5, 8.5]
    with pytest.raises(RuntimeError):
        engine.sql("CREATE MODEL m WITH (model_class = 'LinearRegression', target_column = 'i') AS (SELECT a, i FROM t2)")
    assert ("model_class", "LinearRegressionModel") in rows(engine.sql("DESCRIBE MODEL m"))
    engine.sql(f"EXPORT MODEL m WITH (format = 'pickle', location = '{tmp_path}/m')")
    assert (tmp_path / "m").exists()
    with pytest.raises(NotImplementedError):
        engine.sql(f"EXPORT MODEL m WITH (format = 'onnx', location = '{tmp_path}/m')")
    engine.sql("DROP MODEL m")
    for bad, error in (("SELECT * FROM PREDICT(MODEL m, SELECT a FROM t2)", KeyError), ("DROP MODEL m", RuntimeError), ("CREATE MODEL n WITH (target_column = 'i') AS (SELECT * FROM t2)", ValueError), ("CREATE MODEL n WITH (model_class = 'No') AS (SELECT * FROM t2)", ValueError)):
        with pytest.raises(error):
            engine.sql(bad)

    class Mean:
        def predict(self, rows):
            return rows["a"] * 10.0

    engine.register_model("own", Mean(), ["a"])
    assert sorted(r.target for r in engine.sql("SELECT * FROM PREDICT(MODEL own, SELECT a FROM t2)").collect()) == [10.0, 20.0, 20.0]


def test_explain_and_config(engine):
    text = engine.explain("SELECT a FROM t2 WHERE i > 7")
    assert "Physical Plan" in text and isinstance(engine.sql("EXPLAIN SELECT a FROM t2"), str)
    plan = engine.sql("SELECT t2.a FROM t2 JOIN df ON t2.a = df.a", config_options={"sql.join.broadcast": False})
    assert plan.count() == 3
    with pytest.raises(KeyError):
        engine.sql("SELECT 1 AS a", config_options={"sql.nope": 1})


def fetch(method, url, body=None):
    request = urllib.request.Request(url, data=body.encode() if body else None, method=method)
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.loads(answer.read())


def test_server(engine):
    server = engine.run_server(host="127.0.0.1", port=0)
    base = f"http://127.0.0.1:{server.port}"
    try:
        assert fetch("GET", f"{base}/v1/empty")["stats"]["state"] == "FINISHED"
        got = fetch("POST", f"{base}/v1/statement", "SELECT 1 + 1 AS two, CAST('NaN' AS DOUBLE) AS n, NULL AS z")
        assert "nextUri" in got and "partialCancelUri" in got
        while "nextUri" in got:
            time.sleep(0.1)
            got = fetch("GET", got["nextUri"])
        assert got["data"] == [[2, "NaN", None]] and [c["name"] for c in got["columns"]] == ["two", "n", "z"] and got["columns"][0]["type"] == "integer"
        assert "nope" in fetch("POST", f"{base}/v1/statement", "SELECT * FROM nope")["error"]["message"]
        assert "error" not in fetch("POST", f"{base}/v1/statement", "CREATE TABLE made AS (SELECT 1 AS a)")
        got = fetch("POST", f"{base}/v1/statement", "SELECT TABLE_NAME FROM system.jdbc.tables WHERE TABLE_NAME = 'made'")
        while "nextUri" in got:
            time.sleep(0.1)
            got = fetch("GET", got["nextUri"])
        assert got["data"] == [["made"]]
        waiting = fetch("POST", f"{base}/v1/statement", "SELECT 1 AS a")
        assert fetch("DELETE", waiting["partialCancelUri"])["stats"]["state"] == "FINISHED"
    finally:
        engine.stop_server()


def test_prompt_and_notebook(engine):
    out = StringIO()
    Prompt(engine, out).loop(StringIO("\\l\n\\dt\nSELECT 40 + 2 AS answer;\nSELECT nope;\n\\dss gone\n\\conninfo\nquit\nSELECT 5 AS never\n"))
    text = out.getvalue()
    assert all(w in text for w in ("root", "t2", "answer", "42", "ParsingException", "not available", "local")) and "never" not in text
    frame = run_cell(engine, "SELECT a FROM own WHERE a > {least}", {"own": pd.DataFrame({"a": [1, 2]}), "least": 1}, auto_include=True, out=lambda _: None)
    assert frame["a"].tolist() == [2]


def test_wrapped_models_and_metrics(spark):
    from quarry.ml import metrics
    from quarry.ml.wrappers import Incremental, ParallelPostFit

    class Line:
        """A least-squares line through the origin, by sums."""

        def __init__(self):
            self.xy = self.xx = 0.0

        def partial_fit(self, x, y):
            self.xy += float((x["x"] * y).sum())
            self.xx += float((x["x"] ** 2).sum())
            return self

        fit = partial_fit

        def predict(self, x):
            return (x["x"] * self.xy / self.xx).to_numpy()

        def predict_proba(self, x):
            return np.stack([self.predict(x), 1 - self.predict(x)], axis=1)

    data = spark.createDataFrame([(float(k), 3.0 * k) for k in range(1, 50)], "x double, y double").repartition(3)
    for model in (ParallelPostFit(Line()).fit(data, "y"), Incremental(Line()).fit(data, "y", batch_size=10)):
        found = model.predict(data)
        assert metrics.mean_squared_error(found, "y", "predict") < 1e-12 and metrics.r2(found, "y", "predict") > 0.999
        assert model.score(data, "y") > 0.999
        assert len(model.predict_proba(data).first().predict_proba) == 2
    labels = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.4), (0, 0, 0.1)], "y int, p int, q double")
    assert abs(metrics.accuracy(labels, "y", "p") - 2 / 3) < 1e-12
    assert abs(metrics.log_loss(labels, "y", "q") + (np.log(0.9) + np.log(0.6) + np.log(0.9)) / 3) < 1e-12


def test_streams_are_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarry.streaming.windows import register_stream, tumbling

    rows = [(k, datetime.datetime(2024, 1, 1, k // 30, k % 60), float(k)) for k in range(60)]
    spark.createDataFrame(rows, "id bigint, ts timestamp, v double").write.parquet(f"{tmp_path}/in")
    engine = Engine(spark)
    register_stream(engine, "live", f"{tmp_path}/in", "id bigint, ts timestamp, v double")
    frame = tumbling(engine.sql("SELECT ts, v FROM live WHERE v >= 10"), "ts", "1 hour", [], {"n": F.count(F.lit(1))})
    assert frame.isStreaming
    query = frame.writeStream.outputMode("complete").format("memory").queryName("live_out").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.n for r in spark.table("live_out").collect()) == 50


def test_show_models_learns_from_the_whole_table(spark):
    from harness import SF

    from quarry.operators import statements
    from quarry.operators.registry import engine_for

    engine = engine_for(spark, SF, "part")
    statements.show_models(engine)
    statements.predict_model(engine)
    fitted = [m[0] if isinstance(m, tuple) else m for m in (engine.schema().models["m"], engine.schema().models["price"])]
    a, b = (m.stages[-1] for m in fitted)
    assert a.intercept == pytest.approx(b.intercept) and list(a.coefficients) == pytest.approx(list(b.coefficients))


def test_searches_and_their_errors(engine):
    made = "CREATE EXPERIMENT e WITH ({}) AS (SELECT a, i FROM t2)"
    cases = [
        ("target_column = 'i'", "'model_class' or 'automl_class'"), ("model_class = 'LinearRegression', target_column = 'i'", "'experiment_class'"),
        ("model_class = 'LinearRegression', experiment_class = 'no.such.Search', target_column = 'i'", "Can not import tuner no.such.Search"),
        ("automl_class = 'no.such.Auto', target_column = 'i'", "Can not import automl model no.such.Auto"), ("model_class = 'KMeans', experiment_class = 'GridSearchCV'", "Unsupervised Algorithm cannot be tuned Automatically,"),
    ]
    for options, said in cases:
        with pytest.raises(ValueError, match=said):
            engine.sql(made.format(options))


def test_models_of_other_libraries_are_bounded(spark):
    from quarry.ml.names import in_driver, result_type

    assert len(in_driver(spark.range(10), 10)) == 10
    with pytest.raises(ValueError, match="more than 9 rows"):
        in_driver(spark.range(10), 9)
    labelled = type("M", (), {"classes_": np.array([1, 2])})()
    assert [result_type(None, np.array([1])), result_type(labelled, np.array([1])), result_type(None, np.array(["x"])), result_type(None, np.zeros((1, 2)))] == ["double", "bigint", "string", "array<double>"]


def test_random_settings_are_drawn_without_repeats():
    import random

    from quarry.ml.experiment import drawn

    found = drawn([[1, 2], [3, 4, 5], [6]], 4, random.Random(1))
    assert len(set(found)) == 4 and all(a in (1, 2) and b in (3, 4, 5) and c == 6 for a, b, c in found)
    assert sorted(drawn([[1, 2], [3]], 9, random.Random(1))) == [(1, 3), (2, 3)]


def test_steps_take_many_groups_at_once(spark):
    from pyspark.sql import functions as F

    from quarry.functions import tree
    from quarry.plans.settings import overlay

    class Kinds:
        """Sum and number of a group, told with how many groups were finished at once."""

        @staticmethod
        def chunk(g):
            return g.sum(), g.count()

        @staticmethod
        def agg(total, count):
            return total.sum(), count.sum()

        @staticmethod
        def finalize(total, count):
            return total * 1000 + count + len(total) * 1e-6

    frame = spark.range(0, 30_000, 1, 4).select(F.when(F.col("id") % 3 > 0, F.col("id") % 997).otherwise(F.when(F.col("id") % 2 == 0, 5)).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    want = {r.k: r.s * 1000 + r.n for r in frame.groupBy("k").agg(F.sum("v").alias("s"), F.count("v").alias("n")).collect()}
    for options in ({}, {"most": 700}):  # the second: many batches, and groups that span them
        with overlay(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}):
            got = {r.k: r.x for r in tree.aggregate(frame, ["k"], {"x": (Kinds, "v", "double")}, **options).collect()}
        assert {k: int(x) for k, x in got.items()} == want
        assert options or max(round(x % 1 * 1e6) for x in got.values()) > 20
    whole = tree.aggregate(frame, [], {"x": (Kinds, "v", "double")}).first().x
    assert int(whole) == sum(r for r in want.values())
    assert tree.aggregate(frame.where("k < 0"), [], {"x": (Kinds, "v", "double")}).first().x is None


def test_steps_finish_group_by_group_if_they_must(spark):
    from quarry.functions import tree

    alone = type("Alone", (), {"chunk": staticmethod(lambda g: g.sum()), "agg": staticmethod(lambda g: g.sum()), "finalize": staticmethod(lambda s: float(s.iloc[0]) if s.iloc[0] > 2 else None)})
    frame = spark.createDataFrame([(0.0, 1.0), (-0.0, 4.0), (None, 1.0), (float("nan"), 1.0), (1.0, 9.0)], "k double, v double")
    got = sorted(((str(r.k), r.x) for r in tree.aggregate(frame, ["k"], {"x": (alone, "v", "double")}).collect()), key=str)
    assert got == [("0.0", 5.0), ("1.0", 9.0), ("None", None), ("nan", None)]


class Seen:
    """Counts rows and calls; its ``partial_fit`` wants the classes."""

    def __init__(self):
        self.rows, self.calls, self.classes = [], 0, None

    def partial_fit(self, x, y, classes=None):
        self.rows += list(zip(x["x"], y, strict=True))
        self.calls, self.classes = self.calls + 1, list(classes)
        return self

    def fit(self, x, y):
        return self.partial_fit(x, y, [])

    def predict(self, x):
        return np.full(len(x), float(len(self.rows)))


def test_models_with_partial_fit_take_tables_of_any_size(spark):
    engine = Engine(spark)
    engine.create_table("many", spark.range(0, 25_000, 1, 3).selectExpr("CAST(id AS DOUBLE) AS x", "id % 3 AS y"))
    for options, calls in ("driver_rows = 25000", 1), ("driver_rows = 24999", 3):
        engine.sql(f"CREATE OR REPLACE MODEL seen WITH (model_class = 'test_engine.Seen', target_column = 'y', {options}) AS (SELECT x, y FROM many)")
        model, columns = engine.model("seen")
        assert columns == ["x"] and model.calls == calls and model.classes == ([] if calls == 1 else [0, 1, 2])
        assert sorted(model.rows) == [(float(k), k % 3) for k in range(25_000)]


def test_wrapped_models_with_partial_fit_take_tables_of_any_size(spark):
    from quarry.ml.wrappers import ParallelPostFit

    data = spark.range(0, 25_000, 1, 3).selectExpr("CAST(id AS DOUBLE) AS x", "id % 3 AS y")
    fitted = ParallelPostFit(Seen()).fit(data, "y", driver_rows=1000)
    assert sorted(fitted.model.rows) == [(float(k), k % 3) for k in range(25_000)] and fitted.model.calls == 3 and fitted.columns == ["x"]
    with pytest.raises(ValueError, match="more than 1000 rows"):
        ParallelPostFit(type("Whole", (), {"fit": lambda self, x, y: self})()).fit(data, "y", driver_rows=1000)


def test_ties_of_extremes_go_to_the_least(spark):
    rows = [(5, 1.5, "b", 7.0), (2, -2.5, "ab", 7.0), (3, 2.5, "a", 7.0), (1, 0.5, "c", 3.0), (9, 0.1, "z", None), (None, None, None, 7.0), (10, 10.0, "q", 1.0), (9, 9.0, "p", 1.0)]
    for order in (1, -1):  # whatever order the rows come in
        engine = Engine(spark)
        engine.create_table("t", spark.createDataFrame(rows[::order], "i int, d double, s string, y double").coalesce(1))
        got = engine.sql("SELECT MAX_BY(i, y), MAX_BY(d, y), MAX_BY(s, y), MIN_BY(i, y), MIN_BY(d, y), MIN_BY(s, y), MAX_BY(CAST(d AS DECIMAL(5, 2)), y), MAX_BY(i + 1, y) FILTER (WHERE i > 2), MAX_BY(s, i) FROM t").first()
        assert tuple(got) == (2, -2.5, "a", 9, 9.0, "p", got[6], 4, "q") and float(got[6]) == -2.5


def test_sketches_beside_distinct_counts_have_a_buffer_for_each_group(spark):
    import re

    engine = Engine(spark)
    engine.create_table("t", spark.range(0, 6000, 1, 3).selectExpr("id % 3 AS k", "id % 700 AS y", "id % 900 AS x"))
    alone = {r.k: (r.a, r.b, r.c) for r in engine.sql("SELECT k, APPROX_COUNT_DISTINCT(y) AS a, APPROX_COUNT_DISTINCT(x, 0.02) AS b, APPROX_COUNT_DISTINCT(y) FILTER (WHERE x > 99) AS c FROM t GROUP BY k").collect()}
    frame = engine.sql("SELECT k, APPROX_COUNT_DISTINCT(y) + 0 AS a, APPROX_COUNT_DISTINCT(x, 0.02) AS b, APPROX_COUNT_DISTINCT(y) FILTER (WHERE x > 99) AS c, COUNT(DISTINCT y) AS n FROM t GROUP BY k")
    assert {r.k: (r.a, r.b, r.c) for r in frame.collect()} == alone and {r.n for r in frame.collect()} == {700}
    one = engine.sql("SELECT k, ABS(APPROX_COUNT_DISTINCT(y) - COUNT(DISTINCT y)) < 100 AS near FROM t GROUP BY k")
    assert all(r.near for r in one.collect())
    for plan in frame, one:
        found = re.findall(r"Aggregate\(keys=\[([^\]]*)\], functions=\[(.*?)\], output", plan._jdf.queryExecution().executedPlan().toString())
        assert found and any("approx" in f for _, f in found) and all("," not in keys for keys, f in found if "approx" in f)
    # Windows take no DISTINCT, and the other side of a union needs none.
    assert engine.sql("SELECT COUNT(DISTINCT k) AS n FROM t UNION ALL SELECT APPROX_COUNT_DISTINCT(k) FROM t").count() == 2
    assert engine.sql("SELECT k, COUNT(DISTINCT y) AS n, MAX(APPROX_COUNT_DISTINCT(k)) OVER () AS m FROM t GROUP BY k").count() == 3
    assert engine.sql("SELECT k, APPROX_COUNT_DISTINCT(y) OVER (PARTITION BY k) AS m FROM t WHERE k IN (SELECT COUNT(DISTINCT k) - 1 FROM t)").count() == 2000

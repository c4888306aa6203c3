"""DDL, metadata, functions and models (Q, U, L)."""

import numpy as np

from quarry.operators.registry import query


@query("SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey", tables="customer")
def create_table_as(engine):
    engine.sql("CREATE TABLE rich AS (SELECT * FROM customer WHERE c_acctbal > 0)")
    return engine.sql("SELECT c_nationkey, COUNT(*) AS n FROM rich GROUP BY c_nationkey")


@query("SELECT r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", tables="nation region")
def create_view(engine):
    engine.sql("CREATE SCHEMA sales")
    engine.sql("CREATE OR REPLACE VIEW sales.places AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
    return engine.sql("SELECT r_name, COUNT(*) AS n FROM sales.places GROUP BY r_name")


@query("SELECT * FROM (VALUES ('region'), ('renamed')) AS t(\"Table\")", tables="nation region")
def show_tables(engine):
    engine.sql("ALTER TABLE nation RENAME TO renamed")
    return engine.sql("SHOW TABLES")


@query("SELECT * FROM (VALUES ('root'), ('b'), ('information_schema')) AS t(\"Schema\")", tables="")
def show_schemas(engine):
    for sql in ("CREATE SCHEMA a", "CREATE SCHEMA IF NOT EXISTS a", "ALTER SCHEMA a RENAME TO b", "CREATE SCHEMA c", "DROP SCHEMA c", "DROP SCHEMA IF EXISTS c"):
        engine.sql(sql)
    return engine.sql("SHOW SCHEMAS")


@query("SELECT * FROM (VALUES ('n_nationkey', 'integer', '', ''), ('n_name', 'varchar', '', ''), ('n_regionkey', 'integer', '', '')) AS t(\"Column\", \"Type\", \"Extra\", \"Comment\")", tables="nation")
def show_columns(engine):
    return engine.sql("SHOW COLUMNS FROM nation")


@query(
    """WITH x AS (SELECT COUNT(p_size) AS c, CAST(AVG(p_size) AS VARCHAR) AS m, CAST(STDDEV(p_size) AS VARCHAR) AS d, MIN(p_size) AS lo, MAX(p_size) AS hi,
                         quantile_disc(p_size, 0.25) AS q1, quantile_disc(p_size, 0.5) AS q2, quantile_disc(p_size, 0.75) AS q3, COUNT(p_brand) AS bc, MIN(p_brand) AS bl, MAX(p_brand) AS bh FROM part)
       SELECT 'count' AS summary, CAST(c AS VARCHAR) AS p_size, CAST(bc AS VARCHAR) AS p_brand FROM x UNION ALL SELECT 'min', CAST(lo AS VARCHAR), bl FROM x UNION ALL SELECT 'max', CAST(hi AS VARCHAR), bh FROM x
       UNION ALL SELECT '25%', CAST(q1 AS VARCHAR), NULL FROM x UNION ALL SELECT '50%', CAST(q2 AS VARCHAR), NULL FROM x UNION ALL SELECT '75%', CAST(q3 AS VARCHAR), NULL FROM x
       UNION ALL SELECT 'mean', CAST(ROUND(CAST(m AS DOUBLE), 6) AS VARCHAR), NULL FROM x UNION ALL SELECT 'std', CAST(ROUND(CAST(d AS DOUBLE), 6) AS VARCHAR), NULL FROM x UNION ALL SELECT 'data_type', 'integer', 'varchar' UNION ALL SELECT 'col_name', 'p_size', 'p_brand'""",
    tables="part",
)
def analyze_table(engine):
    engine.create_table("told", engine.sql("ANALYZE TABLE part COMPUTE STATISTICS FOR COLUMNS p_size, p_brand"))
    return engine.sql("SELECT summary, CASE WHEN summary IN ('mean', 'std') THEN CAST(ROUND(TRY_CAST(p_size AS DOUBLE), 6) AS VARCHAR) ELSE p_size END AS p_size, p_brand FROM told")


@query("SELECT s_suppkey, s_acctbal * 1.1 + s_nationkey AS x FROM supplier", tables="supplier")
def udf_scalar(engine):
    engine.register_function(lambda a, n: a * 1.1 + n, "grown", [("a", np.float64), ("n", np.int32)], np.float64)
    return engine.sql("SELECT s_suppkey, GROWN(s_acctbal, s_nationkey) AS x FROM supplier")


@query("SELECT s_suppkey, s_suppkey * s_nationkey + 3 AS x FROM supplier", tables="supplier")
def udf_row(engine):
    engine.register_function(lambda row, k: row["a"] * row["b"] + k, "weigh", [("a", np.int64), ("b", np.int32), ("k", np.int64)], np.int64, row_udf=True)
    return engine.sql("SELECT s_suppkey, weigh(s_suppkey, s_nationkey, 3) AS x FROM supplier")


@query("SELECT c_nationkey, MAX(c_acctbal) - MIN(c_acctbal) AS x FROM customer GROUP BY c_nationkey", tables="customer")
def udaf(engine):
    engine.register_aggregation(lambda s: s.max() - s.min(), "spread", [("x", np.float64)], np.float64)
    return engine.sql("SELECT c_nationkey, SPREAD(c_acctbal) AS x FROM customer GROUP BY c_nationkey")


@query("SELECT c_custkey, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) - MIN(c_acctbal) OVER (PARTITION BY c_nationkey) AS x FROM customer", tables="customer")
def udaf_window(engine):
    engine.register_aggregation(lambda s: s.max() - s.min(), "spread", [("x", np.float64)], np.float64)
    return engine.sql("SELECT c_custkey, SPREAD(c_acctbal) OVER (PARTITION BY c_nationkey) AS x FROM customer")


class MeanOfSquares:
    """An aggregation in steps: sums and counts of each chunk, then of chunks, then their ratio."""

    @staticmethod
    def chunk(g):
        return g.agg(lambda s: (s * s).sum()), g.count()

    @staticmethod
    def agg(total, count):
        return total.sum(), count.sum()

    @staticmethod
    def finalize(total, count):
        return total / count


@query("SELECT l_returnflag, l_suppkey, AVG(l_quantity * l_quantity) AS x, AVG(l_tax * l_tax) AS y FROM lineitem WHERE l_linenumber > 1 GROUP BY l_returnflag, l_suppkey", tables="lineitem")
def udaf_in_steps(engine):
    engine.register_aggregation(MeanOfSquares(), "mean_sq", [("x", np.float64)], np.float64)
    return engine.sql("SELECT l_returnflag, l_suppkey, MEAN_SQ(l_quantity) AS x, mean_sq(l_tax) AS y FROM lineitem WHERE l_linenumber > 1 GROUP BY l_returnflag, l_suppkey")


@query("SELECT p_partkey, ROUND(1.0 * (regr_slope(p_retailprice, p_size) OVER () * p_size + regr_intercept(p_retailprice, p_size) OVER ()), 2) AS t FROM part", tables="part")
def predict_model(engine):
    engine.sql("CREATE MODEL price WITH (model_class = 'LinearRegression', target_column = 'p_retailprice') AS (SELECT p_size, p_retailprice FROM part)")
    return engine.sql("SELECT p_partkey, ROUND(target, 2) AS t FROM PREDICT(MODEL price, SELECT p_partkey, p_size FROM part)")


@query("SELECT CAST(3 AS BIGINT) AS clusters, (SELECT COUNT(*) FROM customer) AS n, TRUE AS apart", tables="customer")
def cluster_model(engine):
    """Clusters on a line don't overlap and hold every row."""
    engine.sql("CREATE MODEL groups WITH (model_class = 'KMeans', n_clusters = 3, random_state = 1) AS (SELECT c_acctbal FROM customer)")
    engine.sql("CREATE VIEW ends AS (SELECT target, COUNT(*) AS n, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM PREDICT(MODEL groups, SELECT c_acctbal FROM customer) GROUP BY target)")
    return engine.sql("SELECT COUNT(DISTINCT a.target) AS clusters, (SELECT SUM(n) FROM ends) AS n, SUM(CASE WHEN a.target <> b.target AND a.lo <= b.hi AND b.lo <= a.hi THEN 1 ELSE 0 END) = 0 AS apart FROM ends a CROSS JOIN ends b")


@query("SELECT * FROM (VALUES ('{''regParam'': 0.0}', 2), ('{''regParam'': 0.5}', 2)) AS t(params, settings)", tables="part")
def create_experiment(engine):
    engine.sql("CREATE EXPERIMENT tuned WITH (model_class = 'LinearRegression', experiment_class = 'GridSearchCV', tune_parameters = (regParam = ARRAY[0.0, 0.5]), experiment_kwargs = (cv = 2), target_column = 'p_retailprice') AS (SELECT p_size, p_retailprice FROM part)")
    engine.create_table("tried", engine.schema().experiments["tuned"])
    return engine.sql("SELECT params, CAST(COUNT(*) OVER (PARTITION BY mean_test_score <= 1) AS INTEGER) AS settings FROM tried")


@query("SELECT CAST(3 AS BIGINT) AS settings", tables="part")
def randomized_search(engine):
    """``n_iter`` of the eight settings are tried."""
    engine.sql("CREATE EXPERIMENT tuned WITH (model_class = 'LinearRegression', experiment_class = 'RandomizedSearchCV', tune_parameters = (regParam = ARRAY[0.0, 0.1, 0.2, 0.3], max_iter = ARRAY[5, 10]), experiment_kwargs = (cv = 2, n_iter = 3), target_column = 'p_retailprice') AS (SELECT p_size, p_retailprice FROM part)")
    engine.create_table("tried", engine.schema().experiments["tuned"])
    return engine.sql("SELECT COUNT(DISTINCT params) AS settings FROM tried")


class Line:
    """A least-squares line, from sums that batches add to."""

    def __init__(self, column: str = "p_size"):
        self.column, self.sums = column, np.zeros(4)

    def partial_fit(self, rows, values):
        x, y = rows[self.column].to_numpy(float), values.to_numpy(float)
        self.sums += [len(x), x.sum(), y.sum(), 0]
        self.xx = getattr(self, "xx", 0.0) + float((x * x).sum())
        self.xy = getattr(self, "xy", 0.0) + float((x * y).sum())
        return self

    fit = partial_fit

    def predict(self, rows):
        n, x, y, _ = self.sums
        slope = (n * self.xy - x * y) / (n * self.xx - x * x)
        return (y - slope * x) / n + slope * rows[self.column].to_numpy(float)


_LINE = "SELECT p_partkey, ROUND(1.0 * (regr_slope(p_retailprice, p_size) OVER () * p_size + regr_intercept(p_retailprice, p_size) OVER ()), 2) AS t FROM part"


@query(_LINE, tables="part")
def model_of_another_library(engine):
    """Any class with ``fit`` and ``predict``, fitted batch by batch (``wrap_fit``)."""
    engine.sql("CREATE MODEL own WITH (model_class = 'quarry.operators.statements.Line', wrap_fit = True, wrap_predict = True, target_column = 'p_retailprice') AS (SELECT p_size, p_retailprice FROM part)")
    return engine.sql("SELECT p_partkey, ROUND(target, 2) AS t FROM PREDICT(MODEL own, SELECT p_partkey, p_size FROM part)")


@query(_LINE, tables="part")
def register_model(engine):
    rows = engine.sql("SELECT p_size, p_retailprice FROM part")
    from quarry.ml.wrappers import Incremental

    engine.register_model("given", Incremental(Line()).fit(rows, "p_retailprice", batch_size=500), ["p_size"])
    return engine.sql("SELECT p_partkey, ROUND(target, 2) AS t FROM PREDICT(MODEL given, SELECT p_partkey, p_size FROM part)")


@query(_LINE, tables="part")
def post_fit_wrapper(engine):
    from quarry.ml.wrappers import ParallelPostFit

    rows = engine.sql("SELECT p_size, p_retailprice FROM part")
    engine.create_table("made", ParallelPostFit(Line()).fit(rows, "p_retailprice").predict(engine.table("part")))
    return engine.sql("SELECT p_partkey, ROUND(predict, 2) AS t FROM made")


@query("SELECT ROUND(regr_r2(p_retailprice, p_size), 6) AS r2, ROUND(AVG(power(p_retailprice - m, 2)), 2) AS mse, ROUND(AVG(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 6) AS acc FROM part, (SELECT AVG(p_retailprice) AS m FROM part)", tables="part")
def metrics(engine):
    from quarry.ml import metrics as M

    engine.sql("CREATE MODEL own WITH (model_class = 'quarry.operators.statements.Line', target_column = 'p_retailprice') AS (SELECT p_size, p_retailprice FROM part)")
    found = engine.sql("SELECT p_retailprice, target, (SELECT AVG(p_retailprice) FROM part) AS m, 1 AS one, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large FROM PREDICT(MODEL own, SELECT * FROM part)")
    row = (round(M.r2(found, "p_retailprice", "target"), 6), round(M.mean_squared_error(found, "p_retailprice", "m"), 2), round(M.accuracy(found, "one", "large"), 6))
    return engine.spark.createDataFrame([row], "r2 double, mse double, acc double")


@query("SELECT TRUE AS gone, TRUE AS same, 'LinearRegressionModel' AS kind, '[''p_size'']' AS columns", tables="part")
def model_statements(engine):
    """DESCRIBE, EXPORT and DROP MODEL; what is exported predicts the same."""
    from pyspark.ml import PipelineModel

    from quarry.session import scratch

    engine.sql("CREATE MODEL IF NOT EXISTS m WITH (model_class = 'LinearRegression', target_column = 'p_retailprice') AS (SELECT p_size, p_retailprice FROM part)")
    told = {r.Params: r.Value for r in engine.sql("DESCRIBE MODEL m").collect()}
    place = scratch(engine.spark)
    engine.sql(f"EXPORT MODEL m WITH (format = 'spark', location = '{place}')")
    engine.register_model("again", PipelineModel.load(place), ["p_size"])
    both = engine.sql("SELECT ABS(MAX(a.target - b.target)) < 0.000001 AS same FROM PREDICT(MODEL m, SELECT p_partkey, p_size FROM part) a JOIN PREDICT(MODEL again, SELECT p_partkey, p_size FROM part) b ON a.p_partkey = b.p_partkey").first().same
    engine.sql("DROP MODEL m")
    engine.sql("DROP MODEL IF EXISTS m")
    gone = engine.sql("SHOW MODELS").where("Models = 'm'").isEmpty()
    return engine.spark.createDataFrame([(gone, both, told["model_class"], told["training_columns"])], "gone boolean, same boolean, kind string, columns string")


@query("SELECT n_nationkey, n_name FROM nation", tables="nation")
def create_table_with(engine):
    place = engine.table("nation").inputFiles()[0]
    engine.sql(f"CREATE OR REPLACE TABLE places WITH (location = '{place}', format = 'parquet', persist = False)")
    return engine.sql("SELECT n_nationkey, n_name FROM places")


@query("SELECT form, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS t(form)", tables="nation")
def file_formats(engine):
    """Written and read back, by format name or by extension."""
    from quarry.session import scratch

    place = scratch(engine.spark)
    for form in ("csv", "json", "orc", "parquet"):
        writer = engine.table("nation").select("n_nationkey", "n_name").write
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{place}/t.{form}")
        engine.create_table(f"from_{form}", f"{place}/t.{form}", format=form if form in ("csv", "orc") else None)
    return engine.sql(" UNION ALL ".join(f"SELECT '{form}' AS form, CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM from_{form}" for form in ("csv", "json", "orc", "parquet")))


@query("SELECT r_regionkey, r_name, TRUE AS published FROM region UNION ALL SELECT r_regionkey, r_name, FALSE FROM region", tables="region")
def published_and_metastore_tables(engine):
    """A view that others published (format memory) and a table of the session's catalog (format hive)."""
    import uuid

    from quarry.session import scratch

    name = f"quarry_{uuid.uuid4().hex}"
    engine.table("region").createOrReplaceTempView(f"{name}_view")
    engine.table("region").write.option("path", scratch(engine.spark)).saveAsTable(name)
    engine.create_table("published", f"{name}_view", format="memory")
    engine.create_table("kept", name, format="hive", hive_schema_name="default")
    out = engine.sql("SELECT r_regionkey, r_name, TRUE AS published FROM published UNION ALL SELECT r_regionkey, r_name, FALSE FROM kept").persist()
    out.count()  # five rows twice, read before the table goes
    engine.spark.sql(f"DROP TABLE {name}")
    return out


@query("SELECT * FROM (VALUES ('region')) AS t(\"Table\")", tables="region")
def drop_table(engine):
    for sql in ("CREATE TABLE a AS (SELECT * FROM region)", "CREATE VIEW b AS (SELECT * FROM a)", "DROP TABLE a", "DROP VIEW b", "DROP TABLE IF EXISTS a"):
        engine.sql(sql)
    return engine.sql("SHOW TABLES")


@query("SELECT r_name, CAST(1 AS INTEGER) AS one FROM region WHERE r_regionkey > 1", tables="region")
def use_schema(engine):
    for sql in ("CREATE SCHEMA other", "USE SCHEMA other", "CREATE TABLE some AS (SELECT * FROM root.region WHERE r_regionkey > 1)"):
        engine.sql(sql)
    return engine.sql("SELECT r_name, 1 AS one FROM some")


@query("SELECT * FROM (VALUES ('r_regionkey', 'integer', '', ''), ('r_name', 'varchar', '', '')) AS t(\"Column\", \"Type\", \"Extra\", \"Comment\")", tables="region")
def describe_table(engine):
    return engine.sql("DESCRIBE region")


@query("SELECT TRUE AS scans, TRUE AS pushed, TRUE AS logical", tables="customer")
def explain_statement(engine):
    text = engine.sql("EXPLAIN SELECT c_name FROM customer WHERE c_acctbal > 0")
    more = engine.explain("SELECT c_name FROM customer WHERE c_acctbal > 0", mode="extended")
    return engine.spark.createDataFrame([("Scan parquet" in text, "GreaterThan(c_acctbal" in text, "Optimized Logical Plan" in more)], "scans boolean, pushed boolean, logical boolean")


@query("SELECT s_suppkey, s_suppkey * 2 AS whole, CAST(s_acctbal * 2 AS DOUBLE) AS part FROM supplier", tables="supplier")
def udf_overloads(engine):
    """One name for several types, told by the types of the columns."""
    twice = lambda x: x * 2
    engine.register_function(twice, "twice", [("x", np.int64)], np.int64)
    engine.register_function(twice, "twice", [("x", np.float64)], np.float64)
    return engine.sql("SELECT s_suppkey, twice(s_suppkey) AS whole, twice(s_acctbal) AS part FROM supplier")


@query("SELECT n_nationkey, n_nationkey + 100 AS a, n_nationkey + 1 AS b FROM nation", tables="nation")
def schema_functions(engine):
    engine.sql("CREATE SCHEMA tools")
    engine.register_function(lambda x: x + 100, "add", [("x", np.int32)], np.int32, schema_name="tools")
    engine.register_function(lambda x: x + 1, "add", [("x", np.int32)], np.int32)
    return engine.sql("SELECT n_nationkey, tools.add(n_nationkey) AS a, add(n_nationkey) AS b FROM nation")


@query("SELECT r_regionkey, r_name FROM region", tables="region")
def server_statement(engine):
    """A statement over HTTP, page by page."""
    import json
    import time
    import urllib.request

    server = engine.run_server(host="127.0.0.1", port=0)
    try:
        asked = urllib.request.Request(f"http://127.0.0.1:{server.port}/v1/statement", data=b"SELECT r_regionkey, r_name FROM region", method="POST")
        rows = []
        while asked is not None:
            with urllib.request.urlopen(asked, timeout=60) as answer:
                got = json.loads(answer.read())
            rows += got.get("data") or []
            asked = got.get("nextUri")
            time.sleep(0.05)
    finally:
        engine.stop_server()
    return engine.spark.createDataFrame([tuple(r) for r in rows], "r_regionkey int, r_name string")


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", tables="customer nation")
def config_options(engine):
    """Options of one statement: this join never broadcasts."""
    return engine.sql("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", config_options={"sql.join.broadcast": False, "sql.aggregate.split_out": 4})


@query("SELECT k, COUNT(*) AS n FROM (SELECT r_regionkey AS k FROM region UNION ALL SELECT 7) AS t GROUP BY k", tables="region")
def dataframes_argument(engine):
    import pandas as pd

    return engine.sql("SELECT k, COUNT(*) AS n FROM (SELECT r_regionkey AS k FROM region UNION ALL SELECT k FROM more) AS t GROUP BY k", dataframes={"more": pd.DataFrame({"k": np.array([7], np.int32)})})


@query("SELECT * FROM (VALUES ('m')) AS t(\"Models\")", tables="part")
def show_models(engine):
    engine.sql("CREATE MODEL m WITH (model_class = 'LinearRegression', target_column = 'p_retailprice') AS (SELECT p_size, p_retailprice FROM part)")
    return engine.sql("SHOW MODELS")

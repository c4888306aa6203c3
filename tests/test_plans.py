"""Plans that must hold at any size: what reaches the readers, and how rows meet."""

import pytest
from harness import SF

from quarry.operators.registry import engine_for
from quarry.plans.explain import plan_text, pushed_filters, shuffles


def plan(spark, sql, **config):
    return plan_text(engine_for(spark, SF, sql).sql(sql, config_options=config), "formatted")


def test_filters_and_columns_reach_the_reader(spark):
    engine = engine_for(spark, SF, "lineitem")
    frame = engine.sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 AND l_returnflag IN ('A', 'R')")
    text = plan_text(frame)
    assert any("GreaterThan(l_quantity,10.0)" in f and "In(l_returnflag" in f for f in pushed_filters(frame))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text
    assert shuffles(frame) == 0


@pytest.mark.parametrize(
    ("sql", "has", "lacks"),
    [
        ("SELECT * FROM lineitem ORDER BY l_extendedprice DESC LIMIT 5", "TakeOrderedAndProject", "Exchange rangepartitioning"),
        ("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "LeftSemi", "Cartesian"),
        ("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)", "LeftAnti", "Cartesian"),
        ("SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey", "HashJoin", "NestedLoop"),
        ("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", "partial_sum", "SortAggregate"),
        ("SELECT MOD(l_orderkey, 7) AS m, ROUND(l_tax, 1) AS r, SUBSTRING(l_returnflag FROM 1 FOR 1) AS s FROM lineitem WHERE l_returnflag SIMILAR TO 'A|R'", "Project", "Python"),
        ("SELECT n_name FROM nation WHERE 1 = 0", "LocalTableScan", "Scan parquet"),
    ],
)
def test_shapes(spark, sql, has, lacks):
    text = plan(spark, sql)
    assert has in text and lacks not in text


def test_options_reach_the_plan(spark):
    sql = "SELECT c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
    engine = engine_for(spark, SF, sql)
    never = engine.sql(sql, config_options={"sql.join.broadcast": False})
    assert "SortMergeJoin" in plan_text(never) and "BroadcastHashJoin" in plan_text(engine.sql(sql))
    assert never.count() == engine.sql(sql).count()
    deal = "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey"
    assert "hashpartitioning(c_nationkey#" in plan_text(engine.sql(deal)) and ", 3)" in plan_text(engine.sql(deal, config_options={"sql.aggregate.split_out": 3}), "simple").replace(", ENSURE_REQUIREMENTS", ")")
    scan = "SELECT c_custkey FROM customer WHERE c_acctbal > 0"
    assert pushed_filters(engine.sql(scan))
    engine.config["sql.join.broadcast"] = False  # of the engine; the session is left alone
    assert "SortMergeJoin" in plan_text(engine.sql(sql)) and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    engine.sql("CREATE TABLE kept AS (SELECT * FROM customer)", config_options={"sql.aggregate.split_out": 3})
    assert engine.sql("SELECT COUNT(*) AS n FROM kept").first().n == engine.sql("SELECT COUNT(*) AS n FROM customer").first().n


def test_options_of_file_and_environment(spark, tmp_path, monkeypatch):
    from quarry.plans.settings import defaults, settings

    path = tmp_path / "options.json"
    path.write_text('{"quarry": {"sql": {"join": {"broadcast": false}, "aggregate": {"split_out": 5}}}}')
    monkeypatch.setenv("QUARRY_CONFIG", str(path))
    monkeypatch.setenv("QUARRY__SQL__AGGREGATE__SPLIT_OUT", "7")
    assert defaults() == {"sql.join.broadcast": False, "sql.aggregate.split_out": 7}
    assert settings(defaults()) == {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "7"}
    sql = "SELECT c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
    assert "SortMergeJoin" in plan_text(engine_for(spark, SF, sql).sql(sql))
    with pytest.warns(UserWarning, match="no meaning"):
        settings({"sql.optimize": True})

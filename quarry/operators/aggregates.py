"""Aggregations (A)."""

from quarry.operators.registry import add

add("agg_basic", "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_custkey) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_orderdate) AS lo, MAX(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_orderdate) AS lo, MAX(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus")
add("agg_global", "SELECT COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 1)) AS m, ROUND(SUM(l_tax), 4) AS t, MIN(l_shipdate) AS d FROM lineitem")
add("agg_empty_input", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, $SUM0(l_quantity) AS z FROM lineitem WHERE l_quantity < 0", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, CAST(0 AS DOUBLE) AS z FROM lineitem WHERE l_quantity < 0")
add("agg_distinct_multi", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_partkey) AS p, SUM(DISTINCT l_linenumber) AS d, AVG(DISTINCT l_quantity) AS q FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_partkey) AS p, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS d, AVG(DISTINCT l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
add("agg_filter_clause", "SELECT c_nationkey, COUNT(*) FILTER (WHERE c_acctbal > 0) AS pos, COUNT(*) FILTER (WHERE c_acctbal > 1000000) AS none, ROUND(AVG(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 4) AS b FROM customer GROUP BY c_nationkey")
add("agg_stats", "SELECT l_linenumber, ROUND(STDDEV(l_quantity), 6) AS sd, ROUND(STDDEV_SAMP(l_tax), 8) AS ss, ROUND(STDDEV_POP(l_quantity), 6) AS sp, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(VAR_SAMP(l_quantity), 6) AS vs, ROUND(VARIANCE(l_discount), 8) AS v FROM lineitem GROUP BY l_linenumber")
add("agg_bitwise_every", "SELECT n_regionkey, BIT_AND(n_nationkey) AS a, BIT_OR(n_nationkey) AS o, BIT_XOR(n_nationkey) AS x, EVERY(n_nationkey > 2) AS e FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, BIT_AND(n_nationkey) AS a, BIT_OR(n_nationkey) AS o, BIT_XOR(n_nationkey) AS x, BOOL_AND(n_nationkey > 2) AS e FROM nation GROUP BY n_regionkey")
add("agg_regr_covar", """
    SELECT l_returnflag, REGR_COUNT(l_extendedprice, l_quantity) AS c, ROUND(REGR_SXX(l_extendedprice, l_quantity), 2) AS sxx, ROUND(REGR_SYY(l_discount, l_quantity), 4) AS syy,
           ROUND(COVAR_POP(l_quantity, l_discount), 8) AS cp, ROUND(COVAR_SAMP(l_quantity, l_discount), 8) AS cs, ROUND(CORR(l_quantity, l_extendedprice), 8) AS r
    FROM lineitem GROUP BY l_returnflag""", """
    SELECT l_returnflag, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS c, ROUND(REGR_SXX(l_extendedprice, l_quantity), 2) AS sxx, ROUND(REGR_SYY(l_discount, l_quantity), 4) AS syy,
           ROUND(COVAR_POP(l_quantity, l_discount), 8) AS cp, ROUND(COVAR_SAMP(l_quantity, l_discount), 8) AS cs, ROUND(CORR(l_quantity, l_extendedprice), 8) AS r
    FROM lineitem GROUP BY l_returnflag""")
add("agg_single_any_value", "SELECT n_regionkey, SINGLE_VALUE(n_regionkey * 2) AS s, ANY_VALUE(n_regionkey + 1) AS a, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, n_regionkey * 2 AS s, n_regionkey + 1 AS a, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
add("agg_mean", "SELECT p_brand, ROUND(MEAN(p_retailprice), 4) AS m FROM part GROUP BY p_brand")
add("agg_null_group", "SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n, SUM(NULLIF(n_nationkey, 3)) AS s FROM nation GROUP BY NULLIF(n_regionkey, 2)", "SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n, CAST(SUM(NULLIF(n_nationkey, 3)) AS BIGINT) AS s FROM nation GROUP BY 1")
add("agg_by_expression", "SELECT c_nationkey + 1 AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey + 1")
add("having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 100000")
add("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
add("cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("grouping_sets", "SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
add("agg_median_percentile", "SELECT l_returnflag, MEDIAN(l_quantity) AS m, MAX_BY(l_orderkey, l_extendedprice) AS x FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, MEDIAN(l_quantity) AS m, ARG_MAX(l_orderkey, l_extendedprice) AS x FROM lineitem GROUP BY l_returnflag")
add("agg_approx_distinct", "SELECT l_returnflag, ABS(APPROX_COUNT_DISTINCT(l_partkey) - COUNT(DISTINCT l_partkey)) < 0.15 * COUNT(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, TRUE AS near FROM lineitem")
add("agg_lists", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS l, ARRAY_JOIN(SORT_ARRAY(ARRAY_AGG(n_name)), '|') AS a, PERCENTILE(n_nationkey, 0.25) AS p, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY n_nationkey) AS h FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name DESC) AS l, STRING_AGG(n_name, '|' ORDER BY n_name) AS a, QUANTILE_CONT(CAST(n_nationkey AS DOUBLE), 0.25) AS p, QUANTILE_CONT(CAST(n_nationkey AS DOUBLE), 0.5) AS h FROM nation GROUP BY n_regionkey")
add("agg_regr_nulls", "SELECT l_returnflag, REGR_COUNT(NULLIF(l_tax, 0), NULLIF(l_discount, 0)) AS c, ROUND(REGR_SXX(NULLIF(l_tax, 0), NULLIF(l_discount, 0)), 6) AS x, ROUND(REGR_SYY(NULLIF(l_tax, 0), NULLIF(l_discount, 0)), 6) AS y FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, CAST(REGR_COUNT(NULLIF(l_tax, 0), NULLIF(l_discount, 0)) AS BIGINT) AS c, ROUND(REGR_SXX(NULLIF(l_tax, 0), NULLIF(l_discount, 0)), 6) AS x, ROUND(REGR_SYY(NULLIF(l_tax, 0), NULLIF(l_discount, 0)), 6) AS y FROM lineitem GROUP BY l_returnflag")
add("grouping_marks", "SELECT o_orderstatus, GROUPING(o_orderstatus) AS g, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)", "SELECT o_orderstatus, CAST(GROUPING(o_orderstatus) AS TINYINT) AS g, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
add("agg_decimal", "SELECT l_linenumber, SUM(CAST(l_extendedprice AS DECIMAL(12, 2))) AS s FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DECIMAL(22, 2)) AS s FROM lineitem GROUP BY l_linenumber")

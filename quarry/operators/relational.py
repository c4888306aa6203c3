"""Scans, projections, filters, set operations, subqueries (R, P, O)."""

from quarry.operators.registry import add

add("flagship", """
    SELECT l.l_returnflag, l.l_linestatus, ROUND(SUM(l.l_quantity), 2) AS sum_qty, ROUND(AVG(l.l_discount), 6) AS avg_disc, COUNT(*) AS n,
           ROUND(SUM(l.l_extendedprice) FILTER (WHERE l.l_discount > 0.05), 2) AS disc_price
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
    GROUP BY l.l_returnflag, l.l_linestatus HAVING COUNT(*) > 10
    ORDER BY l.l_returnflag, l.l_linestatus""")
add("scan_project", "SELECT c_custkey, c_name, c_acctbal * 2 AS twice, c_nationkey + 1 AS next_nation FROM customer")
add("scan_filter_pushdown", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_returnflag IN ('A', 'R') AND l_discount IS NOT NULL")
add("filter_predicates", "SELECT c_custkey FROM customer WHERE (c_acctbal > 0 AND NOT c_mktsegment = 'BUILDING') OR c_acctbal < -500 OR c_nationkey <> 3 AND c_custkey <= 20")
add("filter_constant", "SELECT r_regionkey FROM region WHERE 1 = 1 AND NOT (1 = 0)")
add("in_between_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_size NOT BETWEEN 8 AND 9 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23') AND p_type NOT LIKE '%BRASS'")
add("like_ilike_escape", "SELECT p_partkey, p_type LIKE '%a_%' AS l, p_type ILIKE 'STANDARD%' AS i, p_name LIKE '%!_%' ESCAPE '!' AS e, p_name NOT LIKE '%e%' AS n FROM part")
add("similar_to", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)[1-3]' OR p_type SIMILAR TO '%(TIN|tin)%'",
    "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#(1|2)[1-3]$') OR regexp_matches(p_type, '^.*(TIN|tin).*$')")
add("is_predicates", """
    SELECT n_nationkey, (n_regionkey = 1) IS TRUE AS t, (n_regionkey = 1) IS NOT FALSE AS nf, (NULLIF(n_regionkey, 2) = 1) IS UNKNOWN AS u,
           NULLIF(n_regionkey, 2) IS DISTINCT FROM 1 AS d, NULLIF(n_regionkey, 2) IS NOT DISTINCT FROM NULL AS s, NULLIF(n_regionkey, 2) IS NULL AS n
    FROM nation""", """
    SELECT n_nationkey, coalesce(n_regionkey = 1, false) AS t, coalesce(n_regionkey = 1, true) AS nf, NULLIF(n_regionkey, 2) IS NULL AS u,
           NULLIF(n_regionkey, 2) IS DISTINCT FROM 1 AS d, NULLIF(n_regionkey, 2) IS NOT DISTINCT FROM NULL AS s, NULLIF(n_regionkey, 2) IS NULL AS n
    FROM nation""")
add("three_valued_logic", """
    SELECT n_nationkey, (NULLIF(n_regionkey, 1) > 2 AND n_regionkey < 4) AS a, (NULLIF(n_regionkey, 1) > 2 OR n_regionkey = 1) AS o, NOT (NULLIF(n_regionkey, 1) > 2) AS n,
           NULLIF(n_regionkey, 1) NOT IN (2, 3) AS i FROM nation""")
add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
add("cast_matrix", """
    SELECT s_suppkey, CAST(s_acctbal AS BIGINT) AS b, CAST(s_suppkey AS VARCHAR) AS v, CAST(s_nationkey AS DOUBLE) AS d, CAST('2020-02-03' AS DATE) AS dt, CAST(s_acctbal AS DECIMAL(12, 1)) AS m,
           CAST('12' AS INTEGER) AS i, TRY_CAST('x' AS INTEGER) AS t, CAST(TIMESTAMP '2020-02-03 11:12:13' AS DATE) AS f FROM supplier""", """
    SELECT s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) AS b, CAST(s_suppkey AS VARCHAR) AS v, CAST(s_nationkey AS DOUBLE) AS d, CAST('2020-02-03' AS DATE) AS dt, CAST(s_acctbal AS DECIMAL(12, 1)) AS m,
           CAST('12' AS INTEGER) AS i, TRY_CAST('x' AS INTEGER) AS t, CAST(TIMESTAMP '2020-02-03 11:12:13' AS DATE) AS f FROM supplier""")
add("coalesce_nulls", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 5), -1) AS k, COALESCE(NULL, NULLIF(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer")
add("literals", "SELECT r_regionkey, 1 AS i, 1.5 AS d, 'it''s' AS s, TRUE AS b, NULL IS NULL AS n, DATE '2021-03-04' AS dt, TIMESTAMP '2021-03-04 05:06:07' AS ts, DATE '2021-03-04' + INTERVAL '5' DAY AS p FROM region",
    "SELECT r_regionkey, 1 AS i, 1.5 AS d, 'it''s' AS s, TRUE AS b, NULL IS NULL AS n, DATE '2021-03-04' AS dt, TIMESTAMP '2021-03-04 05:06:07' AS ts, CAST(DATE '2021-03-04' + INTERVAL '5' DAY AS DATE) AS p FROM region")
add("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
add("select_without_from", "SELECT 1 + 1 AS two, 'x' || 'y' AS xy, 7 / 2 AS whole, 7.0 / 2 AS part", "SELECT 1 + 1 AS two, 'x' || 'y' AS xy, CAST(7 // 2 AS BIGINT) AS whole, CAST(3.5 AS DECIMAL(7, 6)) AS part")
add("quoted_identifiers", 'SELECT "n_name" AS "The Name", n."n_regionkey" AS "2nd" FROM nation AS n WHERE "n_nationkey" > 3')
add("whole_division", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, (l_linenumber + 1) / 2.0 AS h FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, CAST((l_linenumber + 1) / 2.0 AS DECIMAL(17, 6)) AS h FROM lineitem")
add("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
add("correlated_scalar_subquery", "SELECT p.p_partkey, p.p_retailprice FROM part p WHERE p.p_retailprice >= (SELECT MAX(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
add("subquery_in_from", "SELECT t.k, COUNT(*) AS n FROM (SELECT o_custkey % 10 AS k FROM orders WHERE o_totalprice > 1000) AS t GROUP BY t.k")
add("cte_nested", "WITH a AS (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey), b AS (SELECT k, n FROM a WHERE n > 1) SELECT r.r_name, b.n FROM b JOIN region r ON r.r_regionkey = b.k")
add("union_all", "SELECT n_nationkey AS k, n_name AS s FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
add("intersect_except_all", "(SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT c_nationkey FROM customer) UNION ALL (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region)")
add("distribute_by", "SELECT o_custkey, COUNT(*) AS n FROM (SELECT * FROM orders DISTRIBUTE BY o_custkey) AS t GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
add("unmapped_operators", "SELECT n_nationkey, n_nationkey % 4 AS m, n_nationkey & 5 AS a, n_nationkey | 8 AS o FROM nation")
# What is kept depends on the generator: its share is held.
add("tablesample_bernoulli", """
    SELECT COUNT(*) > 0.17 * (SELECT COUNT(*) FROM lineitem) AND COUNT(*) < 0.23 * (SELECT COUNT(*) FROM lineitem) AS share, COUNT(l_orderkey) = COUNT(*) AS whole
    FROM lineitem TABLESAMPLE BERNOULLI (20) REPEATABLE (7)""", "SELECT TRUE AS share, TRUE AS whole")
# Files and parts of files are kept or not, as a whole.
add("tablesample_system", """
    SELECT (SELECT COUNT(*) FROM lineitem TABLESAMPLE SYSTEM (50) REPEATABLE (3)) = (SELECT COUNT(*) FROM lineitem TABLESAMPLE SYSTEM (50) REPEATABLE (3)) AS again,
           (SELECT COUNT(*) FROM lineitem TABLESAMPLE SYSTEM (100) REPEATABLE (3)) AS every, (SELECT COUNT(*) FROM lineitem TABLESAMPLE SYSTEM (0) REPEATABLE (3)) AS none""",
    "SELECT TRUE AS again, (SELECT COUNT(*) FROM lineitem) AS every, CAST(0 AS BIGINT) AS none")
add("division_levels", """
    WITH c AS (SELECT l_orderkey / 7 AS q, l_linenumber / 2.0 AS h FROM lineitem)
    SELECT q, COUNT(*) AS n, SUM(l_linenumber) / COUNT(*) AS m, MAX(l_linenumber / 2) + 1 AS x FROM (SELECT c.q, l.l_linenumber FROM c JOIN (SELECT DISTINCT l_orderkey / 7 AS q, l_linenumber FROM lineitem) l ON c.q = l.q) t GROUP BY q
    UNION ALL SELECT 7 / 2, COUNT(*), 9 / 4 * 2, (1 + 2) / 2 FROM region""", """
    WITH c AS (SELECT l_orderkey // 7 AS q FROM lineitem)
    SELECT q, COUNT(*) AS n, CAST(SUM(l_linenumber) // COUNT(*) AS BIGINT) AS m, CAST(trunc(MAX(l_linenumber / 2.0) + 1) AS BIGINT) AS x FROM (SELECT c.q, l.l_linenumber FROM c JOIN (SELECT DISTINCT l_orderkey // 7 AS q, l_linenumber FROM lineitem) l ON c.q = l.q) t GROUP BY q
    UNION ALL SELECT CAST(3 AS BIGINT), COUNT(*), CAST(4 AS BIGINT), CAST(1 AS BIGINT) FROM region""")
add("division_by_zero", "SELECT n_nationkey, n_nationkey / n_regionkey AS q, ROUND(n_nationkey * 1.5 / (n_regionkey - 1), 6) AS f, n_nationkey % n_regionkey AS r, MOD(n_nationkey, n_regionkey) AS m FROM nation WHERE n_nationkey / 5 > 0.3",
    "SELECT n_nationkey, CAST(n_nationkey // nullif(n_regionkey, 0) AS BIGINT) AS q, round(CAST(n_nationkey * 1.5 AS DOUBLE) / nullif(n_regionkey - 1, 0), 6) AS f, n_nationkey % nullif(n_regionkey, 0) AS r, CAST(n_nationkey % nullif(n_regionkey, 0) AS BIGINT) AS m FROM nation WHERE n_nationkey / 5.0 > 0.3")
add("qualify", "SELECT user_id, event_id, value FROM events WHERE value > 5 QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2")
add("qualify_distinct", "SELECT DISTINCT c_nationkey, RANK() OVER w AS r FROM customer QUALIFY RANK() OVER w < 4 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)",
    "SELECT DISTINCT c_nationkey, CAST(RANK() OVER w AS INTEGER) AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) QUALIFY RANK() OVER w < 4")
add("regex_operators", "SELECT p_partkey, p_type ~ 'TIN$' AS a, p_type !~ '^S' AS b, p_type ~* 'tin' AS c, p_type !~* '^standard' AS d, p_size # 5 AS x FROM part",
    "SELECT p_partkey, regexp_matches(p_type, 'TIN$') AS a, NOT regexp_matches(p_type, '^S') AS b, regexp_matches(p_type, 'tin', 'i') AS c, NOT regexp_matches(p_type, '^standard', 'i') AS d, xor(p_size, 5) AS x FROM part")
add("similar_to_column", "SELECT p.p_partkey, t.pat FROM part p JOIN (VALUES ('%TIN'), ('(STANDARD|SMALL)%'), ('_ROMO%'), ('a.c')) AS t(pat) ON p.p_type SIMILAR TO t.pat",
    "SELECT p.p_partkey, t.pat FROM part p JOIN (VALUES ('%TIN'), ('(STANDARD|SMALL)%'), ('_ROMO%'), ('a.c')) AS t(pat) ON regexp_full_match(p.p_type, replace(replace(replace(t.pat, '.', '[.]'), '%', '.*'), '_', '.'))")
add("not_in_with_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, NULL) OR n_nationkey IN (3, NULL)")
add("exists_as_column", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer")
add("is_predicates_more", "SELECT n_nationkey, (n_regionkey > 2) IS FALSE AS f, (NULLIF(n_regionkey, 2) > 2) IS NOT TRUE AS nt, (NULLIF(n_regionkey, 2) > 2) IS NOT UNKNOWN AS nu, n_name IS NOT NULL AS nn FROM nation",
    "SELECT n_nationkey, n_regionkey <= 2 AS f, coalesce(NOT (NULLIF(n_regionkey, 2) > 2), true) AS nt, NULLIF(n_regionkey, 2) IS NOT NULL AS nu, n_name IS NOT NULL AS nn FROM nation")
add("cast_more", "SELECT s_suppkey, CAST(-2.7 AS INTEGER) AS n, CAST(s_acctbal * -1 AS BIGINT) AS b, CAST(s_suppkey AS VARCHAR) || 'x' AS v, TRY_CAST('2020-13-01' AS DATE) AS d, CAST('true' AS BOOLEAN) AS t, CAST(s_nationkey AS FLOAT) AS f FROM supplier",
    "SELECT s_suppkey, -2 AS n, CAST(trunc(s_acctbal * -1) AS BIGINT) AS b, CAST(s_suppkey AS VARCHAR) || 'x' AS v, CAST(NULL AS DATE) AS d, TRUE AS t, CAST(s_nationkey AS FLOAT) AS f FROM supplier")

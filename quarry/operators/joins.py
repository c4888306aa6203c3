"""Joins (J)."""

from quarry.operators.registry import add

add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0")
add("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
add("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")
add("join_full", "SELECT s.s_suppkey, n.n_nationkey FROM (SELECT * FROM supplier WHERE s_nationkey < 20) s FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 5) n ON s.s_nationkey = n.n_nationkey")
add("join_semi", "SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("join_anti", "SELECT c.c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
add("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'")
add("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
add("join_theta_outer", "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey > 20 AND r.r_regionkey > n.n_regionkey")
add("join_residual", "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45 AND l.l_extendedprice < o.o_totalprice")
add("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
add("join_using", "SELECT l_orderkey AS k, SUM(l_quantity) AS q FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey) GROUP BY l_orderkey",
    "SELECT l_orderkey AS k, SUM(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey")
add("join_key_forms", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = CAST(r.r_regionkey + 1 AS INTEGER)")
add("join_null_keys", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) b ON a.k = b.k")
add("join_duplicate_names", "SELECT lhs.k AS lk, rhs.k AS rk FROM (SELECT r_regionkey AS k FROM region) lhs JOIN (SELECT n_regionkey AS k FROM nation) rhs ON lhs.k = rhs.k")
add("join_multiway", """
    SELECT r.r_name, n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
    FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY r.r_name, n.n_name""")
add("exists_correlated", "SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
add("not_exists_correlated", "SELECT s.s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09)")
add("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
add("not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)")
add("join_broadcast_hint", "SELECT /*+ BROADCAST(n) */ c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
add("join_right_semi", "SELECT c.c_custkey, c.c_name FROM orders o RIGHT SEMI JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 150000)")
add("join_right_anti", "SELECT p.p_partkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey RIGHT ANTI JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size < 40", "SELECT p_partkey FROM part WHERE p_size < 40 AND NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE p_partkey = l_partkey)")

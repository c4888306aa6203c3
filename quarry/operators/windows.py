"""Window functions (W)."""

from quarry.operators.registry import add

add("win_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders")
add("win_rank_family", """
    SELECT l_orderkey, l_linenumber, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, ROUND(PERCENT_RANK() OVER w, 8) AS p, ROUND(CUME_DIST() OVER w, 8) AS c, NTILE(3) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS t
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)""", """
    SELECT l_orderkey, l_linenumber, CAST(RANK() OVER w AS INTEGER) AS r, CAST(DENSE_RANK() OVER w AS INTEGER) AS d, ROUND(PERCENT_RANK() OVER w, 8) AS p, ROUND(CUME_DIST() OVER w, 8) AS c,
           CAST(NTILE(3) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS INTEGER) AS t
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)""")
add("win_lead_lag", "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events")
add("win_frames_rows", """
    SELECT n_nationkey, SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a, SUM(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS b,
           COUNT(*) OVER (ORDER BY n_nationkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c, MAX(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d,
           MIN(n_nationkey) OVER (ORDER BY n_nationkey DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM nation""", """
    SELECT n_nationkey, CAST(SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS a, CAST(SUM(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS b,
           COUNT(*) OVER (ORDER BY n_nationkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c, MAX(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d,
           MIN(n_nationkey) OVER (ORDER BY n_nationkey DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM nation""")
add("win_default_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running, COUNT(*) OVER (PARTITION BY o_custkey) AS whole FROM orders")
add("win_range_frame", "SELECT l_orderkey, l_linenumber, COUNT(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM lineitem")
add("win_first_last", "SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events")
add("win_filter", "SELECT event_id, COUNT(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
    "SELECT event_id, COUNT(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events")
add("win_several", "SELECT c_custkey, RANK() OVER (ORDER BY c_acctbal DESC, c_custkey) AS overall, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS local FROM customer",
    "SELECT c_custkey, CAST(RANK() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS overall, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS local FROM customer")
add("win_null_partition", "SELECT n_nationkey, ROW_NUMBER() OVER (PARTITION BY NULLIF(n_regionkey, 2) ORDER BY n_nationkey) AS rn FROM nation",
    "SELECT n_nationkey, CAST(ROW_NUMBER() OVER (PARTITION BY NULLIF(n_regionkey, 2) ORDER BY n_nationkey) AS INTEGER) AS rn FROM nation")
add("win_over_aggregate", "SELECT o_orderstatus, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")
add("win_single_value", "SELECT n_nationkey, SINGLE_VALUE(n_regionkey) OVER (PARTITION BY n_regionkey) AS s, $SUM0(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS z, ROUND(AVG(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 6) AS a FROM nation",
    "SELECT n_nationkey, n_regionkey AS s, CAST(SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS z, ROUND(AVG(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 6) AS a FROM nation")
add("win_default_frame_ties", "SELECT COUNT(*) AS n, SUM(r) AS s FROM (SELECT COUNT(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r FROM lineitem) AS t",
    "SELECT COUNT(*) AS n, CAST(SUM(r) AS BIGINT) AS s FROM (SELECT COUNT(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM lineitem) AS t")
add("win_groups_frame", """
    SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a,
           ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY event_type DESC GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING), 4) AS b, MIN(e.event_id) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c
    FROM events e WHERE value > 3""")

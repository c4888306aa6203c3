"""Sorting, limits, top-k (O)."""

from quarry.operators.registry import add

add("sort_nulls", """
    SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2), n_nationkey) AS up, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey) AS down,
           ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) NULLS FIRST, n_nationkey) AS f, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS l FROM nation""", """
    SELECT n_nationkey, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) ASC NULLS LAST, n_nationkey) AS INTEGER) AS up, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC NULLS FIRST, n_nationkey) AS INTEGER) AS down,
           CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) NULLS FIRST, n_nationkey) AS INTEGER) AS f, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS INTEGER) AS l FROM nation""")
add("sort_multi", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey")
add("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
add("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
add("limit_zero", "SELECT n_nationkey FROM nation LIMIT 0")
add("sort_by_alias_and_hidden", "SELECT p_partkey, p_size * 2 AS s FROM part ORDER BY s DESC, p_retailprice, p_partkey LIMIT 40")
add("topk_per_group", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) AS t WHERE rn <= 3")

"""Scalar functions (M, T, D)."""

from quarry.operators.registry import add

add("math_functions", """
    SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(SQRT(ABS(c_acctbal)), 6) AS q, ROUND(CBRT(c_acctbal), 6) AS cb, CEIL(c_acctbal) AS ce, FLOOR(c_acctbal) AS fl, TRUNCATE(c_acctbal) AS tr, SIGN(c_acctbal) AS sg,
           MOD(c_custkey, 7) AS m, MOD(-c_custkey, 7) AS mn, ROUND(POWER(c_nationkey, 2), 4) AS p, ROUND(EXP(c_nationkey / 10.0), 6) AS e, ROUND(LN(c_custkey + 1), 8) AS l, ROUND(LOG10(c_custkey + 1), 8) AS lg FROM customer""", """
    SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(SQRT(ABS(c_acctbal)), 6) AS q, ROUND(CBRT(c_acctbal), 6) AS cb, CAST(CEIL(c_acctbal) AS DOUBLE) AS ce, CAST(FLOOR(c_acctbal) AS DOUBLE) AS fl, TRUNC(c_acctbal) AS tr, CAST(SIGN(c_acctbal) AS DOUBLE) AS sg,
           c_custkey % 7 AS m, ((-c_custkey % 7) + 7) % 7 AS mn, ROUND(POWER(c_nationkey, 2), 4) AS p, ROUND(EXP(c_nationkey / 10.0), 6) AS e, ROUND(LN(c_custkey + 1), 8) AS l, ROUND(LOG10(c_custkey + 1), 8) AS lg FROM customer""")
add("trigonometry", "SELECT n_nationkey, ROUND(SIN(n_nationkey), 8) AS s, ROUND(COS(n_nationkey), 8) AS c, ROUND(TAN(n_nationkey), 6) AS t, ROUND(ASIN(n_nationkey / 25.0), 8) AS a_s, ROUND(ACOS(n_nationkey / 25.0), 8) AS a_c, ROUND(ATAN(n_nationkey), 8) AS a_t, ROUND(ATAN2(n_nationkey, 3), 8) AS a_2, ROUND(COT(n_nationkey + 1), 6) AS ct, ROUND(DEGREES(n_nationkey), 6) AS d, ROUND(RADIANS(n_nationkey), 8) AS r FROM nation")
add("round_half_even", "SELECT n_nationkey, ROUND(n_nationkey + 0.5) AS a, ROUND(n_nationkey * 0.25, 1) AS b FROM nation", "SELECT n_nationkey, CAST(ROUND_EVEN(n_nationkey + 0.5, 0) AS DOUBLE) AS a, CAST(ROUND_EVEN(n_nationkey * 0.25, 1) AS DOUBLE) AS b FROM nation")
add("random_functions", "SELECT n_nationkey, RAND(42) >= 0 AND RAND(42) < 1 AS r, RAND_INTEGER(1, 10) BETWEEN 0 AND 9 AS i, RANDOM() < 1 AS u FROM nation", "SELECT n_nationkey, TRUE AS r, TRUE AS i, TRUE AS u FROM nation")
add("string_functions", """
    SELECT p_partkey, p_name || '-' || p_brand AS cc, CONCAT(p_name, '/', p_type) AS ct, CHAR_LENGTH(p_name) AS n, CHARACTER_LENGTH(p_type) AS m, UPPER(p_name) AS u, LOWER(p_type) AS l, REPLACE(p_type, 'A', 'x') AS r,
           SUBSTRING(p_type FROM 3 FOR 4) AS s, SUBSTRING(p_type, 5) AS s2, SUBSTR(p_type, 2, 3) AS s3, POSITION('a' IN p_name) AS p, TRIM(BOTH 'P' FROM p_type) AS t, LTRIM(p_type, 'PS') AS lt, RTRIM(p_type, 'LN') AS rt, BTRIM(p_type, 'PSLN') AS bt FROM part""", """
    SELECT p_partkey, p_name || '-' || p_brand AS cc, CONCAT(p_name, '/', p_type) AS ct, CAST(LENGTH(p_name) AS INTEGER) AS n, CAST(LENGTH(p_type) AS INTEGER) AS m, UPPER(p_name) AS u, LOWER(p_type) AS l, REPLACE(p_type, 'A', 'x') AS r,
           SUBSTRING(p_type, 3, 4) AS s, SUBSTRING(p_type, 5) AS s2, SUBSTR(p_type, 2, 3) AS s3, CAST(POSITION('a' IN p_name) AS INTEGER) AS p, TRIM(p_type, 'P') AS t, LTRIM(p_type, 'PS') AS lt, RTRIM(p_type, 'LN') AS rt, TRIM(p_type, 'PSLN') AS bt FROM part""")
add("string_places", "SELECT n_nationkey, SUBSTRING(n_name, -2, 3) AS s, OVERLAY(n_name PLACING '__' FROM 2 FOR 3) AS o, POSITION('A' IN n_name FROM 2) AS p, INITCAP(n_name) AS i, INITCAP('o''neil mc-x') AS c FROM nation", """
    SELECT n_nationkey, SUBSTRING(n_name, 1, 3) AS s, SUBSTRING(n_name, 1, 1) || '__' || SUBSTRING(n_name, 5) AS o,
           CAST(CASE WHEN POSITION('A' IN SUBSTRING(n_name, 2)) = 0 THEN 0 ELSE POSITION('A' IN SUBSTRING(n_name, 2)) + 1 END AS INTEGER) AS p,
           array_to_string(list_transform(regexp_extract_all(n_name, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS i, 'O''Neil Mc-X' AS c FROM nation""")
add("date_extract", """
    SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(QUARTER FROM o_orderdate) AS q, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(WEEK FROM o_orderdate) AS w, EXTRACT(DAY FROM o_orderdate) AS d, EXTRACT(DOW FROM o_orderdate) AS dow,
           EXTRACT(DOY FROM o_orderdate) AS doy, EXTRACT(HOUR FROM o_orderdate) AS h, EXTRACT(CENTURY FROM o_orderdate) AS c, EXTRACT(DECADE FROM o_orderdate) AS de, EXTRACT(MILLENNIUM FROM o_orderdate) AS ml, DATE_PART('month', o_orderdate) AS dp, YEAR(o_orderdate) AS yr,
           EXTRACT(DATE FROM o_orderdate) AS dt FROM orders""", """
    SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(EXTRACT(QUARTER FROM o_orderdate) AS INTEGER) AS q, CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS m, CAST(EXTRACT(WEEK FROM o_orderdate) AS INTEGER) AS w, CAST(EXTRACT(DAY FROM o_orderdate) AS INTEGER) AS d,
           CAST(EXTRACT(DOW FROM o_orderdate) AS INTEGER) AS dow, CAST(EXTRACT(DOY FROM o_orderdate) AS INTEGER) AS doy, CAST(EXTRACT(HOUR FROM o_orderdate) AS INTEGER) AS h, YEAR(o_orderdate) // 100 AS c, YEAR(o_orderdate) // 10 AS de, YEAR(o_orderdate) // 1000 AS ml,
           CAST(MONTH(o_orderdate) AS INTEGER) AS dp, CAST(YEAR(o_orderdate) AS INTEGER) AS yr, CAST(o_orderdate AS DATE) AS dt FROM orders""")
add("time_extract", "SELECT event_id, EXTRACT(MINUTE FROM ts) AS m, EXTRACT(SECOND FROM ts) AS s, EXTRACT(MICROSECOND FROM ts) AS u, EXTRACT(MILLISECOND FROM ts) AS ms FROM events", """
    SELECT event_id, CAST(MINUTE(ts) AS INTEGER) AS m, CAST(SECOND(ts) AS INTEGER) AS s, CAST(epoch_us(ts) % 1000000 AS INTEGER) AS u, CAST(1000 * (epoch_us(ts) % 1000000) AS INTEGER) AS ms FROM events""")
add("timestamp_add_diff", """
    SELECT o_orderkey, TIMESTAMPADD(DAY, 10, o_orderdate) AS d, TIMESTAMPADD(MONTH, 2, o_orderdate) AS m, TIMESTAMPADD(HOUR, 5, o_orderdate) AS h, TIMESTAMPDIFF(DAY, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dd,
           TIMESTAMPDIFF(HOUR, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dh, TIMESTAMPDIFF(NANOSECOND, o_orderdate, o_orderdate) AS dn FROM orders""", """
    SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS d, o_orderdate + INTERVAL 2 MONTH AS m, o_orderdate + INTERVAL 5 HOUR AS h, datesub('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dd,
           datesub('hour', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dh, CAST(0 AS BIGINT) AS dn FROM orders""")
add("ceil_floor_time", "SELECT event_id, FLOOR(ts TO DAY) AS fd, FLOOR(ts TO HOUR) AS fh, CEIL(ts TO DAY) AS cd, CEIL(ts TO MINUTE) AS cm, CEIL(ts TO SECOND) AS cs FROM events", """
    SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS fd, date_trunc('hour', ts) AS fh, CASE WHEN ts = date_trunc('day', ts) THEN ts ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY END AS cd,
           CASE WHEN ts = date_trunc('minute', ts) THEN ts ELSE date_trunc('minute', ts) + INTERVAL 1 MINUTE END AS cm, CASE WHEN ts = date_trunc('second', ts) THEN ts ELSE date_trunc('second', ts) + INTERVAL 1 SECOND END AS cs FROM events""")
add("last_day", "SELECT o_orderkey, LAST_DAY(o_orderdate) AS l FROM orders", "SELECT o_orderkey, CAST(last_day(o_orderdate) AS TIMESTAMP) + (o_orderdate - date_trunc('day', o_orderdate)) AS l FROM orders")
add("to_timestamp", "SELECT o_orderkey, TO_TIMESTAMP('02/28/1997', '%m/%d/%Y') AS a, TO_TIMESTAMP('1997-02-28 10:30:00') AS b, TO_TIMESTAMP(o_orderkey) AS c FROM orders", "SELECT o_orderkey, TIMESTAMP '1997-02-28 00:00:00' AS a, TIMESTAMP '1997-02-28 10:30:00' AS b, make_timestamp(o_orderkey * 1000000) AS c FROM orders")
add("date_arithmetic", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL '90' DAY < TIMESTAMP '1993-06-01 00:00:00' AND o_orderdate >= '1992-03-01'")
add("timestamp_plus_days", "SELECT o_orderkey FROM orders WHERE o_orderdate + 30 < TIMESTAMP '1993-01-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1993-01-01 00:00:00'")
add("current_time_functions", "SELECT r_regionkey, CURRENT_TIMESTAMP IS NOT NULL AS a, LOCALTIMESTAMP IS NOT NULL AS b, CURRENT_DATE IS NOT NULL AS c, CURRENT_TIME IS NOT NULL AS d, LOCALTIME IS NOT NULL AS e FROM region", "SELECT r_regionkey, TRUE AS a, TRUE AS b, TRUE AS c, TRUE AS d, TRUE AS e FROM region")
add("json_array_helpers", "SELECT event_id, get_json_object(props, '$.k') AS k, SIZE(SPLIT(event_type, 'i')) AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(string_split(event_type, 'i')) AS INTEGER) AS n FROM events")
add("time_function_names", "SELECT event_id, YEAR(ts) AS y, QUARTER(ts) AS q, MONTH(ts) AS m, DAYOFMONTH(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS mi, SECOND(ts) AS s FROM events",
    "SELECT event_id, CAST(YEAR(ts) AS INTEGER) AS y, CAST(QUARTER(ts) AS INTEGER) AS q, CAST(MONTH(ts) AS INTEGER) AS m, CAST(DAY(ts) AS INTEGER) AS d, CAST(HOUR(ts) AS INTEGER) AS h, CAST(MINUTE(ts) AS INTEGER) AS mi, CAST(SECOND(ts) AS INTEGER) AS s FROM events")
add("date_difference", "SELECT o_orderkey, EXTRACT(DAY FROM CAST(o_orderdate AS DATE) - DATE '1992-01-01') AS d FROM orders WHERE o_orderdate - TIMESTAMP '1992-01-01 00:00:00' > INTERVAL '100' DAY",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS d FROM orders WHERE o_orderdate > TIMESTAMP '1992-01-01 00:00:00' + INTERVAL 100 DAY")
add("timestamp_units", """
    SELECT o_orderkey, TIMESTAMPADD(YEAR, 1, o_orderdate) AS y, TIMESTAMPADD(QUARTER, 2, o_orderdate) AS q, TIMESTAMPADD(WEEK, 3, o_orderdate) AS w, TIMESTAMPADD(MINUTE, 4, o_orderdate) AS mi, TIMESTAMPADD(SECOND, 5, o_orderdate) AS s, TIMESTAMPADD(DAY, 1, 86400) AS e,
           TIMESTAMPDIFF(YEAR, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dy, TIMESTAMPDIFF(QUARTER, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dq, TIMESTAMPDIFF(MONTH, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dm, TIMESTAMPDIFF(WEEK, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dw,
           TIMESTAMPDIFF(MINUTE, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS di, TIMESTAMPDIFF(SECOND, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS ds, TIMESTAMPDIFF(NANOSECOND, TIMESTAMP '1992-01-01 00:00:00', TIMESTAMP '1992-01-01 00:00:00.000003') AS dn FROM orders""", """
    SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 6 MONTH AS q, o_orderdate + INTERVAL 21 DAY AS w, o_orderdate + INTERVAL 4 MINUTE AS mi, o_orderdate + INTERVAL 5 SECOND AS s, TIMESTAMP '1970-01-03 00:00:00' AS e,
           datesub('year', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dy, datesub('quarter', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dq, datesub('month', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dm, datesub('week', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dw,
           datesub('minute', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS di, datesub('second', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS ds, CAST(3000 AS BIGINT) AS dn FROM orders""")
add("string_edges", "SELECT n_nationkey, REPLACE(n_name, '', 'x') AS r, n_name || NULL AS n, SUBSTRING(n_name FROM 40) AS s, POSITION('' IN n_name) AS p, TRIM('  a ') AS t, UPPER(NULLIF(n_name, 'CHINA')) AS u FROM nation",
    "SELECT n_nationkey, n_name AS r, CAST(NULL AS VARCHAR) AS n, '' AS s, 1 AS p, 'a' AS t, UPPER(NULLIF(n_name, 'CHINA')) AS u FROM nation")
add("ceil_floor_fine", "SELECT event_id, FLOOR(ts TO MILLISECOND) AS a, CEIL(ts TO MILLISECOND) AS b, FLOOR(ts TO MICROSECOND) AS c, FLOOR(ts TO MINUTE) AS d FROM events", """
    SELECT event_id, date_trunc('millisecond', ts) AS a, CASE WHEN ts = date_trunc('millisecond', ts) THEN ts ELSE date_trunc('millisecond', ts) + INTERVAL 1 MILLISECOND END AS b, ts AS c, date_trunc('minute', ts) AS d FROM events""")

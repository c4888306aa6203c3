"""The same operators through the DataFrame API, and sources read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import columns as C
from quarry.operators.registry import query
from quarry.streaming.windows import tumbling


@query("""SELECT o_orderkey, o_custkey - floor(o_custkey / -7.0) * -7 AS m, trunc(o_totalprice) AS t, CAST(last_day(o_orderdate) AS TIMESTAMP) + (o_orderdate - date_trunc('day', o_orderdate)) AS l FROM orders""", tables="orders")
def column_builders(engine):
    return engine.table("orders").select("o_orderkey", C.mod(F.col("o_custkey"), F.lit(-7.0)).alias("m"), C.truncate(F.col("o_totalprice")).alias("t"), C.last_day(F.col("o_orderdate")).alias("l"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2", tables="events")
def tumbling_windows(engine):
    out = tumbling(engine.table("events"), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)})
    return out.select(F.col("start").cast(T.TimestampNTZType()).alias("start"), "event_type", "n", "total")


@query("SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey", tables="nation")
def pandas_input(engine):
    engine.create_table("small", engine.table("nation").toPandas(), npartitions=2)
    return engine.sql("SELECT n_regionkey AS k, COUNT(*) AS n FROM small GROUP BY n_regionkey")


@query("SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT r_regionkey, r_name FROM region", tables="region")
def list_input(engine):
    frame = engine.table("region")
    engine.create_table("both", [frame, frame])
    return engine.sql("SELECT r_regionkey AS k, r_name AS v FROM both")

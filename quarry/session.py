"""The Spark session of an engine."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set only on sessions that are made here; queries don't depend on them.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}
#: Join order by statistics; useful once tables are analysed.
COST_BASED = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.cbo.starSchemaDetection": "true"}


def build_session(name: str = "quarry", master: str | None = None, cost_based: bool = False, **conf: str) -> SparkSession:
    """A session; one that is active already is given back as it is."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **(COST_BASED if cost_based else {}), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed but on the driver's path (a local run)."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, here)))


def branch(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session with settings of its own that knows the views and functions of ``spark``; its frames keep the settings."""
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in conf.items():
        out.conf.set(key, value)
    return out


def at_home(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """The frame as one of ``spark``, whatever session it was made in."""
    if frame.sparkSession is spark:
        return frame
    plan = frame._jdf.queryExecution().logical()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under ``spark.checkpoint.dir``, or for a local master a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/engine/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='quarry-engine-')}"

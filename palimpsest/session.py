"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def build(master: str | None = None, app: str = "palimpsest", **conf: str) -> SparkSession:
    """A session with CONF; on a cluster leave master and partition counts to the cluster's own settings."""
    builder = SparkSession.builder.appName(app).config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()

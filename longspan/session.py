"""A session with the settings that the operators expect; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("longspan")
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        if v != "":
            b = b.config(k, v)
    return b.getOrCreate()

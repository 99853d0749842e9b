"""Sessions with the settings that the operators' results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lattica", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive plans; everything else as the cluster or the caller sets it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in {**fixed, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

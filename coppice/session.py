"""Session factory: settings that the engine relies on, all overridable."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app_name: str = "coppice", **overrides: str) -> SparkSession:
    """A session with DEFAULTS; keyword ``a__b`` sets the option ``a.b``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in overrides.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

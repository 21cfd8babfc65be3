"""The engine's session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for day boundaries, adaptive plans with skew joins, and maps in which the last key wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the defaults and what the caller adds."""
    builder = SparkSession.builder.master(master).appName("prismata")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""The session the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sieveloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Kryo; keyword arguments are settings with _ for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()

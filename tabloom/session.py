"""Session settings that the operators are made for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tabloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; a master and sizes come from the caller or the cluster."""
    builder = SparkSession.builder.appName(name)
    if "spark.master" not in conf and "MASTER" not in os.environ:
        builder = builder.master("local[*]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

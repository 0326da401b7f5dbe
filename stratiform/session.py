"""Sessions set up as every operator expects: UTC, adaptive execution, RocksDB state."""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def _setting(name: str) -> str:
    return name.replace("_", ".")


def build_session(name: str = "stratiform", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use underscores for dots."""
    os.environ["TZ"] = "UTC"
    time.tzset()
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{_setting(k): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Plant-local conversion gives the wrong instant under any other session zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")

import datetime as dt

from pyspark.sql import functions as F

from stratiform.operators import transforms
from stratiform.queries import QUERIES, _shown
from stratiform.sources import testdata as td


def test_append_keeps_every_closed_window(spark, tmp_path, rows):
    # The first of the time ranges is by far the largest, so its file is finished last.
    n, start = 400_000, dt.datetime(2024, 1, 1)
    events = spark.range(n + 300).select(
        F.col("id").alias("event_id"),
        F.lit("view").alias("event_type"),
        (F.col("id") % 20).alias("user_id"),
        F.timestamp_seconds(F.lit(int(start.replace(tzinfo=dt.UTC).timestamp())) + F.greatest(F.col("id") - n, F.lit(0)) * 3600).cast("timestamp_ntz").alias("ts"),
        F.lit(1.0).alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    got = QUERIES["stream_rollup_append"](spark, f"file://{tmp_path}")
    batch = _shown(transforms.rollup(td.telemetry(spark, f"file://{tmp_path}")))
    closed = batch.where(F.col("window_end_utc") <= F.lit(start + dt.timedelta(hours=299, minutes=-10)).cast("timestamp_ntz"))
    cols = ["plant_code", "machine_id", "window_start_utc", "event_count"]
    assert closed.count() == 20 + 298 and rows(got.select(*cols)) == rows(closed.select(*cols))

"""The telemetry stream: envelopes to one-minute roll-ups, merged idempotently into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.transforms import parse_telemetry, rollup, stamped
from ..plans.store import TableStore
from ..sources.readers import payloads

ROLLUP_KEYS = ["plant_code", "machine_id", "window_start_utc"]


def rollup_stream(envelopes: DataFrame, watermark: str = "10 minutes", width: str = "1 minute", max_name: str = "vibration_g_p100") -> DataFrame:
    return rollup(parse_telemetry(payloads(envelopes), watermark), width, max_name)


def upsert_rollup(store: TableStore, table: str):
    """A micro-batch sink: the first batch creates the table, later ones and replays merge by window and machine."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = stamped(batch, None)
        if not store.exists(table):
            store.create(table, rows, ["plant_code"])
        else:
            store.merge(table, rows, ROLLUP_KEYS)

    return sink


def start_rollup(store: TableStore, envelopes: DataFrame, table: str, checkpoint: str, mode: str = "append", every: str | None = "30 seconds", watermark: str = "10 minutes", width: str = "1 minute", name: str = "telemetry_rollup") -> StreamingQuery:
    """Starts the query; ``every`` None processes what is there and stops. One stream serves several service
    levels by different triggers, each with its own checkpoint. ``update`` shows windows before they close;
    ``append`` only when the watermark has passed their end.
    """
    writer = rollup_stream(envelopes, watermark, width).writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(upsert_rollup(store, table)).start()

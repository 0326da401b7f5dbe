"""The unified graph: telemetry and orders through bronze and silver to the material dimension and the gold view."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.transforms import gold_oee, normalise_orders, parse_telemetry, rollup, stamped
from ..sources.readers import payloads, read_incremental_json, replay_envelopes
from ..sources.schemas import ORDER_FLAT
from .pipeline import Pipeline
from .store import TableStore


def build(store: TableStore, telemetry_path: str, orders_path: str, schema: str = "medallion", envelopes: DataFrame | None = None) -> Pipeline:
    """The pipeline over a store; ``envelopes`` replaces the replayed files by another stream, such as Kafka's."""
    p = Pipeline(store, schema)
    spark = store.spark

    @p.table(kind="stream", comment="raw telemetry payloads", properties={"quality": "bronze"})
    def bronze_cnc_telemetry() -> DataFrame:
        return payloads(envelopes if envelopes is not None else replay_envelopes(spark, telemetry_path))

    @p.table(kind="stream", comment="order files as they arrive", properties={"quality": "bronze"})
    def bronze_sap_production_order() -> DataFrame:
        return read_incremental_json(spark, orders_path, ORDER_FLAT)

    @p.table(kind="stream", reads=["bronze_cnc_telemetry"], partition_cols=["plant_code"], comment="one-minute figures by machine")
    @p.expect_or_fail("non_null_machine", "plant_code IS NOT NULL AND machine_id IS NOT NULL")
    @p.expect_or_drop("vibration_in_range", "vibration_g_avg BETWEEN 0 AND 50")
    @p.expect("event_count_positive", "event_count > 0")
    def silver_cnc_telemetry_1min() -> DataFrame:
        return stamped(rollup(parse_telemetry(p.read_stream("bronze_cnc_telemetry"), "10 minutes")), None)

    @p.table(kind="stream", reads=["bronze_sap_production_order"], comment="orders in UTC with a row hash")
    @p.expect_or_fail("non_null_pk", "production_order_id IS NOT NULL")
    @p.expect_or_drop("known_plant", "plant_code RLIKE '^[A-Z]{3}-[0-9]+$'")
    @p.expect("future_posting_warn", "posting_ts_utc <= current_timestamp() + INTERVAL 7 DAYS")
    def silver_sap_production_order() -> DataFrame:
        return stamped(normalise_orders(p.read_stream("bronze_sap_production_order")), None)

    p.create_streaming_table("silver_dim_material", "material versions from order events")
    p.apply_changes("silver_dim_material", "silver_sap_production_order", ["material_id"], "posting_ts_utc", ["uom", "status"])

    @p.table(reads=["silver_cnc_telemetry_1min", "silver_sap_production_order"], comment="five-minute figures with active orders")
    def gold_machine_oee_5min() -> DataFrame:
        return stamped(gold_oee(p.read("silver_cnc_telemetry_1min"), p.read("silver_sap_production_order")), None, "computed_at")

    return p

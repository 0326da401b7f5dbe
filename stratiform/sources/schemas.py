"""Contracts of the tables: names and types are fixed values that the data agree on."""

from __future__ import annotations

TELEMETRY = "plant_code string, machine_id string, event_ts timestamp, vibration_g double, temperature_c double, spindle_rpm double, feed_rate_mm_min double, tool_id string"
ENVELOPE = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
ORDER_FLAT = "production_order_id string, plant_code string, plant_timezone string, material_id string, quantity double, uom string, posting_date_local string, created_by string, status string"
ORDER_NESTED = ORDER_FLAT + ", customer struct<customer_id:string,customer_name:string,region:string>, items array<struct<item_no:int,component_id:string,required_qty:double>>"
MATERIAL = "material_id string, material_description string, material_group string, uom string, spec_revision string, criticality_class string, is_aerospace_grade boolean, supplier_default_id string"
SUPPLIER_DISPATCH = "purchase_order_id string, supplier_id string, material_id string, plant_code string, expected_delivery_ts_utc timestamp, actual_delivery_ts_utc timestamp, delivery_qty double, required_qty double"
FACT_SUPPLIER_OTD = "supplier_id string, plant_code string, material_id string, purchase_order_id string, expected_date_utc timestamp, actual_delivery_ts_utc timestamp, delivery_qty decimal(18,3), required_qty decimal(18,3), otd_status string, delay_seconds long, silver_loaded_at_utc timestamp, synapse_loaded_at_utc timestamp"
FACT_PRODUCTION_ORDER = "production_order_id string, plant_code string, material_id string, customer_id string, quantity decimal(18,3), uom string, posting_ts_utc timestamp, started_ts_utc timestamp, completed_ts_utc timestamp, cycle_time_seconds long, status string, item_count int, row_hash string, silver_loaded_at_utc timestamp, synapse_loaded_at_utc timestamp"
PIPELINE_RUN = "run_id string, pipeline_name string, source_system string, entity string, status string, started_at timestamp, ended_at timestamp, metrics_json string, error_text string, host string"
PIPELINE_LOCK = "pipeline_name string, run_id string, host string, acquired_at timestamp"
PIPELINE_WATERMARK = "source_system string, entity string, watermark_value string, updated_at timestamp"
RECON_RESULTS = "pipeline_name string, run_date string, total_rows long, variance_rows long, variance_pct double, tolerance_pct double, within_tolerance boolean"
SOURCE_CONFIG = "source_id int, source_system string, source_type string, entity string, ingestion_pattern string, schedule_cron string, target_bronze_path string, sla_minutes int, is_active boolean, created_at timestamp, updated_at timestamp"

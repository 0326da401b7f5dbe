"""The ingestion catalogue: which source feeds which entity, how, when, and how late it may be."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SOURCE_CONFIG

# The catalogue's rows (system, type, entity, pattern, cron, path, SLA minutes).
SEED = [
    ("SAP_S4HANA", "db_cdc", "production_order", "incremental", "0 2 * * *", "sap/production_order", 60),
    ("SAP_S4HANA", "db_cdc", "material_master", "incremental", "0 2 * * *", "sap/material_master", 60),
    ("SAP_S4HANA", "db_cdc", "purchase_order_requirements", "incremental", "0 2 * * *", "sap/po_requirements", 60),
    ("MES", "db_cdc", "work_order", "incremental", "*/30 * * * *", "mes/work_order", 45),
    ("MES", "db_cdc", "quality_inspection", "incremental", "*/30 * * * *", "mes/quality_inspection", 45),
    ("TEAMCENTER", "api_rest", "engineering_change", "incremental", "0 */4 * * *", "plm/engineering_change", 90),
    ("TEAMCENTER", "api_rest", "bom", "snapshot", "0 1 * * *", "plm/bom", 90),
    ("SUP_TATA_AERO", "sftp_file", "supplier_dispatch", "incremental", None, "supplier/dispatch/tata", 30),
    ("SUP_MAHLE_IN", "sftp_file", "supplier_dispatch", "incremental", None, "supplier/dispatch/mahle", 30),
    ("SUP_HEXCEL_IN", "sftp_file", "supplier_dispatch", "incremental", None, "supplier/dispatch/hexcel", 30),
    ("OPC_UA_HYD1", "stream", "cnc_telemetry", "continuous", None, "iot/cnc_telemetry/hyd1", 5),
    ("OPC_UA_BLR2", "stream", "cnc_telemetry", "continuous", None, "iot/cnc_telemetry/blr2", 5),
]
READER_OF_TYPE = {"db_cdc": "read_jdbc", "sftp_file": "read_rescued_csv", "api_rest": "read_json", "stream": "read_kafka"}


def source_config(spark: SparkSession, created: dt.datetime = dt.datetime(2026, 1, 1)) -> DataFrame:
    """The seeded catalogue with its identity and default columns."""
    rows = [(i, *r, True, created, created) for i, r in enumerate(SEED, 1)]
    return spark.createDataFrame(rows, SOURCE_CONFIG)


def ingestion_plan(config: DataFrame) -> DataFrame:
    """Active sources with the reader that serves their type."""
    pairs = [F.lit(x) for kv in READER_OF_TYPE.items() for x in kv]
    return config.where("is_active").withColumn("reader", F.try_element_at(F.create_map(*pairs), F.col("source_type")))


def sla_breaches(config: DataFrame, landings: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Active sources whose last landing (source_system, entity, landed_at) is older than their SLA at ``as_of``."""
    last = landings.groupBy("source_system", "entity").agg(F.max("landed_at").alias("landed_at"))
    late = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.col("sla_minutes"))
    joined = config.where("is_active").join(last, ["source_system", "entity"], "left")
    return joined.where(F.col("landed_at").isNull() | (F.col("landed_at") < late)).select("source_system", "entity", "sla_minutes", "landed_at")

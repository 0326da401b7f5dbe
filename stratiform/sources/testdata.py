"""The reference domain's relations, derived from the TPC-H-like test tables.

Adapters for queries and benches: every relation is a view over Parquet with built-in functions only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which relative-time filters look back; the newest order date at the small scales.
AS_OF = dt.datetime(2001, 8, 1)
# Time zones by region and statuses by order flag.
ZONES = {"ASIA": "Asia/Kolkata", "EUROPE": "Europe/Paris", "AMERICA": "America/New_York", "AFRICA": "Africa/Lagos"}
OTHER_ZONE = "Asia/Dubai"
STATUS = {"F": "CNF", "O": "REL", "P": "CRT"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chosen(column: str, values: dict[str, str], other) -> F.Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), other)


def plant(name: str = "n_name", key: str = "n_nationkey"):
    return F.concat(F.upper(F.substring(name, 1, 3)), F.lit("-"), F.col(key).cast("string"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("plant_code"),
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("value").alias("vibration_g"),
        F.from_json("props", "k int")["k"].cast("double").alias("temperature_c"),
        (F.col("event_id") % 1000).cast("double").alias("spindle_rpm"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    body = F.to_json(F.struct(*t.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).cast("binary")
    return t.select(F.lit(None).cast("binary").alias("key"), body.alias("value"), F.lit("cnc-telemetry").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.col("event_ts").alias("timestamp"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested production orders with plant-local posting texts."""
    # One dimension after another, so each join is planned by the size of its own table.
    customer, nation, region = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    o = load(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    o = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    item = lambda i: F.struct(i.cast("int").alias("item_no"), F.concat(F.lit("C"), i.cast("string")).alias("component_id"), i.cast("double").alias("required_qty"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("production_order_id"),
        plant().alias("plant_code"),
        _chosen("r_name", ZONES, F.lit(OTHER_ZONE)).alias("plant_timezone"),
        (F.col("o_custkey") % 500).cast("string").alias("material_id"),
        F.round(F.col("o_totalprice") % 1000, 2).alias("quantity"),
        F.col("o_orderpriority").alias("uom"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("posting_date_local"),
        F.col("c_mktsegment").alias("created_by"),
        _chosen("o_orderstatus", STATUS, F.col("o_orderstatus")).alias("status"),
        F.struct(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("r_name").alias("region")).alias("customer"),
        F.when(F.col("n").isNotNull(), F.transform(F.sequence(F.lit(1), F.col("n")), item)).alias("items"),
    )


def otd_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries: expected 30 days after the order, delivered at the ship date unless the line is open."""
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("plant_code", plant())
    expected = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")
    actual = F.when(F.col("l_linestatus") != "O", F.col("l_shipdate").cast("timestamp"))
    qty = F.col("l_quantity").cast("decimal(18,3)")
    status = F.when(actual.isNull(), "PENDING").when(actual <= expected, "ON_TIME").otherwise("LATE")
    return rows.select(F.col("l_suppkey").alias("supplier_id"), "plant_code", F.col("l_partkey").alias("material_id"), F.col("l_orderkey").alias("purchase_order_id"), expected.alias("expected_date_utc"), actual.alias("actual_delivery_ts_utc"), qty.alias("delivery_qty"), qty.alias("required_qty"), status.alias("otd_status"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier dimension with an expired version for every third one."""
    s = load(spark, sf_dir, "supplier")
    now = s.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"), F.lit(True).alias("is_current"))
    old = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("supplier_id"), F.concat(F.lit("old "), "s_name").alias("supplier_name"), F.lit(False).alias("is_current"))
    return now.union(old)


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(plant().alias("plant_code"), F.col("n_name").alias("plant_name"))


def materials(spark: SparkSession, sf_dir: str, day: int = 1) -> DataFrame:
    """The material master; on day 2 some sizes have changed and held-out parts have come."""
    p = load(spark, sf_dir, "part")
    size = F.col("p_size") if day == 1 else F.when(F.col("p_partkey") % 10 == 3, F.col("p_size") + 1).otherwise(F.col("p_size"))
    out = p.select(F.col("p_partkey").alias("material_id"), F.col("p_name").alias("material_description"), F.col("p_type").alias("material_group"), size.cast("int").alias("size"))
    return out.where("material_id % 7 <> 5") if day == 1 else out


def material_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material_id"), F.col("o_orderdate").alias("posting_ts"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("order_key"))


def legacy_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    changed = F.when(F.col("o_orderkey") % 100 == 3, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return o.where("o_orderkey % 50 <> 1"), o.where("o_orderkey % 40 <> 2").withColumn("o_orderstatus", changed)

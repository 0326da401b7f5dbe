"""Bronze to silver to gold: parsing, roll-ups, order normalisation, the OEE join, OTD facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import row_hash
from ..functions.instants import bucket_start, item_count, utc_from_local
from ..sources.schemas import TELEMETRY

ORDER_HASH_COLUMNS = ["production_order_id", "plant_code", "material_id", "quantity", "status"]
#: What tells two versions of a silver order apart.
SILVER_HASH_COLUMNS = ["production_order_id", "plant_code", "material_id", "quantity", "uom", "posting_ts_utc", "status", "customer_id", "item_count"]
MATERIAL_COLUMNS = ["material_id", "material_description", "material_group", "uom", "spec_revision", "criticality_class", "is_aerospace_grade", "supplier_default_id"]
ACTIVE = ("REL", "CNF")
#: Rows of a block where buckets meet orders. 504 values are Parquet's longest bit-packed run, so a block's pattern recurs byte by byte.
BUCKET_BLOCK, ORDER_BLOCK = 64, 504


def parse_telemetry(payloads: DataFrame, watermark: str | None = None, ts_name: str = "kafka_ingest_ts") -> DataFrame:
    """Events from JSON payloads; rows without plant or machine go, malformed fields are null."""
    out = payloads.withColumn("event", F.from_json("payload", TELEMETRY)).select("event.*", ts_name)
    out = out.where(F.col("plant_code").isNotNull() & F.col("machine_id").isNotNull())
    return out.withWatermark("event_ts", watermark) if watermark else out


def rollup(events: DataFrame, width: str = "1 minute", max_name: str = "vibration_g_max", exact_p95: bool = False) -> DataFrame:
    """Averages, 95th percentile, maximum and count for each tumbling window, plant and machine."""
    p95 = "percentile_disc(0.95) WITHIN GROUP (ORDER BY vibration_g)" if exact_p95 else "percentile_approx(vibration_g, 0.95)"
    grouped = events.groupBy(F.window("event_ts", width).alias("w"), "plant_code", "machine_id").agg(
        F.avg("vibration_g").alias("vibration_g_avg"),
        F.expr(p95).alias("vibration_g_p95"),
        F.max("vibration_g").alias(max_name),
        F.avg("temperature_c").alias("temperature_c_avg"),
        F.avg("spindle_rpm").alias("spindle_rpm_avg"),
        F.count("*").alias("event_count"),
    )
    return grouped.select("plant_code", "machine_id", F.col("w.start").alias("window_start_utc"), F.col("w.end").alias("window_end_utc"), "vibration_g_avg", "vibration_g_p95", max_name, "temperature_c_avg", "spindle_rpm_avg", "event_count")


def stamped(df: DataFrame, at: dt.datetime | Column | None, name: str = "ingested_at") -> DataFrame:
    """One load time for the whole run."""
    return df.withColumn(name, F.current_timestamp() if at is None else at if isinstance(at, Column) else F.lit(at).cast("timestamp"))


def normalise_orders(orders: DataFrame) -> DataFrame:
    """Flat orders with their UTC posting time and a hash over five columns in the given order."""
    return orders.withColumns({"posting_ts_utc": utc_from_local("posting_date_local", "plant_timezone"), "row_hash": row_hash(ORDER_HASH_COLUMNS, ordered=False)}).drop("posting_date_local")


def flatten_orders(orders: DataFrame, null_items: int | None = -1) -> DataFrame:
    """Nested orders as flat rows with UTC times, item counts and a hash over SILVER_HASH_COLUMNS."""
    flat = orders.select(
        "production_order_id", "plant_code", "plant_timezone", "material_id", "quantity", "uom", "created_by", "status",
        F.col("customer.customer_id").alias("customer_id"),
        F.col("customer.customer_name").alias("customer_name"),
        F.col("customer.region").alias("customer_region"),
        item_count("items", null_items).alias("item_count"),
        utc_from_local("posting_date_local", "plant_timezone").alias("posting_ts_utc"),
    )
    return flat.withColumn("row_hash", row_hash(SILVER_HASH_COLUMNS))


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def since_watermark(orders: DataFrame, watermark: str | None, compat: str | None = None) -> DataFrame:
    """Orders past a UTC watermark; ``compat="local_text"`` compares the plant-local text instead."""
    if watermark is None:
        return orders
    if compat == "local_text":
        return orders.where(F.col("posting_date_local") > F.lit(watermark))
    return orders.where(utc_from_local("posting_date_local", "plant_timezone") > F.lit(watermark).cast("timestamp"))


def five_minutes(silver: DataFrame, seconds: int = 300, weighted: bool = False) -> DataFrame:
    """Figures of each machine and bucket, which ``bucket`` names by its start in epoch seconds."""
    weigh = F.sum(F.col("vibration_g_avg") * F.col("event_count")) / F.sum("event_count") if weighted else F.avg("vibration_g_avg")
    return silver.groupBy("plant_code", "machine_id", bucket_start("window_start_utc", seconds).alias("bucket")).agg(
        weigh.alias("vibration_g_5m_avg"), F.max("vibration_g_max").alias("vibration_g_5m_max"), F.sum("event_count").alias("event_count_5m")
    )


def with_window(five: DataFrame, seconds: int = 300) -> DataFrame:
    """``five_minutes`` with the bucket's start and end as times."""
    return five.select(
        "plant_code", "machine_id", F.timestamp_seconds("bucket").alias("window_start_utc"), F.timestamp_seconds(F.col("bucket") + seconds).alias("window_end_utc"),
        "vibration_g_5m_avg", "vibration_g_5m_max", "event_count_5m",
    )


def in_blocks(df: DataFrame, keys: list[str], order: list[str], size: int, name: str) -> DataFrame:
    """Rows of ``size`` of a key's rows each (its last one has the rest), as an array ``name`` of their other columns."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = F.struct(*[c for c in df.columns if c not in keys])
    return df.withColumn("_block", F.floor((at - 1) / size)).groupBy(*keys, "_block").agg(F.collect_list(rows).alias(name)).drop("_block")


def with_active_orders(buckets: DataFrame, orders: DataFrame) -> DataFrame:
    """Each bucket once for each active order of its plant, once with nulls where there are none.

    The rows are the product of a plant's buckets and orders, so what the buckets show should be computed before. There are
    few plants, and inputs of few bytes make many rows; so a plant's buckets are dealt over ``deals`` parts, each of which
    meets all of the plant's orders, and the number of tasks is fixed. Both sides meet in blocks, which keep the orders'
    copies small, and each bucket meets a block's orders in the same order: Parquet's pages, of 20,000 rows, hold the same
    ORDER_BLOCK orders over and over, and pack them well.
    """
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = max(8, n // 8)
    tasks = max(n, 8 * deals)
    active = orders.where(F.col("status").isin(*ACTIVE)).select("plant_code", F.col("production_order_id").alias("active_production_order_id"), "material_id")
    dealt = buckets.withColumn("_deal", F.pmod(F.xxhash64("machine_id", "window_start_utc"), F.lit(deals)).cast("int")).repartition(tasks, "plant_code", "_deal")
    dealt = in_blocks(dealt, ["plant_code", "_deal"], ["machine_id", "window_start_utc"], BUCKET_BLOCK, "_buckets")
    copies = in_blocks(active, ["plant_code"], ["material_id", "active_production_order_id"], ORDER_BLOCK, "_orders")
    copies = copies.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).repartition(tasks, "plant_code", "_deal")
    pairs = dealt.join(copies.hint("merge"), ["plant_code", "_deal"], "left")
    # Generated code holds all rows of one row of the join, which is a block of buckets by all orders; transform() has none, so rows go on one by one.
    return pairs.select("plant_code", F.inline(F.transform("_buckets", lambda x: x)), "_orders").select(*buckets.columns, F.inline_outer("_orders"))


def gold_oee(silver: DataFrame, orders: DataFrame, seconds: int = 300, weighted: bool = False, as_of_order: bool = False, together: bool = False) -> DataFrame:
    """Five-minute figures for each machine with the plant's active orders (one row for each of them).

    The average is that of the one-minute averages unless ``weighted`` by events; ``as_of_order`` takes only the
    latest active order posted by the bucket's end, instead of every active one. ``together`` gives one row for each
    bucket with the number of the plant's active orders, their least and greatest id and the number of their
    materials; orders are aggregated by plant before the join, so nothing fans out.
    """
    five = five_minutes(silver, seconds, weighted)
    if not as_of_order and not together:
        return with_active_orders(with_window(five, seconds), orders)
    active = orders.where(F.col("status").isin(*ACTIVE)).select("plant_code", "production_order_id", "material_id", "posting_ts_utc")
    end = F.timestamp_seconds(F.col("bucket") + seconds)
    if together:
        by_plant = active.groupBy("plant_code").agg(F.count("*").alias("active_orders"), F.min("production_order_id").alias("first_order"), F.max("production_order_id").alias("last_order"), F.countDistinct("material_id").alias("active_materials"))
        return five.join(by_plant, "plant_code", "left").select(
            "plant_code", "machine_id", F.timestamp_seconds("bucket").alias("window_start_utc"), end.alias("window_end_utc"), "vibration_g_5m_avg", "vibration_g_5m_max", "event_count_5m",
            F.coalesce("active_orders", F.lit(0)).alias("active_orders"), "first_order", "last_order", F.coalesce("active_materials", F.lit(0)).alias("active_materials"),
        )
    joined = five.join(active, "plant_code", "left")
    w = Window.partitionBy("plant_code", "machine_id", "bucket").orderBy((F.col("posting_ts_utc") <= end).desc_nulls_last(), F.col("posting_ts_utc").desc_nulls_last(), "production_order_id")
    on = F.col("posting_ts_utc") <= end
    joined = joined.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").withColumns({c: F.when(on, F.col(c)) for c in ("production_order_id", "material_id")})
    return joined.select(
        "plant_code", "machine_id", F.timestamp_seconds("bucket").alias("window_start_utc"), end.alias("window_end_utc"),
        "vibration_g_5m_avg", "vibration_g_5m_max", "event_count_5m", F.col("production_order_id").alias("active_production_order_id"), "material_id",
    )


def derive_otd(dispatch: DataFrame) -> DataFrame:
    """Delivery status and delay: on time up to the expected time, pending without a delivery."""
    expected, actual = F.col("expected_delivery_ts_utc"), F.col("actual_delivery_ts_utc")
    status = F.when(actual.isNull(), "PENDING").when(actual <= expected, "ON_TIME").otherwise("LATE")
    return dispatch.select(
        "supplier_id", "plant_code", "material_id", "purchase_order_id", expected.alias("expected_date_utc"), "actual_delivery_ts_utc",
        F.col("delivery_qty").cast("decimal(18,3)").alias("delivery_qty"), F.col("required_qty").cast("decimal(18,3)").alias("required_qty"),
        status.alias("otd_status"), (F.unix_timestamp(actual) - F.unix_timestamp(expected)).alias("delay_seconds"),
    )

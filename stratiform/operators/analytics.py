"""Supplier analytics over the delivery facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import quarter_start

SETTLED = ("ON_TIME", "LATE")


def otd_trend(facts: DataFrame, suppliers: DataFrame, as_of: dt.datetime, quarters: int = 8) -> DataFrame:
    """On-time share by supplier and quarter with the change from the quarter before it that has rows."""
    since = F.add_months(F.lit(as_of).cast("date"), -3 * quarters).cast("timestamp")
    by_quarter = (
        facts.where(F.col("otd_status").isin(*SETTLED) & (F.col("expected_date_utc") >= since))
        .groupBy("supplier_id", quarter_start("expected_date_utc").alias("quarter_start"))
        .agg(F.count("*").alias("total_orders"), F.count_if(F.col("otd_status") == "ON_TIME").alias("on_time_orders"))
    )
    share = F.lit(100.0).cast("decimal(4,1)") * F.col("on_time_orders") / F.nullif(F.col("total_orders"), F.lit(0))
    current = suppliers.where("is_current").select("supplier_id", "supplier_name")
    before = F.lag("share").over(Window.partitionBy("supplier_id").orderBy("quarter_start"))
    return (
        by_quarter.withColumn("share", share)
        .withColumn("before", before)
        .join(current, "supplier_id")
        .select(
            "supplier_name", "supplier_id", "quarter_start", "total_orders", "on_time_orders",
            F.col("share").cast("decimal(5,2)").alias("otd_pct"),
            (F.col("share") - F.col("before")).cast("decimal(5,2)").alias("otd_pct_qoq_delta"),
        )
        .orderBy("supplier_id", "quarter_start")
    )


def top_suppliers_by_plant(facts: DataFrame, suppliers: DataFrame, plants: DataFrame, as_of: dt.datetime, days: int = 90, top: int = 10) -> DataFrame:
    """The suppliers of greatest delivered quantity in each plant; ties share a rank, without gaps."""
    since = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp")
    recent = facts.where(F.col("otd_status").isin(*SETTLED) & (F.col("expected_date_utc") >= since))
    sums = recent.groupBy("plant_code", "supplier_id").agg(F.sum("delivery_qty").alias("qty"), F.count("*").alias("n"))
    named = sums.join(suppliers.where("is_current").select("supplier_id", "supplier_name"), "supplier_id").join(plants.select("plant_code", "plant_name"), "plant_code")
    totals = named.groupBy("plant_code", "plant_name", "supplier_id", "supplier_name").agg(F.sum("qty").alias("total_qty"), F.sum("n").alias("total_orders"))
    rank = F.dense_rank().over(Window.partitionBy("plant_code").orderBy(F.col("total_qty").desc()))
    return totals.withColumn("rnk", rank).where(F.col("rnk") <= top).orderBy("plant_code", "rnk")

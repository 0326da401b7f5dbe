"""Warehouse facts: partitioned by quarter, spread by a distribution column, with default load times and statistics."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.instants import quarter_start
from ..sources.schemas import FACT_PRODUCTION_ORDER, FACT_SUPPLIER_OTD
from .store import TableStore


@dataclass(frozen=True)
class FactTable:
    name: str
    schema: str
    distribution: str
    quarter_of: str
    statistics: tuple[str, ...] = field(default=())
    default_now: str = "synapse_loaded_at_utc"


PRODUCTION_ORDER = FactTable("dbo.fact_production_order", FACT_PRODUCTION_ORDER, "production_order_id", "posting_ts_utc", ("plant_code", "material_id", "posting_ts_utc", "status"))
SUPPLIER_OTD = FactTable("dbo.fact_supplier_otd", FACT_SUPPLIER_OTD, "supplier_id", "expected_date_utc", ("supplier_id", "expected_date_utc"))


def create_fact(store: TableStore, fact: FactTable, replace: bool = False) -> None:
    """The empty fact table, partitioned by quarter_start; ``replace`` drops an older one first."""
    if replace and store.exists(fact.name):
        store.remove(store._dir(fact.name))
    empty = store.spark.createDataFrame([], fact.schema).withColumn("quarter_start", F.lit(None).cast("date"))
    store.create(fact.name, empty, ["quarter_start"], {"distribution": fact.distribution, "statistics": list(fact.statistics)}, if_absent=True)


def load_fact(store: TableStore, fact: FactTable, rows: DataFrame, at: dt.datetime) -> int:
    """Appends rows, with times cut to seconds, the load time filled in, and the quarter derived."""
    for f in StructType.fromDDL(fact.schema):
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None))
        value = F.col(f.name).cast(f.dataType)
        value = F.date_trunc("second", value) if f.dataType.typeName() == "timestamp" else value
        rows = rows.withColumn(f.name, F.coalesce(value, F.lit(at).cast("timestamp")) if f.name == fact.default_now else value)
    return store.append(fact.name, rows.withColumn("quarter_start", quarter_start(fact.quarter_of)))


def column_statistics(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows, nulls, approximate distinct values, least and greatest of each column, in one pass."""
    aggs = []
    for c in columns:
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.min(F.col(c).cast("string")).alias("least"), F.max(F.col(c).cast("string")).alias("greatest")))
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))

"""Dual-run reconciliation of a legacy and a new table, and the gate for the cut-over."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_hash
from ..plans.store import TableStore
from ..sources.schemas import RECON_RESULTS

RESULTS, SAMPLES = "audit.reconciliation_results", "audit.reconciliation_variance_samples"


@dataclass
class ReconConfig:
    pipeline_name: str
    legacy_table: str
    new_table: str
    business_keys: list[str]
    value_cols: list[str]
    variance_tolerance_pct: float = 0.5


def compared(legacy: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys, both hashes and the variance type (null where the sides agree); null keys never meet."""
    a = legacy.select(*keys, row_hash(values).alias("legacy_hash"))
    b = new.select(*keys, row_hash(values).alias("new_hash"))
    kind = (
        F.when(F.col("new_hash").isNull(), "MISSING_IN_NEW")
        .when(F.col("legacy_hash").isNull(), "MISSING_IN_LEGACY")
        .when(F.col("legacy_hash") != F.col("new_hash"), "VALUE_MISMATCH")
    )
    return a.join(b, keys, "full_outer").withColumn("variance_type", kind)


def variances(legacy: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return compared(legacy, new, keys, values).where(F.col("variance_type").isNotNull())


def summary(classified: DataFrame, pipeline_name: str, run_date: str, tolerance: float = 0.5) -> DataFrame:
    """The one-row result, in one aggregate over the join."""
    counts = classified.agg(F.count("*").alias("total_rows"), F.count("variance_type").alias("variance_rows"))
    pct = F.when(F.col("total_rows") > 0, F.col("variance_rows") * 100.0 / F.col("total_rows")).otherwise(0.0).cast("double")
    return counts.select(F.lit(pipeline_name).alias("pipeline_name"), F.lit(run_date).alias("run_date"), "total_rows", "variance_rows", pct.alias("variance_pct"), F.lit(float(tolerance)).alias("tolerance_pct")).withColumn("within_tolerance", F.col("variance_pct") <= F.col("tolerance_pct"))


def reconcile(store: TableStore, cfg: ReconConfig, run_date: str, samples: int = 500) -> DataFrame:
    """The summary; up to ``samples`` variances, first by key, are appended for triage."""
    both = compared(store.read(cfg.legacy_table), store.read(cfg.new_table), cfg.business_keys, cfg.value_cols)
    found = both.where(F.col("variance_type").isNotNull()).orderBy(*cfg.business_keys).limit(samples)
    found = found.withColumn("pipeline_name", F.lit(cfg.pipeline_name)).withColumn("run_date", F.lit(run_date))
    if store.exists(SAMPLES):
        store.append(SAMPLES, found)
    else:
        store.create(SAMPLES, found)
    return summary(both, cfg.pipeline_name, run_date, cfg.variance_tolerance_pct)


def run_reconciliation(store: TableStore, cfg: ReconConfig, run_date: str) -> DataFrame:
    """Reconciles, and appends the summary to the results that the gate reads."""
    if not store.exists(RESULTS):
        store.create_empty(RESULTS, RECON_RESULTS)
    row = reconcile(store, cfg, run_date)
    store.append(RESULTS, row)
    return store.read(RESULTS).where((F.col("pipeline_name") == cfg.pipeline_name) & (F.col("run_date") == run_date))


def gate(results: DataFrame, pipeline_name: str, days: int = 7, calendar: bool = False) -> DataFrame:
    """One row, ``ready``: whether the last ``days`` results are all there and green.

    ``calendar`` asks for consecutive dates, each green in its last result, not just for so many rows.
    """
    own = results.where(F.col("pipeline_name") == pipeline_name)
    if calendar:
        own = own.groupBy("run_date").agg(F.every("within_tolerance").alias("within_tolerance"))
    last = own.orderBy(F.col("run_date").desc()).limit(days)
    ready = (F.count("*") >= days) & F.coalesce(F.every("within_tolerance"), F.lit(False))
    if calendar:
        ready = ready & (F.datediff(F.max(F.to_date("run_date")), F.min(F.to_date("run_date"))) == days - 1)
    return last.agg(F.coalesce(ready, F.lit(False)).alias("ready"))


def cutover_ready(store: TableStore, pipeline_name: str, consecutive_green_days: int = 7, calendar: bool = False) -> bool:
    if not store.exists(RESULTS):
        return False
    return bool(gate(store.read(RESULTS), pipeline_name, consecutive_green_days, calendar).first().ready)


def today() -> str:
    return dt.datetime.now(dt.timezone.utc).date().isoformat()

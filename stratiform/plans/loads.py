"""The audited loads: incremental orders into silver, the material dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.hashing import add_row_hash
from ..operators.scd import merge_scd2, scd2_bootstrap
from ..operators.transforms import MATERIAL_COLUMNS, flatten_orders, latest_by_key, since_watermark, stamped
from ..sources.readers import read_json
from ..sources.schemas import ORDER_NESTED
from .audit import PipelineRun
from .store import TableStore


def load_orders(store: TableStore, path: str, table: str = "silver.production_order", at: dt.datetime | None = None, compat: str | None = None) -> dict[str, object]:
    """Orders past the watermark are flattened and merged where their hash differs; the new watermark is the
    greatest UTC posting time of the rows that were committed.
    """
    with PipelineRun(store, "bronze_to_silver_production_order", "SAP_S4HANA", "production_order") as run:
        new = since_watermark(read_json(store.spark, path, ORDER_NESTED), run.watermark(), compat)
        flat = flatten_orders(new).where(F.col("production_order_id").isNotNull())
        flat = latest_by_key(flat, ["production_order_id"], [F.col("posting_ts_utc").desc_nulls_last(), F.col("row_hash")])
        flat = stamped(flat, at).persist()
        try:
            if store.exists(table):
                store.merge(table, flat, ["production_order_id"], condition="t.row_hash <> s.row_hash")
            else:
                store.create(table, flat, ["plant_code"])
            rows, last = flat.agg(F.count("*"), F.date_format(F.max("posting_ts_utc"), "yyyy-MM-dd HH:mm:ss")).first()
        finally:
            flat.unpersist()
        run.metric("rows_in", rows)
        run.metric("new_watermark", str(last))
        run.advance_watermark(last)
        return {"rows_in": rows, "watermark": last}


def load_materials(store: TableStore, source: str = "silver.material_master", table: str = "gold.dim_material", at: dt.datetime | None = None) -> dict[str, object]:
    """The material dimension, by hash over its attributes."""
    at = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    with PipelineRun(store, "scd2_dim_material", "SAP_S4HANA", "material_master") as run:
        hashed = add_row_hash(store.read(source).select(*MATERIAL_COLUMNS), [c for c in MATERIAL_COLUMNS if c != "material_id"])
        if store.exists(table):
            merge_scd2(store, table, hashed, ["material_id"], at)
        else:
            store.create(table, scd2_bootstrap(hashed, at))
        run.metric("rows_current", store.read(table).where("is_current").count())
        return dict(run.metrics)

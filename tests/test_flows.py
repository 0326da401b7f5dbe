import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratiform.operators import expectations as ex
from stratiform.operators import transforms
from stratiform.plans import loads, warehouse
from stratiform.plans.audit import PipelineLocked, PipelineRun, locks
from stratiform.plans.jobs import Job
from stratiform.plans.medallion import build
from stratiform.sources import catalogue
from stratiform.sources.readers import kafka_options, read_json, replay_envelopes
from stratiform.sources.schemas import ENVELOPE, TELEMETRY
from stratiform.streaming.telemetry import start_rollup

FIX = Path(__file__).parent / "fixtures"


def _envelopes(spark):
    lines = spark.read.text(f"file://{FIX}/telemetry.json")
    return lines.select(F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.lit(dt.datetime(2026, 5, 6)).alias("timestamp"))


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (60,), (None,)], "v int")
    rules = [ex.expect_or_drop("range", "v BETWEEN 0 AND 50"), ex.expect("small", "v < 10")]
    good, bad, counts = ex.enforce(df, rules)
    assert good.count() == 1 and bad.count() == 2 and counts == {"rows": 3, "range": 2, "small": 2}
    assert bad.first()._violated == ["range"]
    with pytest.raises(ex.ExpectationFailed):
        ex.enforce(df, [ex.expect_or_fail("there", "v IS NOT NULL")])


def test_stream_equals_batch(spark, store, tmp_path, rows):
    _envelopes(spark).repartition(3).write.parquet(f"file://{tmp_path}/in")
    q = start_rollup(store, replay_envelopes(spark, f"file://{tmp_path}/in"), "s.t", f"file://{tmp_path}/cp", "update", every=None)
    q.awaitTermination()
    batch = transforms.rollup(read_json(spark, f"file://{FIX}/telemetry.json", TELEMETRY), max_name="vibration_g_p100")
    cols = ["plant_code", "machine_id", "window_start_utc", "vibration_g_p100", "event_count"]
    assert rows(store.read("s.t").select(*cols)) == rows(batch.select(*cols))


def test_pipeline(spark, store, tmp_path):
    _envelopes(spark).write.parquet(f"file://{tmp_path}/tel")
    orders = tmp_path / "orders"
    orders.mkdir()
    (orders / "1.json").write_text((FIX / "orders.json").read_text())
    p = build(store, f"file://{tmp_path}/tel", f"file://{orders}")
    p.run()
    assert p.read("bronze_cnc_telemetry").count() == 10
    assert p.read("silver_sap_production_order").count() == 5
    assert p.read("silver_dim_material").where("is_current").count() == 4
    more = json.loads((FIX / "orders.json").read_text().splitlines()[0]) | {"production_order_id": "PO-9", "plant_code": "bad"}
    (orders / "2.json").write_text(json.dumps(more) + "\n")
    counts = p.run()
    assert counts["silver_sap_production_order"]["known_plant"] == 1
    assert p.read("silver_sap_production_order").count() == 5
    assert p.read("silver_sap_production_order_quarantine").count() == 1


def test_incremental_orders(spark, store, tmp_path):
    first = loads.load_orders(store, f"file://{FIX}/orders.json")
    assert first == {"rows_in": 5, "watermark": "2026-05-06 00:50:00"}
    assert loads.load_orders(store, f"file://{FIX}/orders.json")["rows_in"] == 0
    assert store.read("silver.production_order").count() == 5


def test_materials(spark, store):
    row = [("M-1", "a", "g", "KG", "1", "A", True, "S")]
    from stratiform.sources.schemas import MATERIAL

    store.create("silver.material_master", spark.createDataFrame(row, MATERIAL))
    loads.load_materials(store, at=dt.datetime(2026, 1, 1))
    store.overwrite("silver.material_master", spark.createDataFrame([("M-1", "b", "g", "KG", "2", "A", True, "S")], MATERIAL))
    assert loads.load_materials(store, at=dt.datetime(2026, 1, 2)) == {"rows_current": 1}
    assert store.read("gold.dim_material").count() == 2


def test_jobs_catalogue_warehouse(spark, store):
    def bad(**_):
        raise ValueError

    got = Job("j", {"x": 1}).task("a", lambda x: x).task("b", bad, ["a"], retries=1).task("c", lambda x: x, ["b"]).run(x=2)
    assert got["a"] == ("done", 2) and got["b"][0] == "failed" and got["c"][0] == "skipped"
    config = catalogue.source_config(spark)
    assert config.count() == 12 and catalogue.ingestion_plan(config).where("reader IS NULL").count() == 0
    landed = spark.createDataFrame([("MES", "work_order", dt.datetime(2026, 1, 1, 0, 30))], "source_system string, entity string, landed_at timestamp")
    late = catalogue.sla_breaches(config, landed, dt.datetime(2026, 1, 1, 1, 0))
    assert late.count() == 11
    warehouse.create_fact(store, warehouse.SUPPLIER_OTD)
    fact = spark.createDataFrame([("S", "P", "M", "1", dt.datetime(2026, 5, 1, 0, 0, 0, 5))], "supplier_id string, plant_code string, material_id string, purchase_order_id string, expected_date_utc timestamp")
    warehouse.load_fact(store, warehouse.SUPPLIER_OTD, fact, dt.datetime(2026, 6, 1))
    row = store.read("dbo.fact_supplier_otd").first()
    assert row.quarter_start == dt.date(2026, 4, 1) and row.synapse_loaded_at_utc == dt.datetime(2026, 6, 1) and row.expected_date_utc.microsecond == 0


def test_kafka_options():
    o = kafka_options("b:9093", "t")
    assert o["maxOffsetsPerTrigger"] == "100000" and o["startingOffsets"] == "latest" and o["kafka.sasl.mechanism"] == "PLAIN"
    assert ENVELOPE.startswith("key binary")


def test_watermark_metric(store):
    loads.load_orders(store, f"file://{FIX}/orders.json")
    run = store.read("audit.pipeline_run").where("status = 'SUCCESS'").first()
    assert json.loads(run.metrics_json) == {"rows_in": 5, "new_watermark": "2026-05-06 00:50:00"}


def test_stale_lock_changes_hands(store):
    """A run whose lock was taken over doesn't remove the new holder's."""
    old = PipelineRun(store, "p", "s", "e")
    with pytest.raises(PipelineLocked):
        with old:
            with PipelineRun(store, "p", "s", "e", stale_after=-1):
                old._release()
                assert [r.pipeline_name for r in locks(store).collect()] == ["p"]
                with PipelineRun(store, "p", "s", "e"):
                    pass
    assert locks(store).count() == 0

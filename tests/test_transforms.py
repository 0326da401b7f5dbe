import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from stratiform.functions.hashing import add_row_hash
from stratiform.operators import scd, transforms
from stratiform.sources.readers import jdbc_query, read_json, read_rescued_csv, read_rescued_json, registered_schema
from stratiform.sources.schemas import ORDER_NESTED, TELEMETRY

HERE = f"file://{Path(__file__).parent}/fixtures"


def test_row_hash(spark):
    df = spark.createDataFrame([("M-001", "AERO-FRAME", "KG"), ("M-001", None, "KG"), ("M-001", "", "KG")], "material_id string, desc string, uom string")
    a = [r.row_hash for r in add_row_hash(df, ["material_id", "desc", "uom"]).collect()]
    b = [r.row_hash for r in add_row_hash(df, ["uom", "material_id", "desc"]).collect()]
    assert a == b and len(set(a)) == 3 and all(len(x) == 64 for x in a)
    clash = spark.createDataFrame([("a||b", "c"), ("a", "b||c")], "x string, y string")
    assert add_row_hash(clash, ["x", "y"]).select("row_hash").distinct().count() == 1
    assert add_row_hash(clash, ["x", "y"], escape=True).select("row_hash").distinct().count() == 2


def _silver(spark):
    return transforms.rollup(read_json(spark, f"{HERE}/telemetry.json", TELEMETRY))


def test_rollup_and_gold(spark, rows):
    got = {(r.machine_id, r.window_start_utc.minute): (round(r.vibration_g_avg, 4), r.vibration_g_p95, r.vibration_g_max, r.event_count) for r in _silver(spark).collect()}
    assert got[("CNC-HYD1-A07", 0)] == (0.46, 0.51, 0.51, 3)
    assert got[("CNC-HYD1-A07", 1)] == (1.005, 1.08, 1.08, 2)
    assert len(got) == 6
    orders = transforms.flatten_orders(read_json(spark, f"{HERE}/orders.json", ORDER_NESTED))
    gold = transforms.gold_oee(_silver(spark), orders).collect()
    assert len(gold) == 7
    a07 = [r for r in gold if r.machine_id == "CNC-HYD1-A07"]
    assert {r.active_production_order_id for r in a07} == {"PO-100001", "PO-100003"}
    assert round(a07[0].vibration_g_5m_avg, 4) == 0.7325 and a07[0].event_count_5m == 5
    weighted = transforms.gold_oee(_silver(spark), orders, weighted=True).where("machine_id = 'CNC-HYD1-A07'").first()
    assert round(weighted.vibration_g_5m_avg, 3) == 0.678
    assert transforms.gold_oee(_silver(spark), orders, as_of_order=True).count() == 5


def test_orders_to_utc(spark):
    got = {r.production_order_id: (r.posting_ts_utc, r.item_count) for r in transforms.flatten_orders(read_json(spark, f"{HERE}/orders.json", ORDER_NESTED)).collect()}
    assert got["PO-100001"] == (dt.datetime(2026, 5, 5, 4, 0), 2)
    assert got["PO-100004"] == (dt.datetime(2026, 5, 5, 21, 15), 1)
    bad = spark.createDataFrame([("x", "Asia/Kolkata")], "posting_date_local string, plant_timezone string")
    from stratiform.functions.instants import utc_from_local

    assert bad.select(utc_from_local("posting_date_local", "plant_timezone").alias("t")).first().t is None


def test_changes(spark, rows):
    orders = transforms.flatten_orders(read_json(spark, f"{HERE}/orders.json", ORDER_NESTED)).select("material_id", "uom", "status", "posting_ts_utc", "quantity")
    for df in (orders, orders.orderBy(F.col("posting_ts_utc").desc())):
        got = scd.apply_changes(df, ["material_id"], "posting_ts_utc", ["uom", "status"])
        assert got.count() == 5 and got.where("is_current").count() == 4
        frame = got.where("material_id = 'M-AERO-FRAME-A320'").orderBy("effective_from").collect()
        assert frame[0].effective_to == frame[1].effective_from == dt.datetime(2026, 5, 5, 8, 30)
    assert scd.apply_changes(orders, ["material_id"], "posting_ts_utc", scd_type=1).count() == 4


def test_otd_from_dispatch(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "purchase_order_id,supplier_id,material_id,plant_code,expected_delivery_ts_utc,actual_delivery_ts_utc,delivery_qty,required_qty\n"
        "1,S,M,P,2026-05-01T10:00:00Z,2026-05-01T09:45:00Z,5,5\n2,S,M,P,2026-05-01T10:00:00Z,,0,5\n3,S,M,P,2026-05-01T10:00:00Z,2026-05-01T10:10:00Z,x,5\n"
    )
    from stratiform.sources.schemas import SUPPLIER_DISPATCH

    df = read_rescued_csv(spark, f"file://{tmp_path}/d.csv", SUPPLIER_DISPATCH, stream=False)
    assert [r.purchase_order_id for r in df.where("_rescued_data IS NOT NULL").collect()] == ["3"]
    got = {r.purchase_order_id: (r.otd_status, r.delay_seconds) for r in transforms.derive_otd(df).collect()}
    assert got == {"1": ("ON_TIME", -900), "2": ("PENDING", None), "3": ("LATE", 600)}


def test_readers(spark, tmp_path):
    assert jdbc_query("dbo.t") == "SELECT * FROM dbo.t WHERE 1=1"
    assert jdbc_query("t", "c", "o'k") == "SELECT * FROM t WHERE c > 'o''k'"
    (tmp_path / "a.json").write_text('{"k":1}\n{"k":2,"z":3}\nnot json\n')
    got = read_rescued_json(spark, f"file://{tmp_path}/a.json", "k int").collect()
    assert [(r.k, r._rescued_data is not None) for r in got] == [(1, False), (2, True), (None, True)]
    loc = f"file://{tmp_path}/schema"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"k":1}\n')
    assert registered_schema(spark, f"file://{tmp_path}/in", loc).names == ["k"]
    (tmp_path / "in" / "2.json").write_text('{"k":1,"m":"x"}\n')
    assert registered_schema(spark, f"file://{tmp_path}/in", loc).names == ["k", "m"]

import os

import pytest
from pyspark.sql import functions as F

from stratiform.operators import transforms
from stratiform.operators.transforms import gold_oee
from stratiform.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_active_order_meets_its_plant(spark):
    import duckdb

    db = duckdb.connect()
    orders = f"(SELECT o_orderkey::VARCHAR AS id, 'NAT-' || c_nationkey AS plant FROM '{DATA}/orders.parquet' JOIN '{DATA}/customer.parquet' ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O'))"
    active = dict(db.sql(f"SELECT id, plant FROM {orders}").fetchall())
    five = f"(SELECT DISTINCT 'NAT-' || event_id % 25 AS plant, user_id, time_bucket(INTERVAL 5 MINUTE, ts) FROM '{DATA}/events.parquet')"
    want = dict(db.sql(f"SELECT plant, count(*) FROM {five} JOIN {orders} USING (plant) GROUP BY ALL").fetchall())
    gold = QUERIES["gold_oee_5min"](spark, DATA)
    got = {r.plant_code: r.n for r in gold.where("active_production_order_id IS NOT NULL").groupBy("plant_code").agg(F.count("*").alias("n")).collect()}
    assert len(active) > 900 and got == want
    pairs = gold.select("active_production_order_id", "plant_code").distinct().where("active_production_order_id IS NOT NULL").collect()
    assert {r.active_production_order_id: r.plant_code for r in pairs} == active


def test_a_plants_rows_are_dealt_over_tasks(spark):
    """One plant of many buckets and few bytes: its rows are the whole product, and not one task's."""
    silver = spark.range(600).selectExpr("if(id < 590, 'P', 'Q') AS plant_code", "cast(id % 7 as string) AS machine_id", "timestamp_seconds(id * 300) AS window_start_utc", "id / 3 AS vibration_g_avg", "id / 2 AS vibration_g_max", "id AS event_count")
    orders = spark.range(51).selectExpr("if(id < 50, 'P', 'R') AS plant_code", "cast(id as string) AS production_order_id", "cast(id % 5 as string) AS material_id", "timestamp_seconds(id) AS posting_ts_utc", "if(id < 40, 'REL', 'CRT') AS status")
    gold = gold_oee(silver, orders)
    rows = [(r.plant_code, r.window_start_utc.timestamp(), r.active_production_order_id, r.material_id) for r in gold.collect()]
    want = [("P", 300.0 * i, str(k), str(k % 5)) for i in range(590) for k in range(40)] + [("Q", 300.0 * i, None, None) for i in range(590, 600)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    tasks = [r["count"] for r in gold.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < 0.6 * len(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_figures_are_rounded_before_orders_multiply_them(spark):
    plan = QUERIES["gold_oee_5min"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and "round(" not in plan[: plan.index("Join LeftOuter")]


def _plants(spark, buckets: int, orders: int):
    """Buckets of plants P and (each tenth) Q and one without a plant, and orders of P and of R, some of them not active."""
    silver = spark.range(buckets).selectExpr("if(id = 3, NULL, if(id % 10 > 0, 'P', 'Q')) AS plant_code", "cast(id % 7 as string) AS machine_id", "timestamp_seconds(id * 300) AS window_start_utc", "id / 3 AS vibration_g_avg", "id / 2 AS vibration_g_max", "id AS event_count")
    made = spark.range(orders).selectExpr("if(id % 11 > 0, 'P', 'R') AS plant_code", "cast(id as string) AS production_order_id", "cast(id * 17 % 500 as string) AS material_id", "timestamp_seconds(id) AS posting_ts_utc", "if(id % 5 > 0, 'REL', 'CRT') AS status")
    return silver, made


def test_blocks_hold_each_pair_once(spark, monkeypatch):
    """Many blocks of both sides, with rests: nothing lost, nothing twice, nulls where there are no orders."""
    monkeypatch.setattr(transforms, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(transforms, "ORDER_BLOCK", 7)
    rows = [(r.plant_code, r.window_start_utc.timestamp(), r.machine_id, r.event_count_5m, r.active_production_order_id, r.material_id) for r in gold_oee(*_plants(spark, 500, 60)).collect()]
    active = [k for k in range(60) if k % 11 and k % 5]
    want = []
    for i in range(500):
        plant = None if i == 3 else "P" if i % 10 else "Q"
        want += [(plant, 300.0 * i, str(i % 7), i, *x) for x in ([(str(k), str(k * 17 % 500)) for k in active] if plant == "P" else [(None, None)])]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_the_product_is_small_on_disk(spark, tmp_path):
    """Many orders of a plant: rows of two columns that change from row to row take well under a byte when written."""
    gold_oee(*_plants(spark, 120, 12_000)).write.parquet(f"file://{tmp_path}/out")
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.8 * spark.read.parquet(f"file://{tmp_path}/out").count()


def test_orders_are_copied_in_blocks(spark):
    """What is copied for the parts of a plant's buckets are blocks of orders, not orders."""
    gold = gold_oee(*_plants(spark, 50, 6_000))
    plan = gold._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan[plan.index("Generate explode(") :]
    assert gold.count() == 44 * sum(1 for k in range(6_000) if k % 11 and k % 5) + 6

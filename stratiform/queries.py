"""The registered queries of the medallion operators, and their DuckDB SQL.

Every query runs over its whole tables. Times leave as TIMESTAMP_NTZ, so both engines show the same type;
floating averages are rounded, since their sums come in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import add_row_hash
from .functions.instants import bucket_start, item_count, utc_from_local
from .operators import analytics, expectations, reconcile, scd, transforms
from .plans.store import merged
from .sources import catalogue
from .sources import testdata as td

NTZ = "timestamp_ntz"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


# Relations of the oracle, as common table expressions.
PLANT = "upper(substr(n_name, 1, 3)) || '-' || n_nationkey"
FACTS = f"""facts AS (
    SELECT l_suppkey AS supplier_id, {PLANT} AS plant_code, l_quantity::DECIMAL(18,3) AS delivery_qty,
           o_orderdate + INTERVAL 30 DAY AS expected, CASE WHEN l_linestatus <> 'O' THEN l_shipdate END AS actual
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
otd AS (SELECT *, CASE WHEN actual IS NULL THEN 'PENDING' WHEN actual <= expected THEN 'ON_TIME' ELSE 'LATE' END AS otd_status FROM facts)"""
ORDERS = f"""po AS (
    SELECT o_orderkey::VARCHAR AS production_order_id, {PLANT} AS plant_code,
           CASE r_name WHEN 'ASIA' THEN 'Asia/Kolkata' WHEN 'EUROPE' THEN 'Europe/Paris' WHEN 'AMERICA' THEN 'America/New_York' WHEN 'AFRICA' THEN 'Africa/Lagos' ELSE 'Asia/Dubai' END AS plant_timezone,
           (o_custkey % 500)::VARCHAR AS material_id, round(o_totalprice % 1000, 2) AS quantity, o_orderpriority AS uom,
           date_trunc('second', o_orderdate) AS posting_local, c_mktsegment AS created_by,
           CASE o_orderstatus WHEN 'F' THEN 'CNF' WHEN 'O' THEN 'REL' WHEN 'P' THEN 'CRT' ELSE o_orderstatus END AS status,
           c_custkey::VARCHAR AS customer_id, c_name AS customer_name, r_name AS customer_region, coalesce(n, -1)::INTEGER AS item_count
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey)"""
POSTED = "timezone('UTC', timezone(plant_timezone, posting_local))"
TELEMETRY = """tel AS (
    SELECT event_type AS plant_code, user_id::VARCHAR AS machine_id, ts AS event_ts, value AS vibration_g,
           json_extract(props, '$.k')::DOUBLE AS temperature_c, (event_id % 1000)::DOUBLE AS spindle_rpm FROM events)"""
MINUTE = """minute AS (
    SELECT plant_code, machine_id, time_bucket(INTERVAL 1 MINUTE, event_ts) AS w, avg(vibration_g) AS a, quantile_disc(vibration_g, 0.95) AS p,
           max(vibration_g) AS m, avg(temperature_c) AS t, avg(spindle_rpm) AS r, count(*) AS n
    FROM tel WHERE plant_code IS NOT NULL AND machine_id IS NOT NULL AND event_ts IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {FACTS}, q AS (
    SELECT supplier_id, date_trunc('quarter', expected)::DATE AS quarter_start, count(*) AS total_orders,
           sum(CASE WHEN otd_status = 'ON_TIME' THEN 1 ELSE 0 END)::BIGINT AS on_time_orders
    FROM otd WHERE otd_status IN ('ON_TIME', 'LATE') AND expected >= TIMESTAMP '2001-08-01' - INTERVAL 24 MONTH GROUP BY ALL),
s AS (SELECT *, 100.0 * on_time_orders / nullif(total_orders, 0) AS share, lag(100.0 * on_time_orders / nullif(total_orders, 0)) OVER (PARTITION BY supplier_id ORDER BY quarter_start) AS before FROM q)
SELECT s_name AS supplier_name, supplier_id, quarter_start, total_orders, on_time_orders, share::DECIMAL(5,2) AS otd_pct, (share - before)::DECIMAL(5,2) AS otd_pct_qoq_delta
FROM s JOIN supplier ON supplier_id = s_suppkey""")
def otd_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return analytics.otd_trend(td.otd_facts(spark, sf_dir), td.suppliers(spark, sf_dir), td.AS_OF)


@query(f"""WITH {FACTS}, r AS (
    SELECT plant_code, supplier_id, sum(delivery_qty)::DECIMAL(38,3) AS total_qty, count(*) AS total_orders,
           dense_rank() OVER (PARTITION BY plant_code ORDER BY sum(delivery_qty) DESC)::INTEGER AS rnk
    FROM otd WHERE otd_status IN ('ON_TIME', 'LATE') AND expected >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY GROUP BY plant_code, supplier_id)
SELECT plant_code, n_name AS plant_name, supplier_id, s_name AS supplier_name, total_qty, total_orders, rnk
FROM r JOIN supplier ON supplier_id = s_suppkey JOIN nation ON plant_code = {PLANT} WHERE rnk <= 10""")
def top_suppliers_by_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    top = analytics.top_suppliers_by_plant(td.otd_facts(spark, sf_dir), td.suppliers(spark, sf_dir), td.plants(spark, sf_dir), td.AS_OF)
    return top.withColumn("total_qty", F.col("total_qty").cast("decimal(38,3)"))


def _minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return transforms.rollup(td.telemetry(spark, sf_dir).where("plant_code IS NOT NULL AND machine_id IS NOT NULL"))


def _shown(df: DataFrame) -> DataFrame:
    out = [F.round(c, 6).alias(c) if kind == "double" else F.col(c).cast(NTZ).alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes]
    return df.select(*out)


MINUTE_OUT = "SELECT plant_code, machine_id, w AS window_start_utc, w + INTERVAL 1 MINUTE AS window_end_utc, round(a, 6) AS vibration_g_avg, round(p, 6) AS vibration_g_p95, round(m, 6) AS vibration_g_max, round(t, 6) AS temperature_c_avg, round(r, 6) AS spindle_rpm_avg, n AS event_count FROM minute"


@query(f"WITH {TELEMETRY}, {MINUTE} {MINUTE_OUT}")
def telemetry_1min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_minute(spark, sf_dir))


RULES = [
    expectations.expect_or_fail("non_null_machine", "plant_code IS NOT NULL AND machine_id IS NOT NULL"),
    expectations.expect_or_drop("vibration_in_range", "vibration_g_avg BETWEEN 0 AND 50"),
    expectations.expect("event_count_positive", "event_count > 0"),
]


@query(f"WITH {TELEMETRY}, {MINUTE} {MINUTE_OUT} WHERE a BETWEEN 0 AND 50")
def telemetry_1min_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(expectations.split(_minute(spark, sf_dir), RULES)[0])


@query(f"WITH {TELEMETRY}, {MINUTE} SELECT count(*) AS rows, count(*) FILTER (machine_id IS NULL) AS non_null_machine, count(*) FILTER (NOT coalesce(a BETWEEN 0 AND 50, false)) AS vibration_in_range, count(*) FILTER (n <= 0) AS event_count_positive FROM minute")
def expectation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectations.violations(_minute(spark, sf_dir), RULES)


@query(f"WITH {TELEMETRY}, {MINUTE} SELECT plant_code, machine_id, w AS window_start_utc FROM minute WHERE NOT coalesce(a BETWEEN 0 AND 50, false)")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = expectations.split(_minute(spark, sf_dir), RULES)[1]
    return bad.select("plant_code", "machine_id", F.col("window_start_utc").cast(NTZ).alias("window_start_utc"))


def _plant_of_event(df: DataFrame) -> DataFrame:
    """Events dealt evenly over the orders' 25 plants (NAT-0 to NAT-24), so the gold join has partners everywhere."""
    return df.withColumn("plant_code", F.concat(F.lit("NAT-"), F.pmod(F.col("spindle_rpm").cast("int"), F.lit(25)).cast("string")))


def _gold_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One-minute figures by the orders' plants, and the orders."""
    _utc(spark)
    events = td.telemetry(spark, sf_dir).where("plant_code IS NOT NULL AND machine_id IS NOT NULL")
    return transforms.rollup(_plant_of_event(events)), transforms.normalise_orders(td.orders(spark, sf_dir))


@query()  # one row for each bucket and active order: millions at sf0.01, so tests compare it on the smallest tables
def gold_oee_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver, orders = _gold_inputs(spark, sf_dir)
    return transforms.with_active_orders(_shown(transforms.with_window(transforms.five_minutes(silver))), orders)


@query(f"""WITH {TELEMETRY}, spread AS (SELECT * REPLACE ('NAT-' || (spindle_rpm::INTEGER % 25) AS plant_code) FROM tel WHERE plant_code IS NOT NULL), {MINUTE.replace("FROM tel", "FROM spread")}, {ORDERS},
five AS (SELECT plant_code, machine_id, time_bucket(INTERVAL 5 MINUTE, w) AS b, avg(a) AS a, max(m) AS m, sum(n)::BIGINT AS n FROM minute GROUP BY ALL),
active AS (SELECT plant_code, count(*) AS orders, min(production_order_id) AS first_order, max(production_order_id) AS last_order, count(DISTINCT material_id) AS materials FROM po WHERE status IN ('REL', 'CNF') GROUP BY ALL)
SELECT five.plant_code, machine_id, b AS window_start_utc, b + INTERVAL 5 MINUTE AS window_end_utc, round(a, 6) AS vibration_g_5m_avg, round(m, 6) AS vibration_g_5m_max, n AS event_count_5m,
       coalesce(orders, 0) AS active_orders, first_order, last_order, coalesce(materials, 0) AS active_materials
FROM five LEFT JOIN active USING (plant_code)""")
def gold_oee_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(transforms.gold_oee(*_gold_inputs(spark, sf_dir), together=True))


@query(f"WITH {TELEMETRY} SELECT plant_code, machine_id, event_ts, vibration_g, temperature_c, spindle_rpm, event_ts AS kafka_ingest_ts FROM tel WHERE plant_code IS NOT NULL AND machine_id IS NOT NULL")
def parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.readers import payloads

    _utc(spark)
    out = transforms.parse_telemetry(payloads(td.envelopes(spark, sf_dir)))
    return out.select("plant_code", "machine_id", F.col("event_ts").cast(NTZ).alias("event_ts"), "vibration_g", "temperature_c", "spindle_rpm", F.col("kafka_ingest_ts").cast(NTZ).alias("kafka_ingest_ts"))


ORDER_HASH = "sha256(concat_ws('||', production_order_id, plant_code, material_id, coalesce(quantity::DECIMAL(18,2)::VARCHAR, chr(0)), status))"


def _decimal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as decimals: engines write floating numbers differently."""
    return td.orders(spark, sf_dir).withColumn("quantity", F.col("quantity").cast("decimal(18,2)"))


@query(f"WITH {ORDERS} SELECT production_order_id, plant_code, plant_timezone, material_id, quantity::DECIMAL(18,2) AS quantity, uom, created_by, status, {POSTED} AS posting_ts_utc, {ORDER_HASH} AS row_hash FROM po")
def order_utc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    out = transforms.normalise_orders(_decimal_orders(spark, sf_dir).drop("customer", "items"))
    return out.withColumn("posting_ts_utc", F.col("posting_ts_utc").cast(NTZ))


SILVER_HASH = "sha256(concat_ws('||', " + ", ".join(f"coalesce({c}, chr(0))" for c in ("customer_id", "item_count::VARCHAR", "material_id", "plant_code", f"strftime({POSTED}, '%Y-%m-%d %H:%M:%S')", "production_order_id", "quantity::DECIMAL(18,2)::VARCHAR", "status", "uom")) + "))"


@query(f"WITH {ORDERS} SELECT production_order_id, plant_code, customer_id, customer_name, customer_region, item_count, {POSTED} AS posting_ts_utc, {SILVER_HASH} AS row_hash FROM po")
def order_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    flat = transforms.flatten_orders(_decimal_orders(spark, sf_dir))
    return flat.select("production_order_id", "plant_code", "customer_id", "customer_name", "customer_region", "item_count", F.col("posting_ts_utc").cast(NTZ).alias("posting_ts_utc"), "row_hash")


@query(f"WITH {ORDERS} SELECT production_order_id, plant_code FROM po WHERE regexp_matches(plant_code, '^[A-Z]{{3}}-[0-9]+$')")
def known_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    rule = expectations.expect_or_drop("known_plant", "plant_code RLIKE '^[A-Z]{3}-[0-9]+$'")
    return expectations.split(td.orders(spark, sf_dir).select("production_order_id", "plant_code"), [rule])[0]


@query(f"WITH {ORDERS} SELECT count(*) AS rows, count(*) FILTER (NOT coalesce({POSTED} <= TIMESTAMP '2001-01-01' + INTERVAL 7 DAY, false)) AS future_posting_warn FROM po")
def future_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    posted = td.orders(spark, sf_dir).select(utc_from_local("posting_date_local", "plant_timezone").alias("posting_ts_utc"))
    return expectations.violations(posted, [expectations.expect("future_posting_warn", "posting_ts_utc <= TIMESTAMP '2001-01-01' + INTERVAL 7 DAYS")])


@query("SELECT o_orderkey, sha256(concat_ws('||', coalesce(o_custkey::VARCHAR, chr(0)), coalesce(o_orderpriority, chr(0)), coalesce(o_orderstatus, chr(0)))) AS row_hash FROM orders")
def row_hash_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_row_hash(td.load(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey", "o_orderpriority"]).select("o_orderkey", "row_hash")


@query(f"WITH {ORDERS} SELECT production_order_id, {ORDER_HASH} AS row_hash FROM po")
def row_hash_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return transforms.normalise_orders(_decimal_orders(spark, sf_dir)).select("production_order_id", "row_hash")


RECON = """a AS (SELECT o_orderkey AS k, sha256(concat_ws('||', o_custkey::VARCHAR, o_orderpriority, o_orderstatus)) AS legacy_hash FROM orders WHERE o_orderkey % 50 <> 1),
b AS (SELECT o_orderkey AS k, sha256(concat_ws('||', o_custkey::VARCHAR, o_orderpriority, CASE WHEN o_orderkey % 100 = 3 THEN 'X' ELSE o_orderstatus END)) AS new_hash FROM orders WHERE o_orderkey % 40 <> 2),
v AS (SELECT coalesce(a.k, b.k) AS o_orderkey, legacy_hash, new_hash, CASE WHEN new_hash IS NULL THEN 'MISSING_IN_NEW' WHEN legacy_hash IS NULL THEN 'MISSING_IN_LEGACY' WHEN legacy_hash <> new_hash THEN 'VALUE_MISMATCH' END AS variance_type FROM a FULL JOIN b ON a.k = b.k)"""
VALUES = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"WITH {RECON} SELECT * FROM v WHERE variance_type IS NOT NULL")
def recon_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.variances(*td.legacy_and_new(spark, sf_dir), ["o_orderkey"], VALUES)


@query(f"WITH {RECON} SELECT 'orders' AS pipeline_name, '2001-08-01' AS run_date, count(*) AS total_rows, count(variance_type) AS variance_rows, count(variance_type) * 100.0::DOUBLE / count(*) AS variance_pct, 0.5::DOUBLE AS tolerance_pct, count(variance_type) * 100.0::DOUBLE / count(*) <= 0.5 AS within_tolerance FROM v")
def recon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reconcile.compared(*td.legacy_and_new(spark, sf_dir), ["o_orderkey"], VALUES)
    return reconcile.summary(both, "orders", "2001-08-01")


@query("WITH d AS (SELECT o_orderdate::DATE::VARCHAR AS run_date, avg(o_totalprice) < 260000 AS ok FROM orders GROUP BY ALL), l AS (SELECT * FROM d ORDER BY run_date DESC LIMIT 7) SELECT count(*) >= 7 AND bool_and(ok) AS ready FROM l")
def cutover_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = td.load(spark, sf_dir, "orders")
    days = o.groupBy(F.to_date("o_orderdate").cast("string").alias("run_date")).agg((F.avg("o_totalprice") < 260000).alias("within_tolerance"))
    return reconcile.gate(days.withColumn("pipeline_name", F.lit("orders")), "orders")


DAY = ["SELECT p_partkey AS material_id, p_name AS material_description, p_type AS material_group, p_size AS size FROM part WHERE p_partkey % 7 <> 5", "SELECT p_partkey AS material_id, p_name AS material_description, p_type AS material_group, (CASE WHEN p_partkey % 10 = 3 THEN p_size + 1 ELSE p_size END)::INTEGER AS size FROM part"]


def _hashed(df: DataFrame) -> DataFrame:
    return add_row_hash(df, [c for c in df.columns if c != "material_id"])


@query(f"SELECT d2.material_id, d2.material_description, d2.material_group, d2.size, CASE WHEN d1.material_id IS NULL THEN 'new' WHEN d1.size <> d2.size THEN 'changed' ELSE 'old' END AS origin FROM ({DAY[1]}) d2 LEFT JOIN ({DAY[0]}) d1 USING (material_id)")
def merge_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _hashed(td.materials(spark, sf_dir)).withColumn("origin", F.lit("old"))
    new = _hashed(td.materials(spark, sf_dir, 2)).withColumn("origin", F.lit("new"))
    out = merged(old, new, ["material_id"], {**{c: f"s.{c}" for c in new.columns}, "origin": "'changed'"}, "t.row_hash <> s.row_hash")
    return out.drop("row_hash")


@query(DAY[1])
def merge_scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd.scd1(td.materials(spark, sf_dir), td.materials(spark, sf_dir, 2), ["material_id"])


@query(f"SELECT d1.material_id, d1.size, CASE WHEN d1.size <> d2.size THEN TIMESTAMP '2001-08-01' END AS effective_to, d1.size = d2.size AS is_current FROM ({DAY[0]}) d1 JOIN ({DAY[1]}) d2 USING (material_id)")
def merge_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _hashed(td.materials(spark, sf_dir)).withColumns({"effective_to": F.lit(None).cast(NTZ), "is_current": F.lit(True)})
    new = _hashed(td.materials(spark, sf_dir, 2))
    out = merged(old, new, ["material_id"], {"effective_to": "TIMESTAMP_NTZ '2001-08-01 00:00:00'", "is_current": "false"}, "t.is_current AND t.row_hash <> s.row_hash", insert=False)
    return out.select("material_id", "size", "effective_to", "is_current")


@query(f"SELECT *, TIMESTAMP '2001-07-01' AS effective_from, NULL::TIMESTAMP AS effective_to, true AS is_current FROM ({DAY[0]})")
def scd2_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return _shown(scd.scd2_bootstrap(td.materials(spark, sf_dir), F.lit("2001-07-01").cast("timestamp")))


@query(f"""WITH d1 AS ({DAY[0]}), d2 AS ({DAY[1]})
SELECT d1.material_id, d1.size, TIMESTAMP '2001-07-01' AS effective_from, CASE WHEN d1.size <> d2.size THEN TIMESTAMP '2001-08-01' END AS effective_to, d1.size = d2.size AS is_current FROM d1 JOIN d2 USING (material_id)
UNION ALL SELECT d2.material_id, d2.size, TIMESTAMP '2001-08-01', NULL, true FROM d2 LEFT JOIN d1 USING (material_id) WHERE d1.material_id IS NULL OR d1.size <> d2.size""")
def scd2_second_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    first = scd.scd2_bootstrap(_hashed(td.materials(spark, sf_dir)), F.lit("2001-07-01").cast("timestamp"))
    out = scd.scd2(first, _hashed(td.materials(spark, sf_dir, 2)), ["material_id"], F.lit("2001-08-01").cast("timestamp"))
    return _shown(out.select("material_id", "size", "effective_from", "effective_to", "is_current"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders),
c AS (SELECT *, CASE WHEN lag(o_orderdate) OVER w IS NULL OR o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN 1 ELSE 0 END AS ch FROM d WHERE rn = 1 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT o_custkey AS material_id, run, min(o_orderdate) AS effective_from, arg_max_null(o_orderstatus, o_orderdate) AS status, arg_max_null(o_orderpriority, o_orderdate) AS note, arg_max_null(o_orderkey, o_orderdate) AS order_key FROM r GROUP BY ALL)
SELECT material_id, status, note, order_key, effective_from, lead(effective_from) OVER v AS effective_to, lead(effective_from) OVER v IS NULL AS is_current FROM g WINDOW v AS (PARTITION BY material_id ORDER BY effective_from)""")
def cdc_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = td.material_changes(spark, sf_dir)
    return scd.apply_changes(changes, ["material_id"], "posting_ts", ["status"], [F.col("order_key").desc()])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def lock_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = td.load(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return td.load(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"WITH {ORDERS}, p AS (SELECT {POSTED} AS posted FROM po) SELECT count(*) AS rows_in, strftime(max(posted), '%Y-%m-%d %H:%M:%S') AS watermark FROM p WHERE posted > TIMESTAMP '2000-01-01'")
def watermark_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    new = transforms.flatten_orders(transforms.since_watermark(td.orders(spark, sf_dir), "2000-01-01 00:00:00"))
    return new.agg(F.count("*").alias("rows_in"), F.date_format(F.max("posting_ts_utc"), "yyyy-MM-dd HH:mm:ss").alias("watermark"))


@query("SELECT epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def five_minute_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return td.load(spark, sf_dir, "events").groupBy(bucket_start(F.col("ts").cast("timestamp"), 300).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, coalesce(n, -1)::INTEGER AS items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey")
def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = td.load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("items"))
    return td.load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", item_count("items").alias("items"))


def _store(spark: SparkSession):
    from .plans.store import TableStore

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="stratiform-store-")
    import uuid

    return TableStore(spark, f"{root.rstrip('/')}/store-{uuid.uuid4().hex}")


def _stream(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    from .sources.readers import replay_envelopes, replayed_by_name
    from .streaming.telemetry import start_rollup

    _utc(spark)
    store = _store(spark)
    files = f"{store.root}/replay"
    td.envelopes(spark, sf_dir).repartitionByRange(4, "timestamp").write.parquet(files)
    replayed_by_name(spark, files)
    query = start_rollup(store, replay_envelopes(spark, files), "silver.telemetry", f"{store.root}/checkpoint", mode, every=None, watermark="3650 days" if mode == "update" else "10 minutes")
    query.awaitTermination()
    return _shown(store.read("silver.telemetry").drop("ingested_at")).withColumnRenamed("vibration_g_p100", "vibration_g_max")


@query(f"WITH {TELEMETRY}, {MINUTE} {MINUTE_OUT}")
def stream_rollup_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "update")


@query()
def stream_rollup_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "append")


@query()
def csv_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.readers import read_rescued_csv

    root = _store(spark).root
    s = td.load(spark, sf_dir, "supplier")
    s.select(F.concat_ws(",", "s_suppkey", "s_name", F.when(F.col("s_suppkey") % 10 == 3, "bad").otherwise(F.col("s_acctbal").cast("string"))).alias("s_suppkey,s_name,s_acctbal")).write.option("quote", "").text(f"{root}/csv")
    lines = spark.read.text(f"{root}/csv")
    lines.withColumn("h", F.lit(None)).drop("h").write.text(f"{root}/plain")
    return read_rescued_csv(spark, f"{root}/plain", "s_suppkey long, s_name string, s_acctbal double", stream=False)


@query()
def json_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.readers import registered_schema

    root = _store(spark).root
    s = td.load(spark, sf_dir, "supplier")
    s.select("s_suppkey", "s_name").write.json(f"{root}/json/a")
    registered_schema(spark, f"{root}/json/*", f"{root}/schema")
    s.select("s_suppkey", "s_name", "s_acctbal").write.json(f"{root}/json/b")
    grown = registered_schema(spark, f"{root}/json/*", f"{root}/schema")
    return spark.read.schema(grown).json(f"{root}/json/*")


@query()
def pipeline_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.medallion import build

    _utc(spark)
    store = _store(spark)
    td.envelopes(spark, sf_dir).write.parquet(f"{store.root}/landing/telemetry")
    td.orders(spark, sf_dir).drop("customer", "items").write.json(f"{store.root}/landing/orders")
    p = build(store, f"{store.root}/landing/telemetry", f"{store.root}/landing/orders")
    p.run()
    counts = [store.read(p.full(n)).agg(F.lit(n).alias("node"), F.count("*").alias("rows")) for n in p.order()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query()
def audit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.audit import RUNS
    from .plans.loads import load_orders

    _utc(spark)
    store = _store(spark)
    td.orders(spark, sf_dir).write.json(f"{store.root}/landing")
    load_orders(store, f"{store.root}/landing")
    load_orders(store, f"{store.root}/landing")
    return store.read(RUNS).select("pipeline_name", "status", F.get_json_object("metrics_json", "$.rows_in").alias("rows_in"))


@query()
def ingestion_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = catalogue.source_config(spark)
    landed = catalogue.ingestion_plan(config).select("source_system", "entity", (F.lit(td.AS_OF).cast("timestamp") - F.make_dt_interval(mins=F.col("source_id") * 10)).alias("landed_at"))
    return catalogue.sla_breaches(config, landed, td.AS_OF)


@query()
def warehouse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import warehouse

    _utc(spark)
    store = _store(spark)
    warehouse.create_fact(store, warehouse.SUPPLIER_OTD)
    warehouse.load_fact(store, warehouse.SUPPLIER_OTD, td.otd_facts(spark, sf_dir), td.AS_OF)
    return warehouse.column_statistics(store.read(warehouse.SUPPLIER_OTD.name), warehouse.SUPPLIER_OTD.statistics)

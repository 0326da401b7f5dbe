import datetime as dt

import pytest

from stratiform.operators import reconcile, scd
from stratiform.functions.hashing import add_row_hash
from stratiform.plans.audit import RUNS, WATERMARKS, PipelineLocked, PipelineRun, locks
from stratiform.plans.store import AmbiguousMerge, ConcurrentCommit, TableMissing, Version, merged

DAY1, DAY2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)


def _df(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, p string")


def test_versions(spark, store, rows):
    assert not store.exists("a.t")
    store.create("a.t", _df(spark, [(1, "x", "p"), (2, "y", "q")]), ["p"])
    store.append("a.t", _df(spark, [(3, "z", "q")]).select("p", "v", "k"))
    assert rows(store.read("a.t")) == [(1, "x", "p"), (2, "y", "q"), (3, "z", "q")]
    assert store.read("a.t", 0).count() == 2
    store.merge("a.t", _df(spark, [(2, "Y", "q"), (9, "n", "r")]), ["k", "p"])
    assert rows(store.read("a.t")) == [(1, "x", "p"), (2, "Y", "q"), (3, "z", "q"), (9, "n", "r")]
    assert any("=0-" in p and p.endswith("p=p") for p in store.version("a.t").paths)
    store.delete("a.t", "k = 1")
    assert store.read("a.t").count() == 3
    store.compact("a.t")
    store.vacuum("a.t", 1)
    assert store.read("a.t").count() == 3 and len(store.versions("a.t")) == 1
    with pytest.raises(TableMissing):
        store.read("a.t", 0)


def test_conflict(spark, store):
    store.create("a.t", _df(spark, [(1, "x", "p")]))
    v = store.version("a.t")
    store.append("a.t", _df(spark, [(2, "x", "p")]))
    with pytest.raises(ConcurrentCommit):
        store._commit("a.t", Version(1, v.schema, []))
    assert store.read("a.t").count() == 2


def test_merge_rules(spark, rows):
    t, s = _df(spark, [(1, "a", "p"), (None, "n", "p")]), _df(spark, [(1, "b", "p"), (None, "m", "p")])
    assert rows(merged(t, s, ["k"])) == [(1, "b", "p"), (None, "m", "p"), (None, "n", "p")]
    assert rows(merged(t, s, ["k"], null_safe=True)) == [(1, "b", "p"), (None, "m", "p")]
    assert rows(merged(t, s, ["k"], condition="t.v > s.v", insert=False)) == [(1, "a", "p"), (None, "n", "p")]
    with pytest.raises(AmbiguousMerge):
        merged(t, _df(spark, [(1, "b", "p"), (1, "c", "p")]), ["k"])
    once = merged(t, s, ["k"], null_safe=True)
    assert rows(merged(once, s, ["k"], null_safe=True)) == rows(once)


def test_scd2(spark, store, rows):
    load = lambda data: add_row_hash(spark.createDataFrame(data, "k int, v string"), ["v"])
    scd.merge_scd2(store, "g.d", load([(1, "a"), (2, "b")]), ["k"], DAY1)
    for _ in range(2):  # a replay changes nothing
        scd.merge_scd2(store, "g.d", load([(1, "A"), (3, "c")]), ["k"], DAY2)
    got = rows(store.read("g.d").select("k", "v", "effective_from", "effective_to", "is_current"))
    assert got == [(1, "A", DAY2, None, True), (1, "a", DAY1, DAY2, False), (2, "b", DAY1, None, True), (3, "c", DAY2, None, True)]


def test_audited_run(spark, store):
    with PipelineRun(store, "p", "S", "e") as run:
        assert run.watermark() is None and locks(store).count() == 1
        with pytest.raises(PipelineLocked):
            PipelineRun(store, "p", "S", "e").__enter__()
        run.metric("rows_in", 12345)
        run.advance_watermark("2026-05-06T10:00:00Z")
        run.advance_watermark(None)
    with pytest.raises(ValueError), PipelineRun(store, "p", "S", "e") as run:
        assert run.watermark() == "2026-05-06T10:00:00Z"
        run.advance_watermark("9999")
        raise ValueError("boom")
    got = {r.status: r for r in store.read(RUNS).collect()}
    assert set(got) == {"SUCCESS", "FAILED"} and "12345" in got["SUCCESS"].metrics_json and "boom" in got["FAILED"].error_text
    assert store.read(WATERMARKS).first().watermark_value == "2026-05-06T10:00:00Z" and locks(store).count() == 0


def test_reconciliation(spark, store):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "k int, v string")
    store.create("l.a", a), store.create("l.b", b)
    kinds = {r.k: r.variance_type for r in reconcile.variances(a, b, ["k"], ["v"]).collect()}
    swapped = {r.k: r.variance_type for r in reconcile.variances(b, a, ["k"], ["v"]).collect()}
    assert kinds == {2: "VALUE_MISMATCH", 3: "MISSING_IN_NEW", 4: "MISSING_IN_LEGACY"}
    assert swapped == {2: "VALUE_MISMATCH", 4: "MISSING_IN_NEW", 3: "MISSING_IN_LEGACY"}
    cfg = reconcile.ReconConfig("p", "l.a", "l.b", ["k"], ["v"])
    row = reconcile.run_reconciliation(store, cfg, "2026-01-01").first()
    assert (row.total_rows, row.variance_rows, row.variance_pct, row.within_tolerance) == (4, 3, 75.0, False)
    assert store.read(reconcile.SAMPLES).count() == 3
    same = reconcile.ReconConfig("q", "l.a", "l.a", ["k"], ["v"])
    for d in range(1, 8):
        assert not reconcile.cutover_ready(store, "q", 7)
        reconcile.run_reconciliation(store, same, f"2026-01-0{d}")
    assert reconcile.cutover_ready(store, "q", 7) and reconcile.cutover_ready(store, "q", 7, calendar=True)
    assert not reconcile.cutover_ready(store, "p", 1)

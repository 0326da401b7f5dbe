"""Slowly changing dimensions: SCD1, hash-based SCD2 and ordered change application, as plans and on the store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import AmbiguousMerge, TableStore, merged


def as_instant(at: dt.datetime | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def scd1(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Every source row replaces or joins the target."""
    return merged(target, source, keys)


def scd2_bootstrap(source: DataFrame, at: dt.datetime | Column, effective_from: str = "effective_from", effective_to: str = "effective_to", is_current: str = "is_current") -> DataFrame:
    """All rows as first versions."""
    return source.withColumns({effective_from: as_instant(at), effective_to: F.lit(None).cast("timestamp"), is_current: F.lit(True)})


def scd2(target: DataFrame, source: DataFrame, keys: list[str], at: dt.datetime | Column, hash_col: str = "row_hash", effective_from: str = "effective_from", effective_to: str = "effective_to", is_current: str = "is_current", null_safe: bool = False) -> DataFrame:
    """The dimension after a load: changed rows' current versions end, new versions begin, equal hashes do nothing.

    One join of the current versions with the source gives both halves, with one instant for the end of a
    version and the start of the next. Rows with a null key are refused unless ``null_safe``.
    """
    if not null_safe:
        source = source.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if not source.groupBy(*keys).count().where("count > 1").isEmpty():
        raise AmbiguousMerge(", ".join(keys))
    now = as_instant(at)
    current = F.col(is_current) & F.col(is_current).isNotNull()
    history = target.where(~F.coalesce(current, F.lit(False)))
    t = target.where(current).withColumn("_in_t", F.lit(True)).alias("t")
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    same: Column = F.lit(True)
    for k in keys:
        a, b = F.col(f"t.`{k}`"), F.col(f"s.`{k}`")
        same = same & (a.eqNullSafe(b) if null_safe else a == b)
    joined = t.join(s, same, "full_outer")
    has_t, has_s = F.col("t._in_t").isNotNull(), F.col("s._in_s").isNotNull()
    differs = has_t & has_s & ~F.col(f"t.`{hash_col}`").eqNullSafe(F.col(f"s.`{hash_col}`"))
    kinds = {f.name: f.dataType for f in target.schema}
    special = {effective_from, effective_to, is_current}

    def old(c: str) -> Column:
        v = F.col(f"t.`{c}`")
        if c == effective_to:
            return F.when(differs, now).otherwise(v)
        return F.when(differs, F.lit(False)).otherwise(v) if c == is_current else v

    def new(c: str) -> Column:
        if c in special:
            return {effective_from: now, effective_to: F.lit(None), is_current: F.lit(True)}[c]
        return F.col(f"s.`{c}`") if c in source.columns else F.lit(None)

    row = lambda f: F.struct(*[f(c).cast(kinds[c]).alias(c) for c in target.columns])
    versions = F.array_compact(F.array(F.when(has_t, row(old)), F.when(has_s & (~has_t | differs), row(new))))
    fresh = joined.select(F.explode(versions).alias("v")).select("v.*")
    return history.unionByName(fresh)


def merge_scd1(store: TableStore, table: str, source: DataFrame, keys: list[str]) -> int:
    return store.merge(table, source, keys)


def merge_scd2(store: TableStore, table: str, source: DataFrame, keys: list[str], at: dt.datetime | Column, **names) -> int:
    """Loads the dimension in one version: a crash leaves the old one."""
    if not store.exists(table):
        return store.create(table, scd2_bootstrap(source, at, **{k: v for k, v in names.items() if k.startswith(("effective", "is_"))}))
    return store.overwrite(table, scd2(store.read(table), source, keys, at, **names))


def apply_changes(source: DataFrame, keys: list[str], sequence_by: str, track: list[str] | None = None, tie_break: list[Column] | None = None, start: str = "effective_from", end: str = "effective_to", current: str = "is_current", scd_type: int = 2) -> DataFrame:
    """Ordered change application, whatever order the rows come in.

    A version begins where a tracked column differs from the row before; other columns are updated in place, and a
    version holds their last values. Rows without a sequence value or key are left out; of rows with equal keys
    and sequence the first by ``tie_break`` counts. Type 1 keeps only the last row of each key.
    """
    rest = [c for c in source.columns if c not in keys and c != sequence_by]
    track = rest if track is None else track
    valid = source.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, sequence_by]))
    ties = tie_break or [F.col(c).desc_nulls_last() for c in sorted(rest)]
    once = valid.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, sequence_by).orderBy(*ties))).where("_rn = 1").drop("_rn")
    if scd_type == 1:
        last = Window.partitionBy(*keys).orderBy(F.col(sequence_by).desc())
        return once.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    w = Window.partitionBy(*keys).orderBy(sequence_by)
    opens = F.lag(F.lit(1)).over(w).isNull()
    for c in track:
        opens = opens | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = once.withColumn("_run", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(sequence_by)).alias("_last")
    versions = runs.groupBy(*keys, "_run").agg(F.min(sequence_by).alias(start), last)
    out = versions.select(*keys, *[F.col("_last")[c].alias(c) for c in rest], start)
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return out.withColumn(end, following).withColumn(current, F.col(end).isNull())

"""Data-quality rules in three tiers: BLOCK stops the commit, QUARANTINE removes rows, WARN counts.

A row breaks a rule when its predicate isn't true, so an unknown (null) result is a violation.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tier(Enum):
    BLOCK = "block"
    QUARANTINE = "quarantine"
    WARN = "warn"


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    tier: Tier

    def broken(self) -> Column:
        return ~F.coalesce(F.expr(self.predicate), F.lit(False))


class ExpectationFailed(Exception):
    """A BLOCK rule was broken; nothing was committed."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v} rows" for k, v in counts.items()))
        self.counts = counts


def expect(name: str, predicate: str) -> Rule:
    return Rule(name, predicate, Tier.WARN)


def expect_or_drop(name: str, predicate: str) -> Rule:
    return Rule(name, predicate, Tier.QUARANTINE)


def expect_or_fail(name: str, predicate: str) -> Rule:
    return Rule(name, predicate, Tier.BLOCK)


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: the number of rows, and for each rule how many break it, in one pass."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(r.broken()).alias(r.name) for r in rules])


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that QUARANTINE rules let pass, and the others with the names of the rules that they break."""
    drops = [r for r in rules if r.tier is Tier.QUARANTINE]
    if not drops:
        return df, df.limit(0).withColumn("_violated", F.array().cast("array<string>"))
    named = df.withColumn("_violated", F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in drops])))
    return named.where(F.size("_violated") == 0).drop("_violated"), named.where(F.size("_violated") > 0)


def enforce(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(rows to commit, quarantined rows, counts); raises before anything is written if a BLOCK rule is broken."""
    counts = violations(df, rules).first().asDict() if rules else {}
    blocked = {r.name: counts[r.name] for r in rules if r.tier is Tier.BLOCK and counts[r.name]}
    if blocked:
        raise ExpectationFailed(blocked)
    good, bad = split(df, rules)
    return good, bad, counts

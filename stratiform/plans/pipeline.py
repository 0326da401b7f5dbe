"""A declarative graph of tables: functions that return frames, rules on their output, change application.

Streaming nodes read their upstream node's committed files and write micro-batches (available now, with a
checkpoint each), so a run processes what is new and stops; snapshot nodes are recomputed from the latest
versions. Rules are enforced before each commit, micro-batches included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from ..operators.expectations import Rule, Tier, enforce
from ..operators.scd import apply_changes
from .store import TableStore


@dataclass
class Node:
    name: str
    build: Callable[[], DataFrame] | None
    kind: str = "snapshot"
    reads: list[str] = field(default_factory=list)
    comment: str = ""
    partition_cols: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    changes: dict | None = None


class Pipeline:
    """Register nodes with decorators, then :meth:`run`."""

    def __init__(self, store: TableStore, schema: str = "pipeline", checkpoints: str | None = None):
        self.store, self.schema = store, schema
        self.checkpoints = checkpoints or f"{store.root}/_checkpoints/{schema}"
        self.nodes: dict[str, Node] = {}

    def table(self, name: str | None = None, reads: tuple[str, ...] | list[str] = (), kind: str = "snapshot", comment: str = "", partition_cols: list[str] | None = None, properties: dict | None = None):
        """A table by the decorated function; ``kind``: "stream" or "snapshot"."""

        def add(f: Callable[[], DataFrame]):
            rules = getattr(f, "_rules", [])
            node = Node(name or f.__name__, f, kind, list(reads), comment, partition_cols or [], properties or {}, rules)
            self.nodes[node.name] = node
            return f

        return add

    def _rule(self, tier: Tier, name: str, predicate: str):
        def add(f):
            f._rules = [Rule(name, predicate, tier), *getattr(f, "_rules", [])]
            return f

        return add

    def expect(self, name: str, predicate: str):
        return self._rule(Tier.WARN, name, predicate)

    def expect_or_drop(self, name: str, predicate: str):
        return self._rule(Tier.QUARANTINE, name, predicate)

    def expect_or_fail(self, name: str, predicate: str):
        return self._rule(Tier.BLOCK, name, predicate)

    def create_streaming_table(self, name: str, comment: str = "") -> None:
        self.nodes[name] = Node(name, None, "changes", comment=comment)

    def apply_changes(self, target: str, source: str, keys: list[str], sequence_by: str, track_history: list[str] | None = None, scd_type: int = 2) -> None:
        node = self.nodes.setdefault(target, Node(target, None, "changes"))
        node.reads, node.changes = [source], {"keys": keys, "sequence_by": sequence_by, "track": track_history, "scd_type": scd_type}

    def full(self, name: str) -> str:
        return f"{self.schema}.{name}"

    def read(self, name: str) -> DataFrame:
        """The latest version of a node."""
        return self.store.read(self.full(name))

    def read_stream(self, name: str) -> DataFrame:
        """What a node gains, as a stream over its committed files."""
        v = self.store.version(self.full(name))
        reader = self.store.spark.readStream.schema(v.schema)
        if not v.partition_by:
            reader = reader.option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.store._dir(self.full(name))}/data").select(*[f"`{c}`" for c in v.schema.names])

    def order(self) -> list[str]:
        return list(TopologicalSorter({n.name: set(n.reads) for n in self.nodes.values()}).static_order())

    def run(self, append_mode: str = "append") -> dict[str, dict]:
        """Every node once, upstream first; the rule counts and quarantine sizes of each."""
        return {n: self._run(self.nodes[n], append_mode) for n in self.order()}

    def _run(self, node: Node, mode: str) -> dict:
        if node.changes is not None:
            c = node.changes
            return self._replace(node, apply_changes(self.read(node.reads[0]), c["keys"], c["sequence_by"], c["track"], scd_type=c["scd_type"]))
        if node.kind == "snapshot":
            return self._replace(node, node.build())
        totals: dict = {}

        def batch(df: DataFrame, batch_id: int) -> None:
            good, bad, counts = enforce(df, node.rules)
            for k, v in counts.items():
                totals[k] = totals.get(k, 0) + v
            self._add(node.name, good, node.partition_cols)
            if any(r.tier is Tier.QUARANTINE for r in node.rules):
                self._add(f"{node.name}_quarantine", bad, [])

        stream = node.build()
        if not self.store.exists(self.full(node.name)):
            self._add(node.name, self.store.spark.createDataFrame([], stream.schema), node.partition_cols)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.checkpoints}/{node.name}").trigger(availableNow=True).foreachBatch(batch).start()
        query.awaitTermination()
        return totals

    def _add(self, name: str, df: DataFrame, parts: list[str]) -> None:
        full = self.full(name)
        if self.store.exists(full):
            if not df.isEmpty():
                self.store.append(full, df)
        else:
            self.store.create(full, df, parts)

    def _replace(self, node: Node, df: DataFrame) -> dict:
        good, bad, counts = enforce(df, node.rules)
        full = self.full(node.name)
        if self.store.exists(full):
            self.store.overwrite(full, good)
        else:
            self.store.create(full, good, node.partition_cols, node.properties)
        if any(r.tier is Tier.QUARANTINE for r in node.rules):
            self._add(f"{node.name}_quarantine", bad, [])
        return counts

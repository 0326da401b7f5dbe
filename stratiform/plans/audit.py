"""Audited runs: a lock, a run row, metrics, and a watermark that is committed only on success."""

from __future__ import annotations

import datetime as dt
import json
import socket
import time
import traceback
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ..sources.schemas import PIPELINE_LOCK, PIPELINE_RUN, PIPELINE_WATERMARK
from .store import TableMissing, TableStore

RUNS, WATERMARKS, LOCKS = "audit.pipeline_run", "audit.pipeline_watermark", "audit.pipeline_lock"


class PipelineLocked(RuntimeError):
    """Another run of the pipeline holds its lock."""


def create_audit_tables(store: TableStore) -> None:
    for name, schema in ((RUNS, PIPELINE_RUN), (WATERMARKS, PIPELINE_WATERMARK)):
        if not store.exists(name):
            store.create_empty(name, schema, if_absent=True)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class PipelineRun:
    """``with PipelineRun(store, name, system, entity) as run:`` reads ``run.watermark()``, sets metrics, and stages
    a new watermark with ``run.advance_watermark``. The lock is the exclusive creation of a file; one older than
    ``stale_after`` seconds is taken over by renaming it, which only one of several runs can do, and a run gives back only a
    lock of its own. Stores without atomic creation and renaming, such as plain object stores, don't exclude. On success the watermark is committed first, then the row says SUCCESS;
    an exception leaves FAILED with the end of its traceback, no new watermark, and goes on.
    """

    def __init__(self, store: TableStore, pipeline_name: str, source_system: str, entity: str, stale_after: float = 6 * 3600):
        self.store, self.pipeline_name, self.source_system, self.entity = store, pipeline_name, source_system, entity
        self.stale_after = stale_after
        self.run_id, self.host = str(uuid.uuid4()), socket.gethostname()
        self.metrics: dict[str, object] = {}
        self._staged: str | None = None
        self._lock = f"{store.root}/{LOCKS.replace('.', '/')}/{pipeline_name}.json"

    def __enter__(self) -> PipelineRun:
        create_audit_tables(self.store)
        self._acquire()
        try:
            self._started = _now()
            self.store.append(RUNS, self._row("RUNNING"))
        except BaseException:
            self._release()
            raise
        return self

    def __exit__(self, kind, error, trace) -> bool:
        try:
            if error is None:
                self._commit_watermark()
                self._close("SUCCESS")
            else:
                self._close("FAILED", "".join(traceback.format_exception(kind, error, trace))[-4000:])
        finally:
            self._release()
        return False

    def _release(self) -> None:
        """Gives the lock back, unless another run has taken it over."""
        try:
            mine = json.loads(self.store.read_text(self._lock))["run_id"] == self.run_id
        except (Py4JJavaError, ValueError):
            return
        if mine:
            self.store.remove(self._lock)

    def _acquire(self) -> None:
        body = json.dumps({"pipeline_name": self.pipeline_name, "run_id": self.run_id, "host": self.host, "acquired_at": _now().isoformat()})
        if self.store.create_exclusive(self._lock, body):
            return
        if time.time() - self.store.modified(self._lock) > self.stale_after:
            claimed = f"{self._lock}.stale-{self.run_id}"
            if self.store.rename(self._lock, claimed):
                self.store.remove(claimed)
                if self.store.create_exclusive(self._lock, body):
                    return
        raise PipelineLocked(f"{self.pipeline_name} is running: {self.store.read_text(self._lock)}")

    def _row(self, status: str, ended: dt.datetime | None = None, error: str | None = None):
        row = (self.run_id, self.pipeline_name, self.source_system, self.entity, status, self._started, ended, json.dumps(self.metrics, default=str), error, self.host)
        return self.store.spark.createDataFrame([row], PIPELINE_RUN)

    def _close(self, status: str, error: str | None = None) -> None:
        self.store.merge(RUNS, self._row(status, _now(), error), ["run_id"])

    def _commit_watermark(self) -> None:
        if self._staged is None:
            return
        row = [(self.source_system, self.entity, self._staged, _now())]
        self.store.merge(WATERMARKS, self.store.spark.createDataFrame(row, PIPELINE_WATERMARK), ["source_system", "entity"])

    def watermark(self) -> str | None:
        """The committed watermark of this source and entity."""
        try:
            marks = self.store.read(WATERMARKS)
        except TableMissing:
            return None
        mine = marks.where((F.col("source_system") == self.source_system) & (F.col("entity") == self.entity)).limit(1).collect()
        return mine[0].watermark_value if mine else None

    def advance_watermark(self, value: object | None) -> None:
        """Stages a watermark; None is ignored."""
        if value is not None:
            self._staged = str(value)

    def metric(self, key: str, value: object) -> None:
        self.metrics[key] = value


def locks(store: TableStore):
    """The locks that are held now, as a table."""
    folder = f"{store.root}/{LOCKS.replace('.', '/')}"
    held = [json.loads(store.read_text(f"{folder}/{f}")) for f in store._list(folder) if f.endswith(".json")]
    rows = [(x["pipeline_name"], x["run_id"], x["host"], dt.datetime.fromisoformat(x["acquired_at"])) for x in held]
    return store.spark.createDataFrame(rows, PIPELINE_LOCK)

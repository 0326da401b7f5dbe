"""Jobs: tasks with dependencies, run in order; a failed task stops those that need it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter


@dataclass
class Job:
    name: str
    parameters: dict = field(default_factory=dict)
    schedule: str | None = None
    tasks: dict[str, tuple[Callable[..., object], list[str], int]] = field(default_factory=dict)

    def task(self, name: str, run: Callable[..., object], needs: list[str] | None = None, retries: int = 0) -> Job:
        self.tasks[name] = (run, needs or [], retries)
        return self

    def run(self, **parameters) -> dict[str, tuple[str, object]]:
        """For each task its state (done, failed, skipped) with its result or error."""
        given, out = {**self.parameters, **parameters}, {}
        for name in TopologicalSorter({k: set(v[1]) for k, v in self.tasks.items()}).static_order():
            run, needs, retries = self.tasks[name]
            if any(out[n][0] != "done" for n in needs):
                out[name] = ("skipped", None)
                continue
            for left in range(retries, -1, -1):
                try:
                    out[name] = ("done", run(**given))
                    break
                except Exception as e:
                    if not left:
                        out[name] = ("failed", e)
        return out

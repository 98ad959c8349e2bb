"""Stage pipelines over a frame set's tables: an ordered registry of functions from tables to tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]
Stage = Callable[[Tables], Tables]


class Pipeline:
    """Named stages in order. Each gets all tables so far and returns those that it adds or replaces.

    Tables are plans, so running a pipeline only builds them; `timings` holds the seconds that building each took.
    """

    def __init__(self) -> None:
        self._stages: list[tuple[str, Stage]] = []
        self._off: set[str] = set()
        self.timings: dict[str, float] = {}

    def add(self, name: str, stage: Stage, before: str = "") -> Pipeline:
        """Add a stage at the end, or before another. A stage of the same name goes first; so re-adding moves it."""
        self.remove(name)
        at = next((i for i, (n, _) in enumerate(self._stages) if before and n == before), len(self._stages))
        self._stages.insert(at, (name, stage))
        return self

    def remove(self, name: str) -> bool:
        kept = [s for s in self._stages if s[0] != name]
        gone = len(kept) < len(self._stages)
        self._stages = kept
        return gone

    def enable(self, name: str, on: bool = True) -> None:
        (self._off.discard if on else self._off.add)(name)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self._stages]

    def run(self, tables: Tables) -> Tables:
        """All tables after the stages that are on; the given dict isn't changed."""
        tables = dict(tables)
        for name, stage in self._stages:
            if name not in self._off:
                began = time.perf_counter()
                tables |= stage(dict(tables))
                self.timings[name] = time.perf_counter() - began
        return tables

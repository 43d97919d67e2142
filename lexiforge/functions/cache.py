"""Results kept by key while their version stands and their time is not over."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class VersionedCache:
    """key to a persisted DataFrame.  A version that differs or a time to live that has passed builds it
    anew; what it replaces is unpersisted.  At most ``size`` keys stay, the latest used ones."""

    def __init__(self, ttl_s: float | None = None, size: int = 32, clock: Callable[[], float] = time.monotonic):
        self.ttl_s, self.size, self.clock = ttl_s, size, clock
        self.hits = self.misses = 0
        self._held: dict[str, tuple[object, float, DataFrame]] = {}

    def get(self, key: str, version: object, build: Callable[[], DataFrame]) -> DataFrame:
        held = self._held.pop(key, None)
        if held and held[0] == version and (self.ttl_s is None or self.clock() < held[1]):
            self.hits += 1
        else:
            if held:
                held[2].unpersist()
            self.misses += 1
            held = (version, self.clock() + (self.ttl_s or 0), build().persist())
        self._held[key] = held
        while len(self._held) > self.size:
            self._held.pop(next(iter(self._held)))[2].unpersist()
        return held[2]

    def clear(self) -> None:
        while self._held:
            self._held.popitem()[1][2].unpersist()

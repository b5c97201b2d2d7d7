"""Results kept by the graph they come from and the query that asked for them."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from loomgraph.scratch import drop, table


class ResultCache:
    """Tables in the shared folder by (graph hash, query text), each for ttl seconds.
    A result past its time, or beyond the most that are kept, is removed. A frame that
    was handed out reads its files, so it must not be used after that."""

    def __init__(self, ttl: float = 300.0, most: int = 64, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.held: dict[str, tuple[float, DataFrame, list]] = {}
        self.hits = self.misses = 0

    @staticmethod
    def key(graph_hash: str, query: str) -> str:
        return hashlib.sha256(f"{graph_hash}\n{' '.join(query.split())}".encode()).hexdigest()

    def get(self, graph_hash: str, query: str, make: Callable[[], DataFrame]) -> DataFrame:
        self.expire()
        k = self.key(graph_hash, query)
        if k in self.held:
            self.hits += 1
            return self.held[k][1]
        self.misses += 1
        made: list = []
        out = table(make(), "result", made)
        self.held[k] = (self.clock() + self.ttl, out, made)
        while len(self.held) > self.most:
            drop(self.held.pop(next(iter(self.held)))[2])
        return out

    def expire(self) -> None:
        now = self.clock()
        for k in [k for k, (until, _, _) in self.held.items() if until <= now]:
            drop(self.held.pop(k)[2])

    def clear(self) -> None:
        for _, _, made in self.held.values():
            drop(made)
        self.held.clear()

"""Results of recent queries on the driver."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any


class QueryCache:
    """Least recently used entries go first; age and a new index generation make an entry stale."""

    def __init__(self, size: int = 100, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[Any, float, int]] = OrderedDict()
        self.generation = self.hits = self.misses = 0

    @staticmethod
    def key(query: str, top_k: int) -> str:
        return hashlib.sha256(query.encode() + (top_k & 0xFFFF).to_bytes(2, "big")).hexdigest()[:32]

    def get(self, query: str, top_k: int) -> Any | None:
        k = self.key(query, top_k)
        if k in self.entries:
            value, born, generation = self.entries[k]
            if generation == self.generation and self.clock() - born <= self.ttl:
                self.entries.move_to_end(k)
                self.hits += 1
                return value
            del self.entries[k]
        self.misses += 1
        return None

    def put(self, query: str, top_k: int, value: Any) -> None:
        k = self.key(query, top_k)
        self.entries[k] = (value, self.clock(), self.generation)
        self.entries.move_to_end(k)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def invalidate(self) -> None:
        self.entries.clear()
        self.generation += 1

    def cached(self, query: str, top_k: int, compute: Callable[[], Any]) -> Any:
        """The stored result, or the computed one, stored."""
        found = self.get(query, top_k)
        if found is None:
            found = compute()
            self.put(query, top_k, found)
        return found

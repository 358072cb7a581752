"""Results kept by request: identifiers of earlier fetches, valid while their entities' versions stand."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tessera.store import Store


@dataclass
class Policy:
    """entries: how many results are kept; order: which goes first; the two lifetimes are seconds, None for none; in_flight: above it a request passes the cache by."""

    entries: int = 512
    order: str = "lru"
    after_write: float | None = None
    after_access: float | None = None
    in_flight: int = 10


@dataclass
class _Entry:
    value: DataFrame
    versions: tuple
    written: float
    read: float
    uses: int = 0


class ResultCache:
    """Frames are persisted while they are kept. Empty results and partial projections are not admitted."""

    def __init__(self, policy: Policy | None = None, clock: Callable[[], float] = time.monotonic):
        self.policy, self.clock = policy or Policy(), clock
        self.entries: OrderedDict[Any, _Entry] = OrderedDict()
        self.running, self.hits, self.misses = 0, 0, 0
        self.lock = threading.RLock()
        self.pool = ThreadPoolExecutor(2)
        self.preloaded: dict[Any, tuple[tuple, Future]] = {}

    def _versions(self, store: Store, tables: tuple[str, ...]) -> tuple:
        return tuple(store.versions.get(t, 0) for t in tables)

    def get(self, store: Store, key: Any, tables: tuple[str, ...], make: Callable[[], DataFrame], partial: bool = False) -> DataFrame:
        """The kept result of a key, or a new one. `tables` are those that the result depends on."""
        now, versions = self.clock(), self._versions(store, tables)
        with self.lock:
            waiting = self.preloaded.pop(key, None)  # consumed once
        if waiting:
            made_at, future = waiting
            df = future.result()  # waits outside the lock
            if made_at == versions:
                return df
            df.unpersist()
        with self.lock:
            e = self.entries.get(key)
            if e and (e.versions != versions or self._expired(e, now)):
                self._drop(key)
                e = None
            if e:
                e.read, e.uses = now, e.uses + 1
                self.entries.move_to_end(key)
                self.hits += 1
                return e.value
            self.misses += 1
            bypass = partial or self.running >= self.policy.in_flight
            self.running += 1
        try:
            df = make()
            if bypass:
                return df
            df = df.persist()
            if df.isEmpty():
                df.unpersist()
                return df
            with self.lock:
                self.entries[key] = _Entry(df, versions, now, now)
                while len(self.entries) > self.policy.entries:
                    self._drop(self._victim(key))
            return df
        finally:
            with self.lock:
                self.running -= 1

    def _expired(self, e: _Entry, now: float) -> bool:
        p = self.policy
        return p.after_write is not None and now - e.written > p.after_write or p.after_access is not None and now - e.read > p.after_access

    def _victim(self, newest: Any) -> Any:
        others = [k for k in self.entries if k != newest]
        rank = {"lru": lambda k: self.entries[k].read, "fifo": lambda k: self.entries[k].written, "lfu": lambda k: (self.entries[k].uses, self.entries[k].read)}[self.policy.order]
        return min(others, key=rank)

    def _drop(self, key: Any) -> None:
        self.entries.pop(key).value.unpersist()

    def preload(self, store: Store, key: Any, tables: tuple[str, ...], make: Callable[[], DataFrame]) -> None:
        """Starts a fetch in the background; the next get of the key takes its result, unless a table has changed meanwhile."""
        versions = self._versions(store, tables)

        def run() -> DataFrame:
            df = make().persist()
            df.count()
            return df

        future = self.pool.submit(run)
        with self.lock:
            self.preloaded[key] = versions, future

    def clear(self) -> None:
        with self.lock:
            for key in list(self.entries):
                self._drop(key)

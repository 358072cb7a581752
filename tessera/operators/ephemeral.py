"""Ephemeral attributes: values that only the editing state holds, and what follows a save for readers."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EditingState:
    """Values by (entity, key, attribute), on the driver: the rows that one session edits."""

    def __init__(self):
        self.values: dict[tuple[str, str], dict[object, object]] = {}

    def set(self, entity: str, key: object, attribute: str, value: object) -> None:
        self.values.setdefault((entity, attribute), {})[key] = value

    def clear(self) -> None:
        self.values.clear()

    def matching(self, entity: str, attribute: str, value: object) -> list | None:
        """Keys whose value equals; None if nothing is being edited."""
        held = self.values.get((entity, attribute))
        return None if held is None else [k for k, v in held.items() if v == value]

    def equals(self, entity: str, key: Column, attribute: str, value: object, stored: Column) -> Column:
        """The stored column decides where nothing is being edited; no match is false."""
        found = self.matching(entity, attribute, value)
        return stored == F.lit(value) if found is None else key.isin(found) if found else F.lit(False)

    def differs(self, entity: str, key: Column, attribute: str, value: object, stored: Column) -> Column:
        """All rows but those that match; true if none does."""
        found = self.matching(entity, attribute, value)
        return stored != F.lit(value) if found is None else ~key.isin(found) if found else F.lit(True)


class Notifier:
    """Tells listeners, after a save, which keys were inserted, updated and deleted; a live fetch runs again when its entity is touched."""

    def __init__(self):
        self.listeners: list[tuple[set[str], Callable[[dict], None]]] = []

    def listen(self, entities: set[str], f: Callable[[dict], None]) -> Callable[[], None]:
        entry = (entities, f)
        self.listeners.append(entry)
        return lambda: self.listeners.remove(entry)

    def saved(self, changes: DataFrame) -> None:
        """changes: rows of a save's log. A listener gets, for each of its entities that was touched, the frame of all its changes (event, entity_pk), of any number; it reads what it needs."""
        touched = {r["entity_name"] for r in changes.select("entity_name").distinct().collect()}  # no more than there are entities
        for entities, f in list(self.listeners):
            if hit := entities & touched:
                f({n: changes.where(F.col("entity_name") == n).select("event", "entity_pk") for n in sorted(hit)})


class OneAtATime:
    """Runs a job so that at most one is active; calls meanwhile become one more run."""

    def __init__(self, job: Callable[[], None]):
        self.job, self.lock, self.active, self.again, self.runs = job, threading.Lock(), False, False, 0

    def trigger(self) -> None:
        with self.lock:
            if self.active:
                self.again = True
                return
            self.active = True
        while True:
            self.job()
            with self.lock:
                self.runs += 1
                if not self.again:
                    self.active = False
                    return
                self.again = False

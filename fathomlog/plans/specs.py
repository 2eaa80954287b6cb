"""What a view is: its shape, what it folds, how rows get their keys and data, and how old payloads are promoted.

All are values; ``view_fingerprint`` names a definition by its content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.functions.canonical_json import content_hash
from fathomlog.functions.timestamps import iso_of
from fathomlog.functions.values import MISSING, at_path
from fathomlog.sources.event_log import _among, is_system


class FoldFailure(Exception):
    """Why one event can't be folded into one view; ``reason`` names the step."""

    def __init__(self, reason: str, detail: str):
        super().__init__(f"{reason}: {detail}")
        self.reason, self.detail = reason, detail


@dataclass(frozen=True)
class Interest:
    """Which events a view, subscription or sink takes.

    Types that are None don't restrict; an empty set admits nothing. System entry types are
    admitted by their own flag, whatever ``entry_types`` says; all other conditions hold for them too.
    """

    entry_types: frozenset[str] | None = None
    event_types: frozenset[str] | None = None
    aggregate_types: frozenset[str] | None = None
    include_system: bool = False
    predicate: Callable[[DataFrame], Column] | None = None

    def condition(self, log: DataFrame) -> Column:
        entry = F.when(is_system(), F.lit(self.include_system)).otherwise(_among("entry_type", self.entry_types))
        out = entry & _among("event_type", self.event_types) & _among("aggregate_type", self.aggregate_types)
        return out & self.predicate(log) if self.predicate else out

    def candidate_filter(self) -> dict:
        """Arguments for ``candidates``: a superset of the interest that storage can judge."""
        return {
            "entry_types": None if self.include_system else self.entry_types,
            "event_types": self.event_types,
            "aggregate_types": self.aggregate_types,
        }

    def encoded(self) -> dict:
        names = lambda v: None if v is None else sorted(v)
        return {"entry_types": names(self.entry_types), "event_types": names(self.event_types), "aggregate_types": names(self.aggregate_types), "system": self.include_system}


# Row keys. An event is a dict of log columns, its payload under "data".


@dataclass(frozen=True)
class AggregateId:
    def __call__(self, event: dict) -> str:
        return event["aggregate_id"]


def _resolve(event: dict, path: str, item: Any = MISSING) -> str:
    if path.startswith("item."):
        found = item.get(path[5:], MISSING) if isinstance(item, dict) else MISSING
    elif path in ("aggregateId", "eventType"):
        found = event["aggregate_id" if path == "aggregateId" else "event_type"]
    else:
        found = at_path(event["data"], path.removeprefix("data."))
    if found is MISSING or found is None:
        raise FoldFailure("row_key_failed", f"{path} leads to nothing")
    return str(found).lower() if isinstance(found, bool) else str(found)


@dataclass(frozen=True)
class Composite:
    """Parts found by dotted paths, joined by bars."""

    paths: tuple[str, ...]

    def __call__(self, event: dict, item: Any = MISSING) -> str:
        return "|".join(_resolve(event, p, item) for p in self.paths)


@dataclass(frozen=True)
class ListedKeys:
    """One key for each element of a list in the payload, for some event types."""

    event_types: frozenset[str]
    list_field: str
    paths: tuple[str, ...]

    def __call__(self, event: dict) -> list[str]:
        items = event["data"].get(self.list_field)
        if items is None:
            return []
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            raise FoldFailure("row_key_failed", f"{self.list_field} is no list of objects")
        return [Composite(self.paths)(event, item) for item in items]


# Row data.


@dataclass(frozen=True)
class WholePayload:
    def __call__(self, event: dict) -> dict:
        return dict(event["data"])


@dataclass(frozen=True)
class PayloadField:
    name: str

    def __call__(self, event: dict) -> dict:
        value = event["data"].get(self.name, {})
        if not isinstance(value, dict):
            raise FoldFailure("row_data_failed", f"{self.name} is no object")
        return dict(value)


@dataclass(frozen=True)
class SelectedFields:
    names: tuple[str, ...]

    def __call__(self, event: dict) -> dict:
        return {n: event["data"][n] for n in self.names if n in event["data"]}


@dataclass(frozen=True)
class ConstantFields:
    values: tuple[tuple[str, Any], ...]

    def __call__(self, event: dict) -> dict:
        return dict(self.values)


@dataclass(frozen=True)
class ListLength:
    name: str
    source: str

    def __call__(self, event: dict) -> dict:
        value = event["data"].get(self.source)
        if value is None:
            return {}
        if not isinstance(value, list):
            raise FoldFailure("row_data_failed", f"{self.source} is no list")
        return {self.name: len(value)}


@dataclass(frozen=True)
class EventTimestamp:
    name: str

    def __call__(self, event: dict) -> dict:
        return {self.name: iso_of(event["client_timestamp"])}


@dataclass(frozen=True)
class Combined:
    """Parts from left to right; later ones overwrite."""

    parts: tuple[Callable[[dict], dict], ...]

    def __call__(self, event: dict) -> dict:
        out: dict = {}
        for part in self.parts:
            out |= part(event)
        return out


# Derived fields.


@dataclass(frozen=True)
class Constant:
    value: Any


@dataclass(frozen=True)
class FirstEventTimestamp:
    pass


@dataclass(frozen=True)
class Derived:
    """A field of a row read from the row itself; null or nothing there gives the fallback."""

    name: str
    path: str
    fallback: Constant | FirstEventTimestamp

    def __call__(self, row: dict) -> Any:
        found = at_path(row, self.path)
        if found is MISSING or found is None:
            return self.fallback.value if isinstance(self.fallback, Constant) else row.get("firstEventTimestamp")
        return found


@dataclass(frozen=True)
class AggregateView:
    """One row per aggregate: payloads merged in order, gone after a tombstone until the next event."""

    name: str
    interest: Interest
    tombstones: frozenset[str] = frozenset()
    derived: tuple[Derived, ...] = ()


@dataclass(frozen=True)
class TableView:
    """One row per extracted key: inserts overwrite, updates merge into a row that exists, removals delete it.

    match_field guards updates and removals: the row's and the payload's value of it must be equal,
    nothing being equal to nothing. Removals that an event lists aren't guarded.
    """

    name: str
    interest: Interest
    inserts: frozenset[str]
    removes: frozenset[str]
    row_key: Callable[[dict], str]
    row_data: Callable[[dict], dict]
    updates: frozenset[str] = frozenset()
    update_data: Callable[[dict], dict] = field(default_factory=lambda: ConstantFields(()))
    match_field: str | None = None
    listed: ListedKeys | None = None

    def operation(self, event_type: str) -> str:
        for name, types in (("insert", self.inserts), ("update", self.updates), ("remove", self.removes), ("listed", self.listed.event_types if self.listed else ())):
            if event_type in types:
                return name
        return "none"


def view_fingerprint(view: AggregateView | TableView, versions: dict[str, tuple[int, int]], promotions: list[dict]) -> str:
    """Hash of what makes a view's rows: shape, interest, covered versions and promotion chains; a predicate doesn't count."""
    shape = {"kind": type(view).__name__, "interest": view.interest.encoded(), "versions": {k: list(v) for k, v in versions.items()}, "promotions": promotions}
    if isinstance(view, AggregateView):
        shape |= {"tombstones": sorted(view.tombstones), "derived": [repr(d) for d in view.derived]}
    else:
        shape |= {"inserts": sorted(view.inserts), "removes": sorted(view.removes), "key": repr(view.row_key), "data": repr(view.row_data)}
        # Later features count only where they are used, so older definitions keep their names.
        shape |= {"updates": [sorted(view.updates), repr(view.update_data)]} if view.updates else {}
        shape |= {"match": view.match_field} if view.match_field else {}
        shape |= {"listed": repr(view.listed)} if view.listed else {}
    return content_hash(shape)

"""Promotion of payloads written under older versions of an entry type.

Versions are (major, minor). A minor step only adds fields with defaults; a major step
may do anything and leads to minor 0 of the next major.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from fathomlog.plans.specs import FoldFailure

Version = tuple[int, int]


@dataclass(frozen=True)
class Rename:
    source: str
    target: str

    def __call__(self, data: dict) -> dict:
        if self.source not in data:
            return data
        if self.target in data:
            raise FoldFailure("promoter_failed", f"{self.target} is there already")
        return {(self.target if k == self.source else k): v for k, v in data.items()}


@dataclass(frozen=True)
class Default:
    name: str
    value: Any

    def __call__(self, data: dict) -> dict:
        return data if self.name in data else data | {self.name: self.value}


@dataclass(frozen=True)
class Drop:
    name: str

    def __call__(self, data: dict) -> dict:
        return {k: v for k, v in data.items() if k != self.name}


Step = tuple[Rename | Default | Drop, ...]


class Promotions:
    """Registered steps of (view, entry type); sealed by the first use."""

    def __init__(self) -> None:
        self.steps: dict[tuple[str, str], dict[Version, tuple[Version, Step]]] = {}
        self.sealed = False

    def register(self, view: str, entry_type: str, start: Version, end: Version, step: Step) -> None:
        if self.sealed:
            raise ValueError("promotions are in use already")
        held = self.steps.setdefault((view, entry_type), {})
        if end[0] == start[0]:
            if end[1] != start[1] + 1 or not all(isinstance(t, Default) for t in step):
                raise ValueError("a minor step goes to the next minor and only adds defaults")
        elif end != (start[0] + 1, 0):
            raise ValueError("a major step goes to minor 0 of the next major")
        elif any(a[0] == start[0] and b[0] != a[0] for a, (b, _) in held.items()):
            raise ValueError(f"major {start[0]} has its step already")
        if held.get(start, ((-1, -1), ()))[0][0] == end[0]:
            raise ValueError("this step is there already")
        held[start] = (end, step)

    def chain(self, view: str, entry_type: str, start: Version, end: Version) -> list[Rename | Default | Drop]:
        """All transforms from ``start`` to ``end``; a missing minor step changes nothing, a missing major one is a gap."""
        self.sealed = True
        held, at, out = self.steps.get((view, entry_type), {}), start, []
        if start[0] > end[0]:
            raise ValueError(f"{start} is of a later major than {end}")
        while at < end:
            majors = [a for a, (b, _) in held.items() if a[0] == at[0] and b[0] > a[0]]
            goes = held.get(at)
            if goes and goes[0] <= end and (goes[0][0] > at[0] or at[0] == end[0] or (majors and at < majors[0])):
                at = goes[0]
                out.extend(goes[1])
            elif at[0] == end[0] or (majors and at < majors[0]):
                at = (at[0], at[1] + 1)
            else:
                raise FoldFailure("promoter_failed", f"no step leads on from {at} to {end}")
        return out

    def promote(self, view: str, entry_type: str, start: Version, end: Version, data: dict, row: dict | None = None) -> dict:
        """The payload as of ``end``. A default isn't set for a field that ``row`` has already under its final name."""
        chain = self.chain(view, entry_type, start, end)
        for i, step in enumerate(chain):
            if isinstance(step, Default) and row and _final_name(step.name, chain[i + 1 :]) in row:
                continue
            data = step(data)
        return data


def _final_name(name: str, later: list) -> str | None:
    for step in later:
        if isinstance(step, Rename) and step.source == name:
            name = step.target
        elif isinstance(step, Drop) and step.name == name:
            return None
    return name

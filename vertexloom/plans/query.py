"""Queries over a graph: a tree of levels, each a position with fields, filters and relationships."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import DepthExceeded, QueryError
from .graph import PropertyGraph

MOST_DEPTH = 3
_REQUIRED = object()


@dataclass(frozen=True)
class Param:
    """A value supplied when the query runs. Without a default it must be, unless it may be null."""

    name: str
    default: Any = _REQUIRED
    nullable: bool = True

    def value(self, supplied: Mapping[str, Any]) -> Any:
        if self.name in supplied:
            value = supplied[self.name]
            if value is None and not self.nullable:
                raise QueryError(f"${self.name} may not be null")
            return value
        if self.default is not _REQUIRED:
            return self.default
        if self.nullable:
            return None
        raise QueryError(f"${self.name} has no value")


@dataclass(frozen=True)
class Level:
    """``name`` is a vertex type or an interface at the root, and a relationship below. ``fields``
    holds field names, or pairs (response key, field). ``where`` compares fields with values."""

    name: str
    fields: tuple[str | tuple[str, str], ...] = ()
    where: Mapping[str, Any] = field(default_factory=dict)
    follow: tuple[Level, ...] = ()
    key: str | None = None  # in the response; the name unless given

    @property
    def response_key(self) -> str:
        return self.key or self.name

    def named_fields(self) -> list[tuple[str, str]]:
        return [(f, f) if isinstance(f, str) else f for f in self.fields]


def validate(graph: PropertyGraph, level: Level, owner: str, most_depth: int = MOST_DEPTH, path: tuple[str, ...] = ()) -> None:
    """Raise for what the graph doesn't have, before anything is planned."""
    path = (*path, level.response_key)
    if len(path) - 1 > most_depth:
        raise DepthExceeded(len(path) - 1, most_depth, path)
    if not level.fields and not level.follow:
        raise QueryError(f"{'.'.join(path)} selects nothing")
    known, relationships = graph.fields_of(owner), graph.relationships_of(owner)
    keys = [k for k, _ in level.named_fields()] + [c.response_key for c in level.follow]
    if twice := {k for k in keys if keys.count(k) > 1}:
        raise QueryError(f"{'.'.join(path)} has two values for {min(twice)}")
    for _, f in level.named_fields():
        if f not in known:
            raise QueryError(f"{owner} has no field {f}")
    for f, value in level.where.items():
        if f not in known:
            raise QueryError(f"{owner} has no field {f} to filter on")
        if isinstance(value, list | tuple | dict | set):
            raise QueryError(f"{owner}.{f} can only be compared with a single value")
    for child in level.follow:
        if child.name not in relationships:
            raise QueryError(f"{owner} has no relationship {child.name}")
        validate(graph, child, relationships[child.name].to, most_depth, path)

"""Property graphs over ordinary tables.

A vertex type names a table, the columns that identify a row, and its fields. An edge element says
which columns of a table hold the keys of its source and of its destination; one table may carry
several labels and one label may lie in several tables. An interface spans the tables of the types
that implement it. A relationship is a field that leads from a type along an edge label to another.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from ..errors import GraphError


class Direction(Enum):
    OUT = "out"
    IN = "in"


@dataclass(frozen=True)
class Relationship:
    """From the type that declares it along ``label`` to the vertex type ``to``."""

    label: str
    to: str
    direction: Direction = Direction.OUT


@dataclass(frozen=True)
class Check:
    name: str
    expression: str  # Spark SQL over the table's columns; a null result passes


@dataclass(frozen=True)
class Column:
    """What is declared of a stored column."""

    kind: str  # a Spark SQL type
    nullable: bool = True
    default: str | None = None  # a Spark SQL expression
    renamed_from: str | None = None


@dataclass(frozen=True)
class VertexType:
    name: str
    table: str
    key: tuple[str, ...]  # columns that identify a row
    fields: Mapping[str, str]  # field -> column
    relationships: Mapping[str, Relationship] = field(default_factory=dict)
    label: str | None = None  # the type's name unless given
    columns: Mapping[str, Column] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[Check, ...] = ()
    owned: bool = True  # its table may be rewritten
    key_unique: bool = False  # no two rows have one key; ``constraint_report`` counts those that do
    hub: bool = False  # few rows that very many of other tables lead to

    @property
    def own_label(self) -> str:
        return self.label or self.name


@dataclass(frozen=True)
class EdgeElement:
    label: str
    table: str
    source: str  # vertex type
    source_key: tuple[str, ...]
    destination: str  # vertex type
    destination_key: tuple[str, ...]


@dataclass(frozen=True)
class Interface:
    """A position that any of several vertex types may take. The fields and relationships that it
    declares must be those of each type."""

    name: str
    fields: tuple[str, ...]
    types: tuple[str, ...]
    relationships: Mapping[str, Relationship] = field(default_factory=dict)


class PropertyGraph:
    def __init__(self, vertices: Iterable[VertexType], edges: Iterable[EdgeElement] = (), interfaces: Iterable[Interface] = ()):
        self.vertices: dict[str, VertexType] = {}
        self.interfaces: dict[str, Interface] = {}
        for v in vertices:
            if v.name in self.vertices:
                raise GraphError(f"{v.name} is declared twice")
            self.vertices[v.name] = v
        self.edges = tuple(edges)
        for i in interfaces:
            if i.name in self.vertices or i.name in self.interfaces:
                raise GraphError(f"{i.name} is declared twice")
            self.interfaces[i.name] = i
        self._validate()

    def _validate(self) -> None:
        if not self.vertices:
            raise GraphError("a graph has at least one vertex type")
        tables: dict[str, str] = {}
        for v in self.vertices.values():
            if tables.setdefault(v.table, v.name) != v.name:
                raise GraphError(f"{v.name} and {tables[v.table]} name one table, {v.table}")
            if not v.key or len(set(v.key)) != len(v.key):
                raise GraphError(f"{v.name} has no key, or names a column of it twice")
            columns = list(v.fields.values())
            if twice := {c for c in columns if columns.count(c) > 1}:
                raise GraphError(f"{v.name}: two fields are stored in {min(twice)}")
            if both := set(v.fields) & set(v.relationships):
                raise GraphError(f"{v.name}.{min(both)} is a field and a relationship")
            for c in (c for group in v.unique for c in group):
                if c not in columns and c not in v.key and c not in v.columns:
                    raise GraphError(f"{v.name}: unique names the unknown column {c}")
            for name, declared in v.columns.items():
                if declared.renamed_from in v.columns:
                    raise GraphError(f"{v.name}.{name} is renamed from {declared.renamed_from}, which is still declared")
        for e in self.edges:
            for end, key in ((e.source, e.source_key), (e.destination, e.destination_key)):
                if end not in self.vertices:
                    raise GraphError(f"edge {e.label} on {e.table} ends at the unknown type {end}")
                if len(key) != len(self.vertices[end].key):
                    raise GraphError(f"edge {e.label} on {e.table}: {len(key)} columns for the key of {end}, which has {len(self.vertices[end].key)}")
        if len(set(self.edges)) != len(self.edges):
            raise GraphError("an edge element is declared twice")
        for i in self.interfaces.values():
            if not i.types:
                raise GraphError(f"{i.name} has no types")
            if unknown := [t for t in i.types if t not in self.vertices]:
                raise GraphError(f"{i.name} has the unknown type {unknown[0]}")
            widths = {len(self.vertices[t].key) for t in i.types}
            if len(widths) > 1:
                raise GraphError(f"the types of {i.name} have keys of different width")
            for t in i.types:
                if missing := [f for f in i.fields if f not in self.vertices[t].fields]:
                    raise GraphError(f"{t} lacks the field {missing[0]} of {i.name}")
                for name, rel in i.relationships.items():
                    if self.vertices[t].relationships.get(name) != rel:
                        raise GraphError(f"{t} and {i.name} disagree on {name}")
        for owner in (*self.vertices.values(), *self.interfaces.values()):
            for name, rel in owner.relationships.items():
                if rel.to in self.interfaces:
                    raise GraphError(f"{owner.name}.{name} leads to the interface {rel.to}; name a vertex type")
                if rel.to not in self.vertices:
                    raise GraphError(f"{owner.name}.{name} leads to the unknown type {rel.to}")
                if not self.elements(owner.name, rel):
                    raise GraphError(f"{owner.name}.{name}: no edge element of label {rel.label} fits")

    def types_of(self, name: str) -> tuple[VertexType, ...]:
        """The vertex types that a position of this type or interface spans."""
        if name in self.vertices:
            return (self.vertices[name],)
        if name in self.interfaces:
            return tuple(self.vertices[t] for t in sorted(self.interfaces[name].types))
        raise GraphError(f"there is no type {name}")

    def relationships_of(self, name: str) -> Mapping[str, Relationship]:
        return (self.vertices.get(name) or self.interfaces[name]).relationships

    def fields_of(self, name: str) -> tuple[str, ...]:
        return tuple(self.vertices[name].fields) if name in self.vertices else self.interfaces[name].fields

    def elements(self, owner: str, rel: Relationship) -> list[EdgeElement]:
        """Every edge element of the label whose ends fit: a hop follows the label, not one table."""
        near = {v.name for v in self.types_of(owner)}
        source, destination = (near, {rel.to}) if rel.direction is Direction.OUT else ({rel.to}, near)
        return [e for e in self.edges if e.label == rel.label and e.source in source and e.destination in destination]

    def inverse(self, owner: str, name: str) -> str | None:
        """The relationship that leads back along the same label, if there is one."""
        rel = self.relationships_of(owner)[name]
        for back, other in self.relationships_of(rel.to).items():
            if other.label == rel.label and other.to == owner and other.direction is not rel.direction:
                return back
        return None

"""How the live tables differ from what a graph declares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..plans.graph import PropertyGraph
from ..sources.tables import Tables


@dataclass(frozen=True, order=True)
class Finding:
    kind: str  # missing_element, missing_property, unexpected_property, type_mismatch
    element: str
    detail: str


def drift(graph: PropertyGraph, tables: Tables, strict: bool = False) -> list[Finding]:
    """The findings, in order; none if the tables fit. ``strict`` also reports columns that the
    graph doesn't declare."""
    found: set[Finding] = set()
    wanted: dict[str, set[str]] = {}
    for v in graph.vertices.values():
        wanted.setdefault(v.table, set()).update(v.key, v.fields.values(), v.columns)
    for e in graph.edges:
        wanted.setdefault(e.table, set()).update(e.source_key, e.destination_key)
    live: dict[str, dict[str, str]] = {}
    for table in wanted:
        try:
            live[table] = dict(tables(table).dtypes)
        except (AnalysisException, KeyError):
            found.add(Finding("missing_element", table, "there is no such table"))
    for table, columns in wanted.items():
        if table not in live:
            continue
        found |= {Finding("missing_property", table, c) for c in columns - set(live[table])}
        if strict:
            found |= {Finding("unexpected_property", table, c) for c in set(live[table]) - columns}
    for v in graph.vertices.values():
        for name, c in v.columns.items():
            kind = live.get(v.table, {}).get(name)
            if kind and kind != tables(v.table).select(F.lit(None).cast(c.kind).alias("x")).dtypes[0][1]:
                found.add(Finding("type_mismatch", v.table, f"{name} is {kind}, declared {c.kind}"))
    return sorted(found)

"""What a graph offers, as rows: types, their fields with the stored types, relationships, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.graph import PropertyGraph
from ..sources.tables import Tables

_ROWS = "owner string, role string, name string, kind string, target string"


def describe(spark: SparkSession, graph: PropertyGraph, tables: Tables) -> DataFrame:
    """(owner, role, name, kind, target), a row for each key column, field, relationship, type of an
    interface and edge element."""
    rows: list[tuple] = []
    for v in graph.vertices.values():
        kinds = dict(tables(v.table).dtypes)
        rows += [(v.name, "key", c, kinds.get(c), v.table) for c in v.key]
        rows += [(v.name, "field", f, kinds.get(c), c) for f, c in v.fields.items()]
        rows += [(v.name, "relationship", n, f"{r.label} {r.direction.value}", r.to) for n, r in v.relationships.items()]
    for i in graph.interfaces.values():
        rows += [(i.name, "type", t, None, graph.vertices[t].table) for t in i.types]
        rows += [(i.name, "field", f, None, None) for f in i.fields]
        rows += [(i.name, "relationship", n, f"{r.label} {r.direction.value}", r.to) for n, r in i.relationships.items()]
    rows += [(e.source, "edge", e.label, e.table, e.destination) for e in graph.edges]
    return spark.createDataFrame(rows, _ROWS)

"""Declared constraints, checked as aggregations.

File tables enforce nothing, so what a graph declares is checked where it matters: the key and the
unique groups by counting, checks and required columns by filtering. Every constraint is one row of
the report, with the number of rows that break it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation
from ..plans.graph import PropertyGraph, VertexType
from ..sources.tables import Tables

UNIQUE, CHECK, REQUIRED = "23505", "23514", "23502"


def _repeated(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows beyond the first of each group; a group with a null component is never repeated."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    counts = rows.where(whole).groupBy(*columns).count().where("count > 1")
    return counts.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("broken"))


def constraint_report(tables: Tables, kind: VertexType) -> DataFrame:
    """(table, constraint, code, broken) for each constraint of a vertex type."""
    rows = tables(kind.table)
    parts = []

    def add(counted: DataFrame, name: str, code: str) -> None:
        parts.append(counted.select(F.lit(kind.table).alias("table"), F.lit(name).alias("constraint"), F.lit(code).alias("code"), "broken"))

    add(_repeated(rows, kind.key), f"{kind.table}_{'_'.join(kind.key)}_key", UNIQUE)
    for columns in kind.unique:
        add(_repeated(rows, columns), f"{kind.table}_{'_'.join(columns)}_unique", UNIQUE)
    # Checks and required columns share one pass.
    flags = {c.name: (F.coalesce(~F.expr(c.expression), F.lit(False)), CHECK) for c in kind.checks}
    flags |= {f"{kind.table}_{name}_required": (F.col(name).isNull(), REQUIRED) for name, c in kind.columns.items() if not c.nullable}
    if flags:
        counted = rows.agg(*[F.count_if(broken).alias(name) for name, (broken, _) in flags.items()])
        stacked = F.explode(F.array(*[F.struct(F.lit(kind.table).alias("table"), F.lit(n).alias("constraint"), F.lit(code).alias("code"), F.col(f"`{n}`").alias("broken")) for n, (_, code) in flags.items()]))
        parts.append(counted.select(stacked.alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def dangling_edges(graph: PropertyGraph, tables: Tables) -> DataFrame:
    """(label, table, end, dangling): for both ends of each edge element, the edges whose key no
    vertex has. A key with a null component is no edge."""
    parts = []
    for e in graph.edges:
        for end, type_, key in (("source", e.source, e.source_key), ("destination", e.destination, e.destination_key)):
            kind = graph.vertices[type_]
            if e.table == kind.table and key == kind.key:
                continue  # the edge's row is the vertex's row
            names = [f"k{i}" for i in range(len(key))]
            edges = tables(e.table).select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)]).dropna()
            vertices = tables(kind.table).select(*[F.col(c).alias(n) for c, n in zip(kind.key, names, strict=True)])
            missing = edges.join(vertices, names, "left_anti").agg(F.count("*").alias("dangling"))
            parts.append(missing.select(F.lit(e.label).alias("label"), F.lit(e.table).alias("table"), F.lit(end).alias("end"), "dangling"))
    return reduce(DataFrame.unionByName, parts)


def validate(tables: Tables, kind: VertexType) -> None:
    """Raise for the first constraint that rows break."""
    for row in constraint_report(tables, kind).where("broken > 0").orderBy("constraint").limit(1).collect():
        raise ConstraintViolation(row["code"], row["table"], row["constraint"], row["broken"])

"""Owned tables in the session's catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..operators.evolve import evolve
from ..plans.graph import PropertyGraph, VertexType


def quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def create_tables(spark: SparkSession, graph: PropertyGraph, format: str = "parquet") -> list[str]:
    """Create the tables of owned vertex types that declare columns and aren't there."""
    made = []
    for v in graph.vertices.values():
        if v.owned and v.columns and not spark.catalog.tableExists(v.table):
            columns = ", ".join(f"{quoted(n)} {c.kind}" for n, c in v.columns.items())
            spark.sql(f"CREATE TABLE {quoted(v.table)} ({columns}) USING {format}")
            made.append(v.table)
    return made


def rewrite_table(spark: SparkSession, kind: VertexType, version: str, drop_others: bool = False) -> DataFrame:
    """Write the table as its type declares under ``version``, a new name; readers of the old one
    aren't disturbed, and it stays until the caller drops it."""
    if spark.catalog.tableExists(version):
        raise GraphError(f"{version} is there already")
    evolve(spark.table(kind.table), kind, drop_others).write.saveAsTable(version)
    return spark.table(version)


@dataclass(frozen=True, order=True)
class Change:
    action: str  # add, drop, rename or retype
    column: str
    detail: str = ""


def changes(rows: DataFrame, kind: VertexType) -> list[Change]:
    """What ``evolve`` with ``drop_others`` would change in a table."""
    there = dict(rows.dtypes)
    found, used = [], set()
    for name, c in kind.columns.items():
        source = c.renamed_from if c.renamed_from in there and name not in there else name
        used.add(source)
        if source not in there:
            found.append(Change("add", name, c.kind))
            continue
        if source != name:
            found.append(Change("rename", name, source))
        if there[source] != rows.select(F.lit(None).cast(c.kind).alias("x")).dtypes[0][1]:
            found.append(Change("retype", name, f"{there[source]} to {c.kind}"))
    return sorted(found + [Change("drop", n) for n in there if n not in used])

"""Bringing a stored table to what its vertex type declares, as one projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..plans.graph import Column, VertexType


def evolve(rows: DataFrame, kind: VertexType, drop_others: bool = False) -> DataFrame:
    """The rows with the declared columns: renamed where the type says so, cast, and new ones filled
    with their default. A column that isn't declared stays unless ``drop_others``. A cast that
    fails raises, and a rename whose old and new columns are both there is refused."""
    if not kind.owned:
        raise GraphError(f"{kind.name} isn't owned; its table is left as it is")
    there = set(rows.columns)
    out: list[SparkColumn] = []
    used: set[str] = set()
    for name, c in kind.columns.items():
        if c.renamed_from and c.renamed_from in there:
            if name in there:
                raise GraphError(f"{kind.table} has {c.renamed_from} and {name}")
            value, source = F.col(f"`{c.renamed_from}`"), c.renamed_from
        elif name in there:
            value, source = F.col(f"`{name}`"), name
        elif c.default is not None:
            value, source = F.expr(c.default), None
        elif c.nullable:
            value, source = F.lit(None), None
        else:
            raise GraphError(f"{kind.table}.{name} is required and new, and has no default")
        used.add(source or name)
        out.append(value.cast(c.kind).alias(name))
    if not drop_others:
        out += [F.col(f"`{c}`") for c in rows.columns if c not in used]
    return rows.select(*out)


def inverse(before: Mapping[str, Column], after: Mapping[str, Column]) -> dict[str, Column]:
    """The columns that lead back from ``after`` to ``before``: renames turned round."""
    back = {c.renamed_from: name for name, c in after.items() if c.renamed_from}
    return {name: Column(c.kind, c.nullable, c.default, back.get(name)) for name, c in before.items()}

"""Shaping matches into nested responses, on the executors.

Every level is one row for each distinct path to it, and is aggregated to its parent before the
siblings of a branch point meet, so branches never multiply. A chain needs no join at all: each
level groups the one below. Lists are ordered by their level's key, nulls last, and
objects of equal keys by their text.

``objects`` gives a row for each root object, spread over the cluster; ``response`` gathers them
into the one row of a response, so it is for results that one task can hold.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical, text
from ..plans.graph import PropertyGraph
from ..plans.query import MOST_DEPTH, Level
from ..sources.tables import Tables
from .match import Matched, Matcher


def _present(keys: list[str]) -> Column:
    """At least a part of the key isn't null: a branch without a match has none."""
    out = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        out = out | F.col(k).isNotNull()
    return out


def _sort_key(keys: list[str]) -> list[Column]:
    """Fields that order a struct by the keys with nulls last."""
    return [c for i, k in enumerate(keys) for c in (F.col(k).isNull().alias(f"n{i}"), F.col(k).alias(f"k{i}"))]


def _listed(keys: list[str], value: Column) -> Column:
    """The list of values by order of the keys."""
    pairs = F.array_sort(F.collect_list(F.when(_present(keys), F.struct(*_sort_key(keys), value.alias("o")))))
    return F.transform(pairs, lambda p: p["o"])


class Responder:
    def __init__(self, graph: PropertyGraph, tables: Tables, query: Level, params: Mapping[str, Any] | None = None, most_depth: int = MOST_DEPTH, json_fields: frozenset[str] = frozenset(), type_names: bool = False):
        self.matcher = Matcher(graph, tables, query, params, most_depth)
        self.json_fields, self.type_names = json_fields, type_names
        self._joined: dict[int, DataFrame] = {}
        self._fields_in_keys: dict[int, list[str]] = {}

    def _source(self, matched: Matched) -> DataFrame:
        home = matched.fragment
        if id(home) not in self._joined:
            self._joined[id(home)] = home.joined()
        return self._joined[id(home)]

    def _list_column(self, matched: Matched) -> str:
        return f"{matched.position.alias}_list"

    @staticmethod
    def _keys(matched: Matched) -> list[str]:
        return [*matched.position.keys, *([matched.position.tag] if matched.position.tag else [])]

    def _level(self, matched: Matched, keys: list[str], fields: list[str]) -> DataFrame:
        """One row for each path to the level: the ``keys`` and ``fields`` above it, its own, and a
        list for each relationship. Fields follow from keys that are unique; where keys may repeat,
        rows that differ in a field are objects of their own."""
        own = [c for _, _, c in matched.fields]
        keys = [*keys, *self._keys(matched)]
        if all(t.key_unique for t in matched.position.types):
            fields = [*fields, *own]
        else:
            keys = [*keys, *own]
            self._fields_in_keys[id(matched)] = own
        if len(matched.children) == 1:
            return self._aggregated(matched.children[0], keys, fields)
        rows = self._source(matched)
        if not matched.children and len(self._paths[id(matched)]) > 2:
            # Dealt by the path above, so that the lists of the next level need no further shuffle.
            rows = rows.repartition(*[c for m in self._paths[id(matched)][:-1] for c in self._keys(m)])
        # A text that follows from the keys is grouped by, since a first text would need a sort.
        texts = {f.name for f in rows.schema if isinstance(f.dataType, T.StringType)}
        firsts = [F.first(c).alias(c) for c in fields if c not in texts]
        group = [*keys, *[c for c in fields if c in texts]]
        rows = rows.groupBy(*group).agg(*firsts) if firsts else rows.select(*group).distinct()
        for child in matched.children:
            lists = self._aggregated(child, self._path_keys(matched), [])
            renamed = lists.select(*[F.col(k).alias(f"{k}_of") for k in self._path_keys(matched)], self._list_column(child))
            on = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in self._path_keys(matched)]
            rows = rows.join(renamed, on, "left").drop(*[f"{k}_of" for k in self._path_keys(matched)])
        return rows

    def _path_keys(self, matched: Matched) -> list[str]:
        return [c for m in self._paths[id(matched)] for c in (*self._keys(m), *self._fields_in_keys.get(id(m), []))]

    def _aggregated(self, child: Matched, keys: list[str], fields: list[str]) -> DataFrame:
        rows = self._level(child, keys, fields)
        listed = _listed(child.position.keys, self._value(child, rows)).alias(self._list_column(child))
        return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in fields], listed)

    def _value(self, matched: Matched, rows: DataFrame) -> Column:
        """The level's object as JSON text, its keys in order."""
        kinds = {f.name: f.dataType for f in rows.schema}
        parts = {}
        for key, name, column in matched.fields:
            parts[key] = F.coalesce(canonical(F.col(column), kinds[column], name, name in self.json_fields), F.lit("null"))
        for child in matched.children:
            items = F.coalesce(F.col(self._list_column(child)), F.array().cast("array<string>"))
            parts[child.level.response_key] = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
        if self.type_names and not matched.position.tag:
            parts["__typename"] = text(F.lit(matched.position.owner))
        pieces = [F.lit("{")]
        for i, key in enumerate(sorted(parts)):
            pieces += [F.lit("," if i else ""), text(F.lit(key)), F.lit(":"), parts[key]]
        return F.concat(*pieces, F.lit("}"))

    def objects(self) -> DataFrame:
        """(keys of the root, ``object``): the JSON text of each root object."""
        root = self.matcher.root
        self._paths: dict[int, list[Matched]] = {}

        def walk(m: Matched, path: list[Matched]) -> None:
            self._paths[id(m)] = [*path, m]
            for c in m.children:
                walk(c, [*path, m])

        walk(root, [])
        rows = self._level(root, [], [])
        return rows.where(_present(root.position.keys)).select(*root.position.keys, self._value(root, rows).alias("object"))

    def response(self) -> DataFrame:
        """One row, ``response``: the whole response as JSON text."""
        root = self.matcher.root
        listed = self.objects().agg(_listed(root.position.keys, F.col("object")).alias("list"))
        key = text(F.lit(root.level.response_key))
        return listed.select(F.concat(F.lit("{"), key, F.lit(":["), F.array_join("list", ","), F.lit("]}")).alias("response"))


def respond(graph: PropertyGraph, tables: Tables, query: Level, params: Mapping[str, Any] | None = None, **options) -> DataFrame:
    return Responder(graph, tables, query, params, **options).response()

"""Matching a query's pattern: one row for each way to bind its positions.

A level with one relationship extends its pattern by an inner join, so a parent without a match
disappears. A level with several relationships is a branch point: each relationship is a fragment
of its own, left-joined on the branch point's key, so a parent keeps its place without matches.
Positions that can bind the same row are guarded against it; a guard between fragments belongs to
the join's condition, where it turns a match into none instead of dropping the parent.

Every edge is an equi-join of keys. Where an edge lies in the table of one of its ends and repeats
that end's key, and the key is declared unique (``key_unique``), the vertex scan carries the edge's
other key and no join of the table with itself is made. A branch doesn't read its branch point again, as the join with it
implies that the row is there.

A vertex type may be declared a ``hub``: few rows that very many lead to. Where many rows meet many
others in one, their pairs are dealt over cells: every row of the left falls in one cell by its
hash, and the right is copied to each. A hub has cells in proportion to its rows of the left, so
what is copied grows with the tables and not with the number of hubs. So the pairs of a single hub
are made by many tasks, in memory that holds one hub's rows of the right and no pairs. Branches that
meet in a hub are joined last; those that meet in the same one share the cells, and the pairs of the
first don't travel before they meet the next.

Output columns: ``v<n>_k`` (or ``_k0``, ``_k1``, ...) is the key of position n and ``v<n>_c<m>`` its
m-th field; positions are numbered in the order of the query, a branch taking a number for its
branch point.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Direction, EdgeElement, PropertyGraph, Relationship, VertexType
from ..plans.query import MOST_DEPTH, Level, Param, validate
from ..sources.tables import Tables


#: Cells that the pairs of one hub are dealt over if it has all rows, and the partitions that hold the cells.
CELLS, CELL_PARTITIONS = 64, 128
#: Rows of the left in a cell below which they don't spread a hub's pairs.
FEW = 8


@dataclass
class Position:
    number: int
    owner: str
    types: tuple[VertexType, ...]
    repeats: bool = False  # several rows lead to one of it

    @property
    def alias(self) -> str:
        return f"v{self.number}"

    @property
    def keys(self) -> list[str]:
        width = len(self.types[0].key)
        return [f"{self.alias}_k"] if width == 1 else [f"{self.alias}_k{i}" for i in range(width)]

    @property
    def join_keys(self) -> list[str]:
        width = len(self.types[0].key)
        return [f"{self.alias}_j"] if width == 1 else [f"{self.alias}_j{i}" for i in range(width)]

    @property
    def tag(self) -> str | None:
        """The column that says which table a row comes from, where there are several."""
        return f"{self.alias}_t" if len(self.types) > 1 else None

    @property
    def hub(self) -> bool:
        return any(t.hub for t in self.types)

    @property
    def table_name(self) -> Column:
        return F.col(self.tag) if self.tag else F.lit(self.types[0].table)

    def overlaps(self, other: Position) -> bool:
        return bool({t.table for t in self.types} & {t.table for t in other.types})


@dataclass
class Matched:
    """A level of the query with the columns that hold it."""

    level: Level
    position: Position
    fields: list[tuple[str, str, str]]  # response key, field, column
    fragment: Fragment
    children: list[Matched] = field(default_factory=list)


@dataclass
class Fragment:
    frame: DataFrame | None
    parent: Fragment | None = None
    on: Column | None = None
    branch_point: Position | None = None
    start: Position | None = None  # the branch point as the fragment's own columns name it
    many: bool = False  # many rows of the branch lead to one branch point
    paired: bool = False  # holds all pairs of a hub
    positions: list[tuple[Position, list[str]]] = field(default_factory=list)  # with the columns that hold the key

    def joined(self) -> DataFrame:
        """The fragments from the root down to this one, joined."""
        if self.parent is None:
            return self.frame
        return self.parent.joined().join(self.frame, self.on, "left")


def distinct_guard(a: Position, left: list[str], b: Position, right: list[str]) -> Column:
    """Two positions don't hold the same row. Keys of several columns are compared null-safely, as
    a component may be null; rows of different tables are never the same."""
    if len(left) == 1:
        guard = F.col(left[0]) != F.col(right[0])
    else:
        guard = reduce(lambda a, b: a | b, [~F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])
    if a.tag or b.tag:
        guard = guard | (a.table_name != b.table_name)
    return guard


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in zip(left, right, strict=True)])


def _dealt(frame: DataFrame) -> DataFrame:
    return frame.repartition(CELL_PARTITIONS, *frame.columns)


def _hubs(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(hub_0, .., hub_rows, hub_cells), a row for each hub: its rows and its share of the cells."""
    rows = frame.groupBy(*[F.col(k).alias(f"hub_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("hub_rows"))
    gathered = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("hubs"), F.sum("hub_rows").alias("all_rows"))
    return gathered.select(F.inline("hubs"), "all_rows").select(*rows.columns, F.ceil(CELLS * F.col("hub_rows") / F.col("all_rows")).cast("int").alias("hub_cells"))


def _at_hub(frame: DataFrame, keys: list[str], hubs: DataFrame, how: str) -> DataFrame:
    return frame.join(F.broadcast(hubs), _same(keys, [f"hub_{i}" for i in range(len(keys))]), how)


def _left_cells(left: DataFrame, keys: list[str], hubs: DataFrame | None) -> DataFrame:
    """Deal rows over the cells of their hubs. Rows without a hub meet nothing and may lie anywhere."""
    cell = F.xxhash64(*left.columns)
    if hubs is None:
        dealt = left.withColumn("left_cell", F.pmod(cell, F.lit(CELLS)).cast("int"))
    else:
        columns = left.columns
        dealt = _at_hub(left, keys, hubs, "left").select(*columns, F.pmod(cell, F.coalesce("hub_cells", F.lit(CELLS))).cast("int").alias("left_cell"))
    return dealt.repartition(CELL_PARTITIONS, *keys, "left_cell")


def _meet(left: DataFrame, right: DataFrame, on: Column, keys: list[str], hubs: DataFrame | None, how: str) -> DataFrame:
    """The join of dealt rows with the copies of the right. A row of the left lies in one cell, so
    a left join keeps a row without a match once."""
    columns = right.columns
    cells = F.lit(CELLS)
    if hubs is not None:
        right, cells = _at_hub(right, keys, hubs, "inner"), F.col("hub_cells")
    right = right.select(*columns, F.explode(F.sequence(F.lit(0), cells - 1)).alias("right_cell")).repartition(CELL_PARTITIONS, *keys, "right_cell")
    # Not broadcast: a size is estimated without the copies.
    return left.join(right.hint("merge"), on & (F.col("left_cell") == F.col("right_cell")), how).drop("right_cell")


def _in_cells(left: DataFrame, right: DataFrame, on: Column, left_keys: list[str], right_keys: list[str], how: str, counted: DataFrame | None) -> DataFrame:
    """The join of many rows with many that share a key. The hubs' shares are those of the rows of
    ``counted``; without it every hub has all cells."""
    hubs = None if counted is None else _hubs(counted, left_keys)
    return _meet(_left_cells(left, left_keys, hubs), right, on, right_keys, hubs, how).drop("left_cell")


def _all_in_cells(left: DataFrame, rights: list[tuple[DataFrame, Column, list[str]]], keys: list[str], counted: DataFrame | None) -> DataFrame:
    """The left joins of many rows with several branches (rows, condition, keys) of the same hubs.
    All meet in the cells that the left was dealt over. The rows of hubs that have few don't spread
    so, and neither do they have many pairs with one branch: those are dealt again."""
    if counted is None:
        dealt = _left_cells(left, keys, None)
        for right, on, right_keys in rights:
            dealt = _meet(dealt, right, on, right_keys, None, "left")
        return dealt.drop("left_cell")
    columns = left.columns
    hubs = _hubs(counted, keys)
    few = F.col("hub_rows") < FEW * F.col("hub_cells")
    at = _at_hub(left, keys, hubs, "left")
    spread = _left_cells(at.where(~few).select(*columns), keys, hubs.where(~few))
    again = at.where(few | F.col("hub_rows").isNull()).select(*columns)
    every = hubs.where(few).withColumn("hub_cells", F.lit(CELLS))
    for right, on, right_keys in rights:
        spread = _meet(spread, right, on, right_keys, hubs.where(~few), "left")
        again = _meet(_left_cells(again, keys, every), right, on, right_keys, every, "left").drop("left_cell")
    return spread.drop("left_cell").unionByName(again)


class Matcher:
    """Plans one query. ``rows`` is the flat result; ``root`` says where each level lies in it."""

    def __init__(self, graph: PropertyGraph, tables: Tables, query: Level, params: Mapping[str, Any] | None = None, most_depth: int = MOST_DEPTH):
        graph.types_of(query.name)
        validate(graph, query, query.name, most_depth)
        self.graph, self.tables, self.params = graph, tables, params or {}
        self._numbers = 0
        self._path: list[tuple[Position, Fragment]] = []
        self.fragments: list[Fragment] = [Fragment(None)]
        self.order: list[str] = []
        self._outputs: list[str] = []
        self.root = self._vertex(query, query.name, self.fragments[0], None)

    @property
    def rows(self) -> DataFrame:
        """One row for each match, unordered."""
        frame = self.fragments[0].frame
        met: set[int] = set()  # hubs that many rows were joined with
        paired = any(f.paired for f in self.fragments)
        # What first holds a position, before other branches widen it, has much the same shares.
        holds = {p.number: frame for p, _ in self.fragments[0].positions}
        piled = False  # a task may hold all rows of a hub
        waiting = self._join_order()
        while waiting:
            branch = waiting.pop(0)
            point = branch.branch_point
            if not (point.hub and branch.many):
                frame = (_dealt(frame) if piled else frame).join(branch.frame, branch.on, "left")
                piled = False
                holds |= {p.number: frame for p, _ in branch.positions}
            elif point.repeats or point.number in met:
                together = [branch]
                while waiting and waiting[0].branch_point is point and waiting[0].many:
                    together.append(waiting.pop(0))
                rights = [(b.frame, b.on, [*b.start.join_keys, *([b.start.tag] if point.tag else [])]) for b in together]
                left = [*point.keys, *([point.tag] if point.tag else [])]
                counted = None if paired else holds[point.number]
                if len(rights) == 1:
                    right, on, keys = rights[0]
                    frame = _in_cells(frame, right, on, left, keys, "left", counted)
                else:
                    frame = _all_in_cells(frame, rights, left, counted)
                met.add(point.number)
                paired, piled = True, False
            else:
                frame = frame.join(branch.frame, branch.on, "left")
                met.add(point.number)
                piled = True
                holds |= {p.number: frame for p in (point, *[p for p, _ in branch.positions])}
        return frame.select(*self._outputs)

    def _join_order(self) -> list[Fragment]:
        """The branches, each after its parent: those that meet in hubs last, and of them those
        first that branch further."""
        parents = [id(f.parent) for f in self.fragments]
        last = {id(f): (f.branch_point.hub and f.many, id(f) not in parents) for f in self.fragments[1:]}
        waiting, joined, out = self.fragments[1:], {id(self.fragments[0])}, []
        while waiting:
            branch = min((f for f in waiting if id(f.parent) in joined), key=lambda f: last[id(f)])
            waiting = [f for f in waiting if f is not branch]
            joined.add(id(branch))
            out.append(branch)
        return out

    @property
    def columns(self) -> list[str]:
        return list(self._outputs)

    def ordered(self) -> DataFrame:
        """The rows in the order of every level's key, outermost first, nulls last."""
        return self.rows.orderBy(*[F.col(c).asc_nulls_last() for c in self.order])

    def _new_position(self, owner: str) -> Position:
        position = Position(self._numbers, owner, self.graph.types_of(owner))
        self._numbers += 1
        return position

    def _condition(self, level: Level, field_: str, column: Column) -> Column:
        value = level.where[field_]
        value = value.value(self.params) if isinstance(value, Param) else value
        # A null argument compares as null and matches no row.
        return column == F.lit(value)

    def _scan(self, position: Position, level: Level, extra: Mapping[str, str]) -> tuple[DataFrame, list[tuple[str, str, str]]]:
        """The vertices of a position that pass its filters; ``extra`` maps further output columns
        to the columns that hold them."""
        fields = [(k, f, f"{position.alias}_c{i}") for i, (k, f) in enumerate(level.named_fields())]
        parts = []
        for kind in position.types:
            rows = self.tables(kind.table)
            for f in level.where:
                rows = rows.where(self._condition(level, f, F.col(kind.fields[f])))
            columns = [F.col(c).alias(k) for c, k in zip(kind.key, position.keys, strict=True)]
            columns += [F.col(kind.fields[f]).alias(c) for _, f, c in fields]
            columns += [F.col(c).alias(out) for out, c in extra.items()]
            if position.tag:
                columns.append(F.lit(kind.table).alias(position.tag))
            parts.append(rows.select(*columns))
        return reduce(DataFrame.unionByName, parts), fields

    @staticmethod
    def _ends(element: EdgeElement, direction: Direction) -> tuple[tuple[str, tuple[str, ...]], tuple[str, tuple[str, ...]]]:
        """(type, key columns) of the near and of the far end."""
        ends = ((element.source, element.source_key), (element.destination, element.destination_key))
        return ends if direction is Direction.OUT else ends[::-1]

    def _lies_with(self, owner: Position, rel: Relationship, far: bool) -> EdgeElement | None:
        """The one edge element of a hop, if it lies in the table of its far (near) end and repeats
        that end's key, which is unique."""
        elements = self.graph.elements(owner.owner, rel)
        if len(elements) != 1 or owner.tag:
            return None
        element = elements[0]
        type_, key = self._ends(element, rel.direction)[1 if far else 0]
        kind = self.graph.vertices[type_]
        return element if kind.key_unique and element.table == kind.table and key == kind.key else None

    def _edges(self, near: Position, far: Position, rel: Relationship, out: str) -> DataFrame:
        parts = []
        for element in self.graph.elements(near.owner, rel):
            (near_type, near_key), (far_type, far_key) = self._ends(element, rel.direction)
            columns = [F.col(c).alias(f"{out}_n{i}") for i, c in enumerate(near_key)]
            columns += [F.col(c).alias(f"{out}_f{i}") for i, c in enumerate(far_key)]
            columns += [F.lit(self.graph.vertices[near_type].table).alias(f"{out}_nt"), F.lit(self.graph.vertices[far_type].table).alias(f"{out}_ft")]
            parts.append(self.tables(element.table).select(*columns))
        return reduce(DataFrame.unionByName, parts)

    def _vertex(self, level: Level, owner: str, fragment: Fragment, hop: tuple[Position, list[str], Relationship] | None) -> Matched:
        """Bind a position in ``fragment``. ``hop`` is the position that it is reached from, the
        columns that hold that position's key and the relationship."""
        position = self._new_position(owner)
        carried = {}
        if len(level.follow) == 1:  # the next hop may need an edge's key that lies here
            rel = self.graph.relationships_of(owner)[level.follow[0].name]
            if element := self._lies_with(position, rel, far=False):
                carried = {f"{position.alias}_x{i}": c for i, c in enumerate(self._ends(element, rel.direction)[1][1])}
        if hop is None:
            fragment.frame, fields = self._scan(position, level, carried)
        else:
            fields = self._reach(position, level, fragment, hop, carried)
        for earlier, keys in fragment.positions:
            if earlier.overlaps(position):
                fragment.frame = fragment.frame.where(distinct_guard(earlier, keys, position, position.keys))
        fragment.positions.append((position, position.keys))
        for ancestor, home in self._path:
            # The branch point is the fragment's first position, guarded above.
            if home is not fragment and ancestor is not fragment.branch_point and ancestor.overlaps(position):
                fragment.on = fragment.on & distinct_guard(position, position.keys, ancestor, ancestor.keys)
        self.order += position.keys
        self._outputs += position.keys + [c for _, _, c in fields]
        matched = Matched(level, position, fields, fragment)
        self._path.append((position, fragment))
        split = len(level.follow) > 1
        for child in level.follow:
            rel = self.graph.relationships_of(owner)[child.name]
            if split:
                branch, start = self._branch(position, fragment)
                matched.children.append(self._vertex(child, rel.to, branch, (start, start.join_keys, rel)))
            else:
                matched.children.append(self._vertex(child, rel.to, fragment, (position, position.keys, rel)))
        self._path.pop()
        return matched

    def _branch(self, point: Position, parent: Fragment) -> tuple[Fragment, Position]:
        """A fragment that begins at a branch point: only its key, which the join checks."""
        start = self._new_position(point.owner)
        fragment = Fragment(None, parent, _same(start.join_keys, point.keys), point, start)
        if start.tag:
            fragment.on = fragment.on & (F.col(start.tag) == F.col(point.tag))
        fragment.positions.append((start, start.join_keys))
        self.fragments.append(fragment)
        return fragment, start

    def _reach(self, position: Position, level: Level, fragment: Fragment, hop: tuple[Position, list[str], Relationship], carried: dict[str, str]) -> list[tuple[str, str, str]]:
        """Join the position with what its fragment holds so far."""
        near, near_keys, rel = hop
        frame = fragment.frame
        with_far = self._lies_with(near, rel, far=True)
        with_near = self._lies_with(near, rel, far=False)
        if with_far is not None:
            (_, near_key), _ = self._ends(with_far, rel.direction)
            out = [f"{position.alias}_n{i}" for i in range(len(near_key))] if frame is not None else near_keys
            rows, fields = self._scan(position, level, carried | dict(zip(out, near_key, strict=True)))
            rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in position.keys]))
            position.repeats = near.repeats
            fragment.many = fragment.many or frame is None
            if frame is None:
                fragment.frame = rows
            elif near.hub and near.repeats:
                fragment.frame = _in_cells(frame, rows, _same(near_keys, out), near_keys, out, "inner", None if fragment.paired else frame).drop(*out)
                fragment.paired = True
            else:
                fragment.frame = frame.join(rows, _same(near_keys, out)).drop(*out)
            return fields
        rows, fields = self._scan(position, level, carried)
        position.repeats = True
        if with_near is not None:
            _, (_, far_key) = self._ends(with_near, rel.direction)
            kind = self.graph.vertices[near.owner]
            far = [f"{near.alias}_x{i}" for i in range(len(far_key))]
            if frame is None:  # a branch: the edge's table gives the branch point's key
                frame = self.tables(kind.table).select(*[F.col(c).alias(k) for c, k in zip(kind.key, near_keys, strict=True)], *[F.col(c).alias(x) for c, x in zip(far_key, far, strict=True)])
            else:
                frame = frame.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in near_keys]))
            fragment.frame = frame.join(rows, _same(far, position.keys)).drop(*far)
            return fields
        name = f"e{position.number}"
        edges = self._edges(near, position, rel, name)
        near_cols, far_cols = [f"{name}_n{i}" for i in range(len(near_keys))], [f"{name}_f{i}" for i in range(len(position.keys))]
        to_far = _same(far_cols, position.keys)
        if position.tag:
            to_far = to_far & (F.col(f"{name}_ft") == F.col(position.tag))
        if frame is None:
            tags = [F.col(f"{name}_nt").alias(near.tag)] if near.tag else []
            frame = edges.select("*", *[F.col(c).alias(k) for c, k in zip(near_cols, near_keys, strict=True)], *tags)
        else:
            to_near = _same(near_keys, near_cols)
            if near.tag:
                to_near = to_near & (F.col(near.tag) == F.col(f"{name}_nt"))
            frame = frame.join(edges, to_near)
        fragment.frame = frame.join(rows, to_far).drop(*near_cols, *far_cols, f"{name}_nt", f"{name}_ft")
        return fields


def match(graph: PropertyGraph, tables: Tables, query: Level, params: Mapping[str, Any] | None = None, most_depth: int = MOST_DEPTH) -> DataFrame:
    """The flat rows of a query, ordered by every level's key."""
    return Matcher(graph, tables, query, params, most_depth).ordered()


"""Matches and responses against a plain matcher over random small graphs."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from vertexloom.errors import DepthExceeded, GraphError, QueryError
from vertexloom.operators.match import Matcher, match
from vertexloom.operators.respond import Responder
from vertexloom.plans.graph import Direction, EdgeElement, Interface, PropertyGraph, Relationship, VertexType
from vertexloom.plans.query import Level, Param
from vertexloom.sources.tables import Tables

PERSON = VertexType("Person", "person", ("id",), {"name": "name"}, {"follows": Relationship("follows", "Person"), "followedBy": Relationship("follows", "Person", Direction.IN), "likes": Relationship("likes", "Thing")})
THING = VertexType("Thing", "thing", ("a", "b"), {"title": "title"}, {"likedBy": Relationship("likes", "Person", Direction.IN), "near": Relationship("near", "Thing")})
GRAPH = PropertyGraph(
    [PERSON, THING],
    [
        EdgeElement("follows", "follows", "Person", ("s",), "Person", ("d",)),
        EdgeElement("likes", "likes", "Person", ("p",), "Thing", ("ta", "tb")),
        EdgeElement("near", "near", "Thing", ("a1", "b1"), "Thing", ("a2", "b2")),
    ],
)


def tables(spark, data):
    kinds = {"person": "id string, name string", "thing": "a string, b string, title string", "follows": "s string, d string", "likes": "p string, ta string, tb string", "near": "a1 string, b1 string, a2 string, b2 string"}
    return Tables.of({n: spark.createDataFrame(data.get(n, []), k) for n, k in kinds.items()})


KEYS = {"Person": (0,), "Thing": (0, 1)}
EDGES = {"follows": ("follows", (0,), (1,)), "likes": ("likes", (0,), (1, 2)), "near": ("near", (0, 1), (2, 3))}


def brute(data, level, owner, bound, row):
    """Objects that a plain reading of the query gives: chains drop, branches keep."""
    rel = GRAPH.vertices[owner].relationships

    def key(kind, r):
        return tuple(r[i] for i in KEYS[kind])

    def neighbours(r, name):
        label, source, dest = EDGES[rel[name].label]
        if rel[name].direction is Direction.IN:
            source, dest = dest, source
        other = rel[name].to
        mine = key(owner, r)
        for e in data[label]:
            if None in mine or tuple(e[i] for i in source) != mine:
                continue
            yield from (o for o in data[other.lower()] if None not in key(other, o) and key(other, o) == tuple(e[i] for i in dest))

    bound = [*bound, (owner, key(owner, row))]
    out = {k: row[-1] for k, _ in level.named_fields()}
    for child in level.follow:
        seen = {}
        for other in neighbours(row, child.name):
            kind = rel[child.name].to
            if (kind, key(kind, other)) in bound:
                continue
            if any(other[-1] != v for v in child.where.values()):
                continue
            made = brute(data, child, kind, bound, other)
            if made is not None:
                seen[key(kind, other)] = made
        if len(level.follow) == 1 and not seen:
            return None
        out[child.response_key] = [seen[k] for k in sorted(seen)]
    return out


def random_level(rng, owner, depth):
    names = list(GRAPH.vertices[owner].relationships)
    rng.shuffle(names)
    follow = []
    for name in names[: rng.randint(0, 2 if depth < 3 else 0)]:
        child = random_level(rng, GRAPH.vertices[owner].relationships[name].to, depth + 1)
        where = {list(GRAPH.vertices[GRAPH.vertices[owner].relationships[name].to].fields)[0]: "x"} if rng.random() < 0.2 else {}
        follow.append(Level(name, child.fields, where, child.follow))
    return Level(owner, (list(GRAPH.vertices[owner].fields)[0],), {}, tuple(follow))


@pytest.mark.parametrize("seed", range(25))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    people = [(f"p{i}", rng.choice("xyz")) for i in range(5)]
    things = [(a, b, rng.choice("xy")) for a, b in itertools.product(("a b", "a"), ("c", "b c"))]
    data = {
        "person": people,
        "thing": things,
        "follows": list({(rng.choice(people)[0], rng.choice(people)[0]) for _ in range(9)}),
        "likes": list({(rng.choice(people)[0], *rng.choice(things)[:2]) for _ in range(6)}),
        "near": list({(*rng.choice(things)[:2], *rng.choice(things)[:2]) for _ in range(6)}),
    }
    owner = rng.choice(["Person", "Thing"])
    query = random_level(rng, owner, 0)
    expected = [o for r in sorted(data[owner.lower()]) if (o := brute(data, query, owner, [], r)) is not None]
    response = Responder(GRAPH, tables(spark, data), query).response().collect()[0]["response"]
    assert json.loads(response) == {owner: expected}


def test_flat_columns_and_order(spark):
    data = {"person": [("2", "b"), ("1", "a"), ("3", "c")], "follows": [("1", "2"), ("1", "3"), ("2", "1"), ("1", "1")]}
    query = Level("Person", ("name",), follow=(Level("follows", ("name",)), Level("followedBy", ("name",))))
    planned = Matcher(GRAPH, tables(spark, data), query)
    assert planned.columns == ["v0_k", "v0_c0", "v2_k", "v2_c0", "v4_k", "v4_c0"]
    rows = [tuple(r) for r in planned.ordered().collect()]
    assert rows == [("1", "a", "2", "b", "2", "b"), ("1", "a", "3", "c", "2", "b"), ("2", "b", "1", "a", "1", "a"), ("3", "c", None, None, "1", "a")]


def test_partly_null_keys(spark):
    data = {"thing": [("a", None, "t"), (None, None, "u"), ("a", "b", "v")], "near": [("a", "b", "a", None)]}
    objects = Responder(GRAPH, tables(spark, data), Level("Thing", ("title",))).response().collect()[0]["response"]
    assert objects == '{"Thing":[{"title":"v"},{"title":"t"}]}'
    assert match(GRAPH, tables(spark, data), Level("Thing", ("title",))).count() == 3


def test_null_argument_matches_nothing(spark):
    data = {"person": [("1", None), ("2", "a")]}
    assert match(GRAPH, tables(spark, data), Level("Person", ("name",), {"name": Param("n")})).count() == 0
    assert match(GRAPH, tables(spark, data), Level("Person", ("name",), {"name": Param("n")}), {"n": "a"}).count() == 1


def test_empty_response(spark):
    assert Responder(GRAPH, tables(spark, {}), Level("Person", ("name",))).response().collect()[0][0] == '{"Person":[]}'


def test_interface_keeps_equal_keys_of_two_tables_apart(spark):
    bot = VertexType("Bot", "bot", ("id",), {"name": "name"}, {"follows": Relationship("follows", "Person")})
    person = VertexType("Person", "person", ("id",), {"name": "name"}, {"follows": Relationship("follows", "Person")})
    graph = PropertyGraph(
        [person, bot],
        [EdgeElement("follows", "follows", "Person", ("s",), "Person", ("d",)), EdgeElement("follows", "bot_follows", "Bot", ("s",), "Person", ("d",))],
        [Interface("Actor", ("name",), ("Person", "Bot"), {"follows": Relationship("follows", "Person")})],
    )
    read = Tables.of({n: spark.createDataFrame(r, k) for n, r, k in [("person", [(1, "a"), (2, "b")], "id int, name string"), ("bot", [(1, "r")], "id int, name string"), ("follows", [(1, 2)], "s int, d int"), ("bot_follows", [(1, 1)], "s int, d int")]})
    query = Level("Actor", ("name",), follow=(Level("follows", ("name",)),))
    assert sorted(tuple(r) for r in match(graph, read, query).collect()) == [(1, "a", 2, "b"), (1, "r", 1, "a")]
    query = Level("Actor", ("name",), follow=(Level("follows", ("name",)), Level("follows", ("name",), key="again")))
    made = json.loads(Responder(graph, read, query).response().collect()[0][0])["Actor"]
    assert sorted(made, key=lambda o: o["name"]) == [{"name": "a", "follows": [{"name": "b"}], "again": [{"name": "b"}]}, {"name": "b", "follows": [], "again": []}, {"name": "r", "follows": [{"name": "a"}], "again": [{"name": "a"}]}]


def chain(depth):
    return Level("follows", ("name",), follow=(chain(depth - 1),) if depth > 1 else ())


def test_refusals(spark):
    read = tables(spark, {})
    for bad in (
        Level("Nobody", ("name",)),
        Level("Person", ("age",)),
        Level("Person", ()),
        Level("Person", ("name",), {"age": 1}),
        Level("Person", ("name",), {"name": ["a"]}),
        Level("Person", ("name", "name")),
        Level("Person", ("name",), follow=(Level("knows", ("name",)),)),
        Level("Person", ("name",), {"name": Param("n", nullable=False)}),
    ):
        with pytest.raises((QueryError, GraphError)):
            match(GRAPH, read, bad)
    with pytest.raises(DepthExceeded):
        match(GRAPH, read, Level("Person", ("name",), follow=(chain(4),)))


def test_graph_refusals():
    with pytest.raises(GraphError):
        PropertyGraph([])
    with pytest.raises(GraphError):
        PropertyGraph([PERSON])
    with pytest.raises(GraphError):
        PropertyGraph([VertexType("A", "t", ("id",), {}), VertexType("B", "t", ("id",), {})])
    with pytest.raises(GraphError):
        PropertyGraph([VertexType("A", "a", ("id",), {"x": "c", "y": "c"})])
    with pytest.raises(GraphError):
        PropertyGraph([VertexType("A", "a", ("id",), {})], [EdgeElement("e", "e", "A", ("x", "y"), "A", ("z",))])
    with pytest.raises(GraphError):
        PropertyGraph([VertexType("A", "a", ("id",), {})], [], [Interface("I", ("x",), ("A",))])
    assert GRAPH.inverse("Person", "follows") == "followedBy"


def towns():
    town = VertexType("Town", "town", ("t",), {"name": "n"}, {"people": Relationship("lives", "Person", Direction.IN), "shops": Relationship("lies", "Shop", Direction.IN)}, key_unique=True, hub=True)
    person = VertexType("Person", "people", ("p",), {"name": "m"}, {"town": Relationship("lives", "Town")}, key_unique=True)
    shop = VertexType("Shop", "shops", ("s",), {"name": "o"}, key_unique=True)
    return PropertyGraph([town, person, shop], [EdgeElement("lives", "people", "Person", ("p",), "Town", ("home",)), EdgeElement("lies", "shops", "Shop", ("s",), "Town", ("place",))])


def town_tables(spark, people, shops):
    return Tables.of({"town": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "t int, n string"), "people": spark.createDataFrame(people, "p int, m string, home int"), "shops": spark.createDataFrame(shops, "s int, o string, place int")})


def test_rows_that_meet_in_a_hub_are_kept_once(spark):
    # Town 2 has no shops, town 3 no people, town 4 neither; one person has no home.
    read = town_tables(spark, [(1, "x", 1), (2, "x", 1), (3, "y", 2), (4, "y", 2), (5, "x", None)], [(1, "q", 1), (2, "q", 1), (3, "q", 3)])
    both = (Level("people", ("name",)), Level("shops", ("name",)))
    found = sorted(((r["v0_k"], r["v2_k"], r["v4_k"]) for r in Matcher(towns(), read, Level("Town", ("name",), follow=both)).rows.collect()), key=str)
    assert found == sorted([(1, p, s) for p in (1, 2) for s in (1, 2)] + [(2, 3, None), (2, 4, None), (3, None, 3), (4, None, None)], key=str)
    chain = Matcher(towns(), read, Level("Person", ("name",), follow=(Level("town", ("name",), follow=both),))).rows.collect()
    found = sorted(((r["v0_k"], r["v3_k"], r["v5_k"]) for r in chain), key=str)
    assert found == sorted([(a, 3 - a, s) for a in (1, 2) for s in (1, 2)] + [(3, 4, None), (4, 3, None)], key=str)


def test_pairs_of_one_hub_are_made_by_many_tasks(spark):
    read = town_tables(spark, [(i, "x", 1) for i in range(200)], [(i, "q", 1) for i in range(50)])
    both = (Level("people", ("name",)), Level("shops", ("name",)))
    for query, pairs in ((Level("Town", ("name",), {"name": "a"}, both), 200 * 50), (Level("Person", ("name",), follow=(Level("town", ("name",), follow=(Level("people", ("name",)),)),)), 200 * 199)):
        tasks = [r["count"] for r in Matcher(towns(), read, query).rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == pairs
        assert max(tasks) < pairs / 5


def written(spark):
    """Rows that the session's stages gave to shuffles."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_few_copies_are_made_for_many_hubs(spark):
    towns_, people = 32, 640
    read = Tables.of({"town": spark.createDataFrame([(i, "a") for i in range(towns_)], "t int, n string"), "people": spark.createDataFrame([(i, "x", i % towns_) for i in range(people)], "p int, m string, home int")})
    query = Level("Person", ("name",), follow=(Level("town", ("name",), follow=(Level("people", ("name",)),)),))
    before = written(spark)
    assert Matcher(towns(), read, query).rows.count() == people * (people // towns_ - 1)
    assert written(spark) - before < people * 10


def test_pairs_of_a_hub_stay_where_they_meet_the_next_branch(spark):
    read = town_tables(spark, [(i, "x", 1) for i in range(600)], [(i, "q", 1) for i in range(5)])
    query = Level("Person", ("name",), follow=(Level("town", ("name",), follow=(Level("people", ("name",)), Level("shops", ("name",)))),))
    before = written(spark)
    assert Matcher(towns(), read, query).rows.count() == 600 * 599 * 5
    assert written(spark) - before < 600 * 599 / 4


def test_branches_of_hubs_with_many_and_with_few_rows(spark):
    # Town 2 has no shops, the only person of town 3 meets nobody, one person has no home and one's town isn't there.
    homes = [1] * 600 + [2] * 3 + [3, None, 9]
    places = [1, 1, 3, 3, 3, 4]
    read = town_tables(spark, [(i, "x", h) for i, h in enumerate(homes)], [(i, "q", p) for i, p in enumerate(places)])
    town = Level("town", ("name",), follow=(Level("people", ("name",)), Level("shops", ("name",))))
    for follow, kept in (((town,), (1, 2, 3)), ((town, Level("town", (("again", "name"),), key="t")), (1, 2, 3, None, 9))):
        found = Matcher(towns(), read, Level("Person", ("name",), follow=follow)).rows
        person, mate, shop = ("v0_k", *[c for c in found.columns if c.endswith("_k")][2:4])
        rows = {(r[0], r[1], r[2]): r["count"] for r in found.groupBy(person, mate, shop).count().collect()}
        expected = {}
        for i, h in enumerate(homes):
            if h not in kept:
                continue
            mates = [j for j, o in enumerate(homes) if o == h and h in (1, 2, 3) and j != i] or [None]
            shops = [j for j, p in enumerate(places) if p == h] or [None]
            expected |= {(i, m, s): 1 for m in mates for s in shops}
        assert rows == expected

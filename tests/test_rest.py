"""Canonical text, constraints, drift, evolution, functions and sinks."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vertexloom.errors import ConstraintViolation, FunctionError, GraphError, QueryError, UnshapeableField
from vertexloom.functions.canonical import canonical
from vertexloom.functions.registry import Argument, Function, Functions
from vertexloom.operators.constraints import constraint_report, dangling_edges, validate
from vertexloom.operators.drift import drift
from vertexloom.operators.evolve import evolve, inverse
from vertexloom.plans.graph import Check, Column, EdgeElement, PropertyGraph, VertexType
from vertexloom.sources.catalog import Change, changes, create_tables, rewrite_table
from vertexloom.sources.sinks import markdown_head, markdown_rows, write_objects
from vertexloom.sources.tables import Tables


def spelt(spark, values, kind, **options):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(canonical(F.col("x"), df.schema["x"].dataType, "x", **options)).collect()]


def test_floats(spark):
    values = [0.0, -0.0, 1.0, 89.0, 19.9, 0.1, 1e-4, 1.5e-5, 1e-7, 100000.0, 999999.5, 1e6, 1234567.0, 1e21, -2.5, None, 1.7976931348623157e308, 0.001, 123.456]
    want = ["0", "-0", "1", "89", "19.9", "0.1", "0.0001", "1.5e-05", "1e-07", "100000", "999999.5", "1e+06", "1.234567e+06", "1e+21", "-2.5", None, "1.7976931348623157e+308", "0.001", "123.456"]
    assert spelt(spark, values, "double") == want
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="can't hold"):
            spelt(spark, [bad], "double")


def test_single_precision_halfway_between_two_spellings(spark):
    values = [0.0185546875, 0.166015625, -1333.34375, 0.1, 0.5, None, -0.0, 8388607.5]
    want = ["0.0185546875", "0.166015625", "-1333.34375", "0.1", "0.5", None, "-0", "8.3886075e+06"]
    assert spelt(spark, values, "float") == want
    assert spelt(spark, [values, None], "array<float>") == ["[" + ",".join(w or "null" for w in want) + "]", None]
    with pytest.raises(Exception, match="can't hold"):
        spelt(spark, [[float("nan")]], "array<float>")


def test_other_scalars(spark):
    assert spelt(spark, [2**53 + 1, None], "bigint") == ["9007199254740993", None]
    assert spelt(spark, [Decimal("89.00"), Decimal("0.10")], "decimal(10,2)") == ["89.00", "0.10"]
    assert spelt(spark, ['a"b\\c\n\x01<>& é', "plain", ""], "string") == ['"a\\"b\\\\c\\n\\u0001\\u003c\\u003e\\u0026\\u2028é"', '"plain"', '""']
    assert spelt(spark, [True, False], "boolean") == ["true", "false"]
    assert spelt(spark, [[1, None], [], None], "array<int>") == ["[1,null]", "[]", None]
    assert spelt(spark, ['{"b": 19.90, "a": [1e2, "<"]}', None], "string", json_text=True) == ['{"a":[1e2,"\\u003c"],"b":19.90}', None]
    with pytest.raises(UnshapeableField):
        spelt(spark, [datetime.date(2020, 1, 1)], "date")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_times_do_not_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT timestamp'2024-03-01T12:00:00.120+02:00' AS x UNION ALL SELECT timestamp'2024-01-01T00:00:00Z'")
        assert sorted(r[0] for r in df.select(canonical(F.col("x"), df.schema["x"].dataType)).collect()) == ['"2024-01-01T00:00:00Z"', '"2024-03-01T10:00:00.12Z"']
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


KIND = VertexType("A", "a", ("id",), {"n": "n"}, unique=(("n", "m"),), checks=(Check("positive", "n > 0"),), columns={"id": Column("bigint", False), "n": Column("int"), "m": Column("int")})


def test_constraints(spark):
    read = Tables.of({"a": spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, -1, None), (None, None, 5), (None, 3, None)], "id bigint, n int, m int")})
    found = {r["constraint"]: (r["code"], r["broken"]) for r in constraint_report(read, KIND).collect()}
    assert found == {"a_id_key": ("23505", 1), "a_n_m_unique": ("23505", 1), "positive": ("23514", 1), "a_id_required": ("23502", 2)}
    with pytest.raises(ConstraintViolation):
        validate(read, KIND)
    validate(Tables.of({"a": spark.createDataFrame([(1, 1, 1)], "id bigint, n int, m int")}), KIND)


def test_dangling_edges(spark):
    graph = PropertyGraph([KIND], [EdgeElement("e", "e", "A", ("s",), "A", ("d",))])
    read = Tables.of({"a": spark.createDataFrame([(1, 1, 1)], "id bigint, n int, m int"), "e": spark.createDataFrame([(1, 2), (None, 1), (3, 1)], "s bigint, d bigint")})
    assert {r["end"]: r["dangling"] for r in dangling_edges(graph, read).collect()} == {"source": 1, "destination": 1}


def test_drift(spark):
    graph = PropertyGraph([KIND, VertexType("B", "b", ("id",), {})])
    read = Tables.of({"a": spark.createDataFrame([], "id int, n int, extra int")})
    assert [(f.kind, f.element) for f in drift(graph, read)] == [("missing_element", "b"), ("missing_property", "a"), ("type_mismatch", "a")]
    assert ("unexpected_property", "a") in [(f.kind, f.element) for f in drift(graph, read, strict=True)]


def test_evolve(spark):
    rows = spark.createDataFrame([(1, "7")], "old int, n string")
    after = {"id": Column("bigint", renamed_from="old"), "n": Column("int"), "new": Column("string", False, "'x'")}
    kind = VertexType("A", "a", ("id",), {}, columns=after)
    made = evolve(rows, kind)
    assert made.dtypes == [("id", "bigint"), ("n", "int"), ("new", "string")]
    assert [tuple(r) for r in made.collect()] == [(1, 7, "x")]
    back = VertexType("A", "a", ("old",), {}, columns=inverse({"old": Column("int"), "n": Column("string")}, after))
    assert evolve(made, back, drop_others=True).collect() == rows.collect()
    with pytest.raises(GraphError):
        evolve(rows, VertexType("A", "a", ("id",), {}, columns={"z": Column("int", False)}))
    with pytest.raises(GraphError):
        evolve(rows, VertexType("A", "a", ("id",), {}, owned=False))
    with pytest.raises(GraphError):
        evolve(made.withColumn("old", F.lit(1)), kind)


def test_tables_in_the_catalog(spark):
    kind = VertexType("A", "vl_a", ("id",), {"n": "n"}, columns={"id": Column("bigint"), "n": Column("string")})
    for t in ("vl_a", "vl_a2"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    try:
        assert create_tables(spark, PropertyGraph([kind])) == ["vl_a"]
        assert create_tables(spark, PropertyGraph([kind])) == []
        spark.sql("INSERT INTO vl_a VALUES (1, '7')")
        new = VertexType("A", "vl_a", ("id",), {"m": "m"}, columns={"id": Column("bigint"), "m": Column("int", renamed_from="n"), "x": Column("string", default="'d'")})
        assert changes(spark.table("vl_a"), new) == [Change("add", "x", "string"), Change("rename", "m", "n"), Change("retype", "m", "string to int")]
        assert [tuple(r) for r in rewrite_table(spark, new, "vl_a2").collect()] == [(1, 7, "d")]
        assert changes(spark.table("vl_a2"), new) == []
        with pytest.raises(GraphError):
            rewrite_table(spark, new, "vl_a2")
    finally:
        for t in ("vl_a", "vl_a2"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_functions(spark):
    calls = Functions(spark)

    def queue(digest, user=None, priority=5):
        if digest == "bad":
            raise ValueError("refused")
        return f"{digest}/{user}/{priority}"

    calls.register(Function("queue", queue, (Argument("digest", required=True), Argument("user"), Argument("priority"))))
    calls.register(Function("touch", lambda: None, void=True))
    assert calls.call("queue", digest="d") == "d/None/5"
    assert calls.call("queue", digest="d", priority=None) == "d/None/None"
    assert calls.call("touch") is True
    for bad in ({"digest": None}, {"digest": "d", "other": 1}):
        with pytest.raises(QueryError):
            calls.call("queue", **bad)
    with pytest.raises(FunctionError):
        calls.call("queue", digest="bad")
    with pytest.raises(QueryError):
        calls.call("missing")
    with pytest.raises(GraphError):
        calls.register(Function("f", queue, (Argument("Digest"),)))
    calls.read_only = True
    with pytest.raises(FunctionError) as refused:
        calls.call("touch")
    assert refused.value.code == "25006"


def test_sql_functions(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION add_up(a INT, b INT DEFAULT 5) RETURNS INT RETURN a + b")
    calls = Functions(spark)
    calls.sql_function("add_up", (Argument("a"), Argument("b")))
    assert calls.call("add_up", a=1) == 6
    assert calls.call("add_up", a=1, b=2) == 3
    assert calls.call("add_up", a=1, b=None) is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, s string")
    assert markdown_head(rows) == "| k | s |\n| --- | --- |"
    assert [r[0] for r in markdown_rows(rows).collect()] == ["| 1 | a\\|b |", "| 2 |  |"]
    with pytest.raises(ValueError):
        markdown_rows(rows.select(F.array("k").alias("x")))
    write_objects(spark.createDataFrame([("{}",)], "object string"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).collect()[0][0] == "{}"


def test_uuid_bytes_are_spelt_in_lower_case(spark):
    value = bytes.fromhex("00112233445566778899AABBCCDDEEFF")
    assert spelt(spark, [value, None], "binary") == ['"00112233-4455-6677-8899-aabbccddeeff"', None]
    with pytest.raises(Exception, match="a UUID has 16 bytes, not 3"):
        spelt(spark, [b"abc"], "binary")


def test_times_without_a_zone_are_read_as_utc(spark):
    from vertexloom.sources.tables import in_utc

    rows = spark.createDataFrame([(datetime.datetime(2020, 1, 2, 3, 4, 5, 60),)], "at timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            read = in_utc(rows)
            assert read.select(canonical(F.col("at"), read.schema["at"].dataType)).first()[0] == '"2020-01-02T03:04:05.00006Z"'
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

"""Queries over the commerce graph, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commerce import GRAPH, tables
from .functions.canonical import canonical
from .functions.registry import rows
from .operators.constraints import constraint_report, dangling_edges
from .operators.describe import describe
from .operators.evolve import evolve
from .operators.match import Matcher, match
from .operators.respond import Responder
from .plans.graph import Column, VertexType
from .plans.query import Level, Param
from .sources.sinks import markdown_rows
from .sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

BUILDING = {"segment": "BUILDING"}


def L(name: str, *fields, where=None, follow=(), key=None) -> Level:  # noqa: N802
    return Level(name, fields, where or {}, tuple(follow), key)


ORDERS, EVENTS = L("orders", "total"), L("events", "kind")

#: name -> (query, parameters, DuckDB SQL of its flat rows)
FLAT: dict[str, tuple[Level, dict, str]] = {
    "scan_single": (L("Customer", "name"), {}, "SELECT c_custkey AS v0_k, c_name AS v0_c0 FROM customer"),
    "scan_alias": (L("Part", ("title", "name")), {}, "SELECT p_partkey AS v0_k, p_name AS v0_c0 FROM part"),
    "scan_multi_field": (L("Order", "status", "total", "priority"), {}, "SELECT o_orderkey AS v0_k, o_orderstatus AS v0_c0, o_totalprice AS v0_c1, o_orderpriority AS v0_c2 FROM orders"),
    "filter_eq_string": (L("Customer", "name", where=BUILDING), {}, "SELECT c_custkey AS v0_k, c_name AS v0_c0 FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_eq_int": (L("Part", "name", where={"size": 15}), {}, "SELECT p_partkey AS v0_k, p_name AS v0_c0 FROM part WHERE p_size = 15"),
    "filter_eq_double": (L("Line", "number", where={"quantity": 17.0}), {}, "SELECT l_orderkey AS v0_k0, l_partkey AS v0_k1, l_suppkey AS v0_k2, l_linenumber AS v0_c0 FROM lineitem WHERE l_quantity = 17"),
    "filter_and": (L("Order", "total", where={"status": "F", "priority": "1-URGENT"}), {}, "SELECT o_orderkey AS v0_k, o_totalprice AS v0_c0 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "filter_variable": (L("Order", "total", where={"status": Param("status")}), {"status": "O"}, "SELECT o_orderkey AS v0_k, o_totalprice AS v0_c0 FROM orders WHERE o_orderstatus = 'O'"),
    "filter_default": (L("Order", "total", where={"status": Param("status", "P")}), {}, "SELECT o_orderkey AS v0_k, o_totalprice AS v0_c0 FROM orders WHERE o_orderstatus = 'P'"),
    "filter_null_no_rows": (L("Order", "total", where={"status": Param("status")}), {}, "SELECT o_orderkey AS v0_k, o_totalprice AS v0_c0 FROM orders WHERE o_orderstatus = NULL"),
    "hop_out": (L("Customer", "name", follow=[ORDERS]), {}, "SELECT c_custkey AS v0_k, c_name AS v0_c0, o_orderkey AS v1_k, o_totalprice AS v1_c0 FROM customer JOIN orders ON o_custkey = c_custkey"),
    "hop_in": (L("Order", "total", follow=[L("customer", "name")]), {}, "SELECT o_orderkey AS v0_k, o_totalprice AS v0_c0, c_custkey AS v1_k, c_name AS v1_c0 FROM orders JOIN customer ON o_custkey = c_custkey"),
    "hop_filter_child": (L("Customer", "name", follow=[L("orders", "total", where={"status": "F"})]), {}, "SELECT c_custkey AS v0_k, c_name AS v0_c0, o_orderkey AS v1_k, o_totalprice AS v1_c0 FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"),
    "chain2": (
        L("Region", "name", follow=[L("nations", "name", follow=[L("customers", "name")])]),
        {},
        "SELECT r_regionkey AS v0_k, r_name AS v0_c0, n_nationkey AS v1_k, n_name AS v1_c0, c_custkey AS v2_k, c_name AS v2_c0 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey",
    ),
    "chain3": (
        L("Region", "name", follow=[L("nations", "name", follow=[L("customers", "name", follow=[ORDERS])])]),
        {},
        "SELECT r_regionkey AS v0_k, r_name AS v0_c0, n_nationkey AS v1_k, n_name AS v1_c0, c_custkey AS v2_k, c_name AS v2_c0, o_orderkey AS v3_k, o_totalprice AS v3_c0 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey",
    ),
    "chain_inner_drops_parent": (
        L("Customer", "name", follow=[L("orders", "total", follow=[L("lines", "number")])]),
        {},
        "SELECT c_custkey AS v0_k, c_name AS v0_c0, o_orderkey AS v1_k, o_totalprice AS v1_c0, l_orderkey AS v2_k0, l_partkey AS v2_k1, l_suppkey AS v2_k2, v.l_linenumber AS v2_c0 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem e ON e.l_orderkey = o_orderkey JOIN lineitem v USING (l_orderkey, l_partkey, l_suppkey)",
    ),
    "composite_identity": (L("Turn", "role"), {}, "SELECT conv_id AS v0_k0, turn AS v0_k1, role AS v0_c0 FROM conversations"),
    "composite_chain": (
        L("Order", "total", where={"status": "P"}, follow=[L("lines", "quantity", follow=[L("part", "name")])]),
        {},
        "SELECT o_orderkey AS v0_k, o_totalprice AS v0_c0, v.l_orderkey AS v1_k0, v.l_partkey AS v1_k1, v.l_suppkey AS v1_k2, v.l_quantity AS v1_c0, p_partkey AS v2_k, p_name AS v2_c0 FROM orders JOIN lineitem e ON e.l_orderkey = o_orderkey JOIN lineitem v ON v.l_orderkey = e.l_orderkey AND v.l_partkey = e.l_partkey AND v.l_suppkey = e.l_suppkey JOIN lineitem f ON f.l_orderkey = v.l_orderkey AND f.l_partkey = v.l_partkey AND f.l_suppkey = v.l_suppkey JOIN part ON p_partkey = f.l_partkey WHERE o_orderstatus = 'P'",
    ),
    "two_labels_one_table": (
        L("Line", "number", where={"returned": "R"}, follow=[L("part", "name"), L("supplier", "name")]),
        {},
        "SELECT v.l_orderkey AS v0_k0, v.l_partkey AS v0_k1, v.l_suppkey AS v0_k2, v.l_linenumber AS v0_c0, p_partkey AS v2_k, p_name AS v2_c0, s_suppkey AS v4_k, s_name AS v4_c0 FROM lineitem v LEFT JOIN (lineitem e JOIN part ON p_partkey = e.l_partkey) ON e.l_orderkey = v.l_orderkey AND e.l_partkey = v.l_partkey AND e.l_suppkey = v.l_suppkey LEFT JOIN (lineitem f JOIN supplier ON s_suppkey = f.l_suppkey) ON f.l_orderkey = v.l_orderkey AND f.l_partkey = v.l_partkey AND f.l_suppkey = v.l_suppkey WHERE v.l_returnflag = 'R'",
    ),
    "guard_self": (
        L("Customer", "name", where={"segment": "MACHINERY"}, follow=[L("nation", "name", follow=[L("customers", "name")])]),
        {},
        "SELECT a.c_custkey AS v0_k, a.c_name AS v0_c0, n_nationkey AS v1_k, n_name AS v1_c0, b.c_custkey AS v2_k, b.c_name AS v2_c0 FROM customer a JOIN nation ON n_nationkey = a.c_nationkey JOIN customer b ON b.c_nationkey = n_nationkey WHERE a.c_mktsegment = 'MACHINERY' AND a.c_custkey <> b.c_custkey",
    ),
    "branch_two": (
        L("Customer", "name", where=BUILDING, follow=[ORDERS, EVENTS]),
        {},
        "SELECT c_custkey AS v0_k, c_name AS v0_c0, o_orderkey AS v2_k, o_totalprice AS v2_c0, event_id AS v4_k, event_type AS v4_c0 FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "branch_three": (
        L("Nation", "name", where={"key": 7}, follow=[L("region", "name"), L("customers", "name"), L("suppliers", "name")]),
        {},
        "SELECT n_nationkey AS v0_k, n_name AS v0_c0, r_regionkey AS v2_k, r_name AS v2_c0, c_custkey AS v4_k, c_name AS v4_c0, s_suppkey AS v6_k, s_name AS v6_c0 FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey = 7",
    ),
    "branch_empty_side": (
        L("Customer", "name", follow=[L("nation", "name"), EVENTS]),
        {},
        "SELECT c_custkey AS v0_k, c_name AS v0_c0, n_nationkey AS v2_k, n_name AS v2_c0, event_id AS v4_k, event_type AS v4_c0 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN events ON user_id = c_custkey",
    ),
    "branch_below_root": (
        L("Nation", "name", where={"key": 3}, follow=[L("customers", "name", follow=[ORDERS, EVENTS])]),
        {},
        "SELECT n_nationkey AS v0_k, n_name AS v0_c0, c_custkey AS v1_k, c_name AS v1_c0, o_orderkey AS v3_k, o_totalprice AS v3_c0, event_id AS v5_k, event_type AS v5_c0 FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey WHERE n_nationkey = 3",
    ),
    "branch_nested": (
        L("Nation", "name", where={"key": 5}, follow=[L("suppliers", "name"), L("customers", "name", follow=[ORDERS, EVENTS])]),
        {},
        "SELECT n_nationkey AS v0_k, n_name AS v0_c0, s_suppkey AS v2_k, s_name AS v2_c0, c_custkey AS v4_k, c_name AS v4_c0, o_orderkey AS v6_k, o_totalprice AS v6_c0, event_id AS v8_k, event_type AS v8_c0 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey WHERE n_nationkey = 5",
    ),
    "branch_cross_guard": (
        L("Customer", "name", where={"segment": "FURNITURE"}, follow=[L("events", "kind"), L("nation", "name", follow=[L("customers", "name", where=BUILDING), L("suppliers", "name")])]),
        {},
        "SELECT a.c_custkey AS v0_k, a.c_name AS v0_c0, event_id AS v2_k, event_type AS v2_c0, n_nationkey AS v4_k, n_name AS v4_c0, b.c_custkey AS v6_k, b.c_name AS v6_c0, s_suppkey AS v8_k, s_name AS v8_c0 FROM customer a LEFT JOIN events ON user_id = a.c_custkey LEFT JOIN nation ON n_nationkey = a.c_nationkey LEFT JOIN customer b ON b.c_nationkey = n_nationkey AND b.c_mktsegment = 'BUILDING' AND b.c_custkey <> a.c_custkey LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE a.c_mktsegment = 'FURNITURE'",
    ),
    "iface_alternation": (L("Party", "name", "balance"), {}, "SELECT c_custkey AS v0_k, c_name AS v0_c0, c_acctbal AS v0_c1 FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "iface_filter": (L("Party", "balance", where={"key": 7}), {}, "SELECT c_custkey AS v0_k, c_acctbal AS v0_c0 FROM customer WHERE c_custkey = 7 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey = 7"),
    "iface_hop": (
        L("Party", "name", follow=[L("nation", "name")]),
        {},
        "SELECT c_custkey AS v0_k, c_name AS v0_c0, n_nationkey AS v1_k, n_name AS v1_c0 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT s_suppkey, s_name, n_nationkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    ),
    "edge_over_labels": (L("Document", "language", follow=[L("marks", "quality", "toxic")]), {}, "SELECT d.doc_id AS v0_k, lang AS v0_c0, l.doc_id AS v1_k, quality AS v1_c0, toxic AS v1_c1 FROM documents d JOIN labels l ON l.doc_id = d.doc_id"),
    "rename_column": (L("Page", "address"), {}, "SELECT page_id AS v0_k, url AS v0_c0 FROM pages"),
}


def _flat(name: str) -> Query:
    query, params, _ = FLAT[name]
    # Rows in no order: a global sort is for results that are read in order, as ``ordered_rows``.
    return lambda spark, sf_dir: Matcher(GRAPH, tables(spark, sf_dir), query, params).rows


#: name -> (query, DuckDB SQL of the response's text)
_LIST = "'[' || coalesce(string_agg({0}, ',' ORDER BY {1}), '') || ']'"
SHAPED: dict[str, tuple[Level, str]] = {
    "shaped_root": (
        L("Part", "brand", "size", where={"size": 15}, key="parts"),
        "SELECT '{\"parts\":' || " + _LIST.format("'{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}'", "p_partkey") + " || '}' AS response FROM part WHERE p_size = 15",
    ),
    "shaped_chain": (
        L("Region", "name", key="regions", follow=[L("nations", "name", follow=[L("customers", "key")])]),
        "WITH c AS (SELECT c_nationkey AS k, " + _LIST.format("'{\"key\":' || c_custkey || '}'", "c_custkey") + " AS l FROM customer GROUP BY 1), n AS (SELECT n_regionkey AS k, "
        + _LIST.format("'{\"customers\":' || l || ',\"name\":\"' || n_name || '\"}'", "n_nationkey") + " AS l FROM nation JOIN c ON c.k = n_nationkey GROUP BY 1) SELECT '{\"regions\":' || "
        + _LIST.format("'{\"name\":\"' || r_name || '\",\"nations\":' || l || '}'", "r_regionkey") + " || '}' AS response FROM region JOIN n ON n.k = r_regionkey",
    ),
    "shaped_branch": (
        L("Customer", "segment", where=BUILDING, key="customers", follow=[L("orders", "status"), L("events", "key")]),
        "WITH o AS (SELECT o_custkey AS k, " + _LIST.format("'{\"status\":\"' || o_orderstatus || '\"}'", "o_orderkey") + " AS l FROM orders GROUP BY 1), e AS (SELECT user_id AS k, "
        + _LIST.format("'{\"key\":' || event_id || '}'", "event_id") + " AS l FROM events GROUP BY 1) SELECT c_custkey AS v0_k, "
        + "'{\"events\":' || coalesce(e.l, '[]') || ',\"orders\":' || coalesce(o.l, '[]') || ',\"segment\":\"' || c_mktsegment || '\"}' AS object"
        + " FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "shaped_empty": (L("Part", "brand", where={"size": -1}, key="parts"), "SELECT '{\"parts\":[]}' AS response"),
}


def _shaped(name: str) -> Query:
    # A response is one row, so a query that grows with the customers gives an object for each.
    whole = name != "shaped_branch"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        responder = Responder(GRAPH, tables(spark, sf_dir), SHAPED[name][0])
        return responder.response() if whole else responder.objects()

    return run


def shaped_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = L("Customer", "name", "balance", follow=[L("orders", "total", follow=[L("lines", "quantity", "price")])])
    return Responder(GRAPH, tables(spark, sf_dir), query).objects()


def shaped_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Responder(GRAPH, tables(spark, sf_dir), L("Region", "name"), type_names=True).objects()


def graph_join_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables(spark, sf_dir)
    found = match(GRAPH, read, L("Customer", "name", where=BUILDING, follow=[ORDERS]))
    sums = read("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    return found.join(sums, F.col("v1_k") == F.col("l_orderkey")).select("v0_c0", "v1_k", "quantity")


def scalar_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, strings and doubles of up to two decimals, spelt canonically."""
    rows_ = tables(spark, sf_dir)("customer")
    price = (F.col("c_custkey") % 1000).cast("double") / 4
    return rows_.select("c_custkey", canonical(F.col("c_name"), rows_.schema["c_name"].dataType).alias("name"), canonical(price, price_type(rows_, price)).alias("quarter"))


def price_type(rows_: DataFrame, column):
    return rows_.select(column.alias("x")).schema["x"].dataType


def scalar_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Responder(GRAPH, tables(spark, sf_dir), L("Vector", "label", "values")).objects()


def scalar_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Responder(GRAPH, tables(spark, sf_dir), L("Event", "props"), json_fields=frozenset({"props"})).objects()


def numeric_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = tables(spark, sf_dir)("part").select("p_partkey", F.col("p_size").cast("decimal(10,2)").alias("size"))
    return rows_.select("p_partkey", canonical(F.col("size"), rows_.schema["size"].dataType).alias("size"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir)("orders").createOrReplaceTempView("raw_rows_orders")
    return rows(spark, "SELECT o_orderkey, o_totalprice FROM raw_rows_orders WHERE o_orderstatus = :status", {"status": "F"})


def constraint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraint_report(tables(spark, sf_dir), GRAPH.vertices["Customer"])


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling_edges(GRAPH, tables(spark, sf_dir))


def evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = VertexType("Nation", "nation", ("nation_id",), {"name": "label"}, columns={"nation_id": Column("bigint", False, renamed_from="n_nationkey"), "label": Column("string", renamed_from="n_name"), "active": Column("boolean", False, "true"), "note": Column("string")})
    return evolve(tables(spark, sf_dir)("nation"), kind)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_rows(match(GRAPH, tables(spark, sf_dir), L("Region", "name")))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(spark, GRAPH, tables(spark, sf_dir))


def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(GRAPH, tables(spark, sf_dir), L("Nation", "name", follow=[L("region", "name")]))


def shaped_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Responder(GRAPH, tables(spark, sf_dir), L("Part", ("title", "name"), ("width", "size"), where={"size": 15})).objects()


def scalar_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Responder(GRAPH, tables(spark, sf_dir), L("Order", "date", where={"status": "P"})).objects()


def scalar_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a language spell it null."""
    read = tables(spark, sf_dir)
    some = Tables.of({"documents": read("documents").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))})
    return Responder(GRAPH, some, L("Document", "language")).objects()


def guard_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two different lines of one order, told apart by a key of three columns."""
    return Matcher(GRAPH, tables(spark, sf_dir), L("Line", "number", where={"returned": "R"}, follow=[L("order", "status", where={"status": "P"}, follow=[L("lines", "quantity")])])).rows


def _missing(label: str, table: str, end: str, column: str, vertices: str, key: str) -> str:
    return f"SELECT '{label}' AS label, '{table}' AS \"table\", '{end}' AS \"end\", count(*) AS dangling FROM {table} WHERE {column} NOT IN (SELECT {key} FROM {vertices} WHERE {key} IS NOT NULL)"


_DANGLING = " UNION ALL ".join(
    _missing(*x)
    for x in [
        ("in_region", "nation", "destination", "n_regionkey", "region", "r_regionkey"),
        ("in_nation", "customer", "destination", "c_nationkey", "nation", "n_nationkey"),
        ("in_nation", "supplier", "destination", "s_nationkey", "nation", "n_nationkey"),
        ("placed", "orders", "source", "o_custkey", "customer", "c_custkey"),
        ("has_line", "lineitem", "source", "l_orderkey", "orders", "o_orderkey"),
        ("of_part", "lineitem", "destination", "l_partkey", "part", "p_partkey"),
        ("supplied_by", "lineitem", "destination", "l_suppkey", "supplier", "s_suppkey"),
        ("did", "events", "source", "user_id", "customer", "c_custkey"),
        ("labelled", "labels", "source", "doc_id", "documents", "doc_id"),
    ]
)


def _number(column: str) -> str:
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


_OBJECTS = (
    f"WITH l AS (SELECT DISTINCT l_orderkey AS k, l_partkey, l_suppkey, '{{\"price\":' || {_number('l_extendedprice')} || ',\"quantity\":' || {_number('l_quantity')} || '}}' AS o FROM lineitem), ll AS (SELECT k, "
    + _LIST.format("o", "l_partkey, l_suppkey, o")
    + " AS l FROM l GROUP BY k), o AS (SELECT o_custkey AS k, "
    + _LIST.format(f"'{{\"lines\":' || ll.l || ',\"total\":' || {_number('o_totalprice')} || '}}'", "o_orderkey")
    + f" AS l FROM orders JOIN ll ON ll.k = o_orderkey GROUP BY 1) SELECT c_custkey AS v0_k, '{{\"balance\":' || {_number('c_acctbal')} || ',\"name\":\"' || c_name || '\",\"orders\":' || o.l || '}}' AS object FROM customer JOIN o ON o.k = c_custkey"
)
_VALUES = f"(SELECT string_agg({_number('x')}, ',' ORDER BY i) FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i))"


OTHERS: dict[str, tuple[Query, str | None]] = {
    "shaped_objects": (shaped_objects, _OBJECTS),
    "shaped_type_names": (shaped_type_names, "SELECT r_regionkey AS v0_k, '{\"__typename\":\"Region\",\"name\":\"' || r_name || '\"}' AS object FROM region"),
    "graph_join_table": (graph_join_table, "SELECT c_name AS v0_c0, o_orderkey AS v1_k, sum(l_quantity) AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL"),
    "scalar_canonical_json": (
        scalar_canonical_json,
        "SELECT c_custkey, '\"' || c_name || '\"' AS name, regexp_replace(CAST((c_custkey % 1000) / 4.0 AS DOUBLE)::VARCHAR, '\\.0$', '') AS quarter FROM customer",
    ),
    "scalar_list": (scalar_list, f"SELECT vec_id AS v0_k, '{{\"label\":' || label || ',\"values\":[' || {_VALUES} || ']}}' AS object FROM embeddings"),
    "scalar_json_document": (scalar_json_document, "SELECT event_id AS v0_k, '{\"props\":' || replace(props, ' ', '') || '}' AS object FROM events"),
    "numeric_cast": (numeric_cast, "SELECT p_partkey, p_size || '.00' AS size FROM part"),
    "raw_rows": (raw_rows, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    "constraint_counts": (
        constraint_counts,
        "SELECT 'customer' AS \"table\", x.* FROM (SELECT 'customer_c_custkey_key' AS \"constraint\", '23505' AS code, CAST(count(c_custkey) - count(DISTINCT c_custkey) AS BIGINT) AS broken FROM customer UNION ALL SELECT 'customer_c_name_unique', '23505', count(c_name) - count(DISTINCT c_name) FROM customer UNION ALL SELECT 'customer_balance_check', '23514', count(*) FILTER (c_acctbal <= -1000) FROM customer UNION ALL SELECT 'customer_solvent_check', '23514', count(*) FILTER (c_acctbal < 0) FROM customer UNION ALL SELECT 'customer_c_custkey_required', '23502', count(*) - count(c_custkey) FROM customer UNION ALL SELECT 'customer_c_name_required', '23502', count(*) - count(c_name) FROM customer) x",
    ),
    "dangling_edges": (dangling, _DANGLING),
    "ordered_rows": (ordered_rows, "SELECT n_nationkey AS v0_k, n_name AS v0_c0, r_regionkey AS v1_k, r_name AS v1_c0 FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY 1"),
    "shaped_alias": (shaped_alias, "SELECT p_partkey AS v0_k, '{\"title\":\"' || p_name || '\",\"width\":' || p_size || '}' AS object FROM part WHERE p_size = 15"),
    "scalar_time": (scalar_time, "SELECT o_orderkey AS v0_k, '{\"date\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z\"}' AS object FROM orders WHERE o_orderstatus = 'P'"),
    "scalar_null": (scalar_null, "SELECT doc_id AS v0_k, CASE WHEN lang IS NULL OR lang = 'fr' THEN '{\"language\":null}' ELSE '{\"language\":\"' || lang || '\"}' END AS object FROM documents"),
    "guard_composite": (
        guard_composite,
        "SELECT a.l_orderkey AS v0_k0, a.l_partkey AS v0_k1, a.l_suppkey AS v0_k2, a.l_linenumber AS v0_c0, o_orderkey AS v1_k, o_orderstatus AS v1_c0, b.l_orderkey AS v2_k0, b.l_partkey AS v2_k1, b.l_suppkey AS v2_k2, b.l_quantity AS v2_c0 FROM lineitem a JOIN lineitem e ON e.l_orderkey = a.l_orderkey AND e.l_partkey = a.l_partkey AND e.l_suppkey = a.l_suppkey JOIN orders ON o_orderkey = e.l_orderkey JOIN lineitem f ON f.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = f.l_orderkey AND b.l_partkey = f.l_partkey AND b.l_suppkey = f.l_suppkey WHERE a.l_returnflag = 'R' AND o_orderstatus = 'P' AND (a.l_orderkey, a.l_partkey, a.l_suppkey) <> (b.l_orderkey, b.l_partkey, b.l_suppkey)",
    ),
    "describe_graph": (described, None),
    "evolve_table": (evolved, "SELECT CAST(n_nationkey AS BIGINT) AS nation_id, n_name AS label, true AS active, CAST(NULL AS VARCHAR) AS note, n_regionkey FROM nation"),
    "markdown_rows": (markdown, "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region"),
}


def queries() -> dict[str, Query]:
    return {n: _flat(n) for n in FLAT} | {n: _shaped(n) for n in SHAPED} | {n: q for n, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, _, sql) in FLAT.items()} | {n: sql for n, (_, sql) in SHAPED.items()} | {n: sql for n, (_, sql) in OTHERS.items() if sql}

"""A graph over tables of orders, events and texts, used by the registered queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .plans.graph import Check, Column, Direction, EdgeElement, Interface, PropertyGraph, Relationship, VertexType
from .sources.tables import Tables, in_utc

IN = Direction.IN
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey")

GRAPH = PropertyGraph(
    vertices=[
        VertexType("Region", "region", ("r_regionkey",), {"key": "r_regionkey", "name": "r_name"}, {"nations": Relationship("in_region", "Nation", IN)}, key_unique=True, hub=True),
        VertexType(
            "Nation",
            "nation",
            ("n_nationkey",),
            {"key": "n_nationkey", "name": "n_name"},
            {"region": Relationship("in_region", "Region"), "customers": Relationship("in_nation", "Customer", IN), "suppliers": Relationship("in_nation", "Supplier", IN)},
            key_unique=True,
            hub=True,
        ),
        VertexType(
            "Customer",
            "customer",
            ("c_custkey",),
            {"key": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"},
            {"nation": Relationship("in_nation", "Nation"), "orders": Relationship("placed", "Order"), "events": Relationship("did", "Event")},
            unique=(("c_name",),),
            checks=(Check("customer_balance_check", "c_acctbal > -1000"), Check("customer_solvent_check", "c_acctbal >= 0")),
            columns={"c_custkey": Column("bigint", nullable=False), "c_name": Column("string", nullable=False)},
            key_unique=True,
        ),
        VertexType("Supplier", "supplier", ("s_suppkey",), {"key": "s_suppkey", "name": "s_name", "balance": "s_acctbal"}, {"nation": Relationship("in_nation", "Nation"), "lines": Relationship("supplied_by", "Line", IN)}, key_unique=True),
        VertexType("Part", "part", ("p_partkey",), {"key": "p_partkey", "name": "p_name", "brand": "p_brand", "size": "p_size", "price": "p_retailprice"}, {"lines": Relationship("of_part", "Line", IN)}, key_unique=True),
        VertexType(
            "Order",
            "orders",
            ("o_orderkey",),
            {"key": "o_orderkey", "status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"},
            {"customer": Relationship("placed", "Customer", IN), "lines": Relationship("has_line", "Line")},
            key_unique=True,
        ),
        VertexType(
            "Line",
            "lineitem",
            LINE_KEY,
            {"number": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "returned": "l_returnflag"},
            {"order": Relationship("has_line", "Order", IN), "part": Relationship("of_part", "Part"), "supplier": Relationship("supplied_by", "Supplier")},
        ),
        VertexType("Event", "events", ("event_id",), {"key": "event_id", "kind": "event_type", "value": "value", "props": "props"}, {"customer": Relationship("did", "Customer", IN)}, key_unique=True),
        VertexType("Document", "documents", ("doc_id",), {"key": "doc_id", "language": "lang", "source": "source", "characters": "n_chars"}, {"marks": Relationship("labelled", "Label")}, key_unique=True),
        VertexType("Label", "labels", ("doc_id",), {"quality": "quality", "toxic": "toxic"}, key_unique=True),
        VertexType("Turn", "conversations", ("conv_id", "turn"), {"conversation": "conv_id", "turn": "turn", "role": "role"}),
        VertexType("Vector", "embeddings", ("vec_id",), {"key": "vec_id", "values": "embedding", "label": "label"}, key_unique=True),
        VertexType("Page", "pages", ("page_id",), {"key": "page_id", "address": "url"}, key_unique=True),
        VertexType("Item", "benchmark", ("item_id",), {"key": "item_id"}, key_unique=True),
    ],
    edges=[
        EdgeElement("in_region", "nation", "Nation", ("n_nationkey",), "Region", ("n_regionkey",)),
        EdgeElement("in_nation", "customer", "Customer", ("c_custkey",), "Nation", ("c_nationkey",)),
        EdgeElement("in_nation", "supplier", "Supplier", ("s_suppkey",), "Nation", ("s_nationkey",)),
        EdgeElement("placed", "orders", "Customer", ("o_custkey",), "Order", ("o_orderkey",)),
        EdgeElement("has_line", "lineitem", "Order", ("l_orderkey",), "Line", LINE_KEY),
        EdgeElement("of_part", "lineitem", "Line", LINE_KEY, "Part", ("l_partkey",)),
        EdgeElement("supplied_by", "lineitem", "Line", LINE_KEY, "Supplier", ("l_suppkey",)),
        EdgeElement("did", "events", "Customer", ("user_id",), "Event", ("event_id",)),
        EdgeElement("labelled", "labels", "Document", ("doc_id",), "Label", ("doc_id",)),
    ],
    interfaces=[Interface("Party", ("key", "name", "balance"), ("Customer", "Supplier"), {"nation": Relationship("in_nation", "Nation")})],
)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables.in_directory(spark, sf_dir, resolve=in_utc)

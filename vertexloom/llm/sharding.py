"""Sharding by extendible hashing.

A directory maps prefixes of a document's hash bits to shards. A shard that holds more bytes than
the limit, and more than one document, splits on its next bit; all others stay. Sizes come from a
histogram of some bits more than the shards need on average; only prefixes that are too large even
there are looked at with more bits, so documents are hashed once and counted a few times.

The first 64 bits come from the md5 of the id, 64 more from a number of the row. So rows that
share one id still split, and every shard fits the limit unless a single document exceeds it.

Defined cases: a null text has 0 bytes; null ids hash as the empty string; repeated rows are
sharded each; a document larger than the limit has a shard of its own; an empty table gives an
empty result; other columns are not read, but carried whole by ``write_shards``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, whole_row


@dataclass(frozen=True)
class ShardSettings:
    limit_bytes: int = 16 << 20
    spare_bits: int = 5  # of a histogram, beyond what shards of equal size would need
    most_bits: int = 16  # of a histogram


def _hash_bits(text: Column) -> Column:
    """The first 64 bits of the md5 of a string, as a long."""
    digest = F.md5(text.cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _bit_string(value: Column, bits: Column) -> Column:
    return F.when(bits == 0, F.lit("")).otherwise(F.lpad(F.bin(value), bits, "0"))


def _directory(sizes: DataFrame, bits: int, limit: int) -> DataFrame:
    """(prefix, value, shard, depth, shard_bytes, shard_rows) for every value of ``bits`` bits after
    a prefix. ``shard`` is null where even the value holds too much."""
    levels = sizes.select("prefix", "value", "bytes", "rows", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("node", F.expr(f"shiftright(value, {bits} - depth)"))
    nodes = levels.groupBy("prefix", "depth", "node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1))
    first = levels.join(fits, ["prefix", "depth", "node"]).groupBy("prefix", "value").agg(F.min(F.struct("depth", "node", "shard_bytes", "shard_rows")).alias("leaf"))
    leaf = first.select("prefix", "value", F.concat("prefix", _bit_string(F.col("leaf.node"), F.col("leaf.depth"))).alias("shard"), "leaf.shard_bytes", "leaf.shard_rows")
    return sizes.select("prefix", "value").join(leaf, ["prefix", "value"], "left")


def _placed(docs: DataFrame, settings: ShardSettings, id_col: str, text_col: str, number: Column) -> DataFrame:
    """(id, number, n_bytes, shard, depth, shard_bytes) of every row; ``number`` tells rows apart."""
    row_bits = _hash_bits(F.col("number").cast("string"))
    id_bits = _hash_bits(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    open_rows = materialize(docs.select(F.col(id_col).alias("id"), number.alias("number"), size.alias("bytes"), id_bits.alias("w0"), F.lit("").alias("prefix")).withColumn("w1", row_bits), "shard-rows")
    placed = []
    word = offset = 0
    while True:
        largest = open_rows.groupBy("prefix").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0]
        if largest is None:
            break
        need = math.ceil(math.log2(max(1, largest / settings.limit_bytes))) + settings.spare_bits
        bits = min(need, settings.most_bits, 64 - offset)
        value = F.shiftrightunsigned(F.shiftleft(F.col(f"w{word}"), offset), 64 - bits).cast("int")
        valued = open_rows.withColumn("value", value)
        sizes = valued.groupBy("prefix", "value").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        directory = materialize(_directory(sizes, bits, settings.limit_bytes), "shard-directory")
        joined = valued.join(directory, ["prefix", "value"])
        offset += bits
        if offset == 64:
            word, offset = word + 1, 0
        out_of_bits = word == 2
        done = joined if out_of_bits else joined.where("shard IS NOT NULL")
        shard = F.coalesce("shard", F.concat("prefix", _bit_string(F.col("value"), F.lit(bits))))
        placed.append(done.select("id", "number", F.col("bytes").alias("n_bytes"), shard.alias("shard"), F.length(shard).cast("long").alias("depth"), F.coalesce("shard_bytes", "bytes").alias("shard_bytes")))
        if out_of_bits or directory.where("shard IS NULL").isEmpty():
            break
        longer = F.concat("prefix", _bit_string(F.col("value"), F.lit(bits))).alias("prefix")
        open_rows = materialize(joined.where("shard IS NULL").select("id", "number", "bytes", "w0", "w1", longer), "shard-rows")
    if not placed:
        return open_rows.select("id", "number", F.col("bytes").alias("n_bytes"), F.col("prefix").alias("shard"), F.lit(0).cast("long").alias("depth"), F.col("bytes").alias("shard_bytes"))
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out


def shards(docs: DataFrame, settings: ShardSettings = ShardSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_bytes, shard, depth, shard_bytes) for every row; ``shard`` holds the hash bits
    that all its documents share, ``depth`` their number."""
    placed = _placed(docs, settings, id_col, text_col, F.monotonically_increasing_id())
    return placed.select(F.col("id").alias(id_col), "n_bytes", "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, settings: ShardSettings = ShardSettings(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as Parquet, a folder ``shard=b<bits>`` for each shard. Every row goes to
    its own shard, whatever ids repeat; a column of the documents of that name stays in the files
    as ``shard_column``, or with more underscores at its end where that is taken."""
    numbered = materialize(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("number")), "shard-documents")
    read = numbered.select("number", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("body"))
    placed = _placed(read, settings, "id", "body", F.col("number")).select("number", "shard")
    names = {c.lower() for c in docs.columns}
    other = "shard_column"
    while other in names:
        other += "_"
    columns = [F.col("row").getField(c).alias(other if c.lower() == "shard" else c) for c in docs.columns]
    numbered.join(placed, "number").select(*columns, F.concat(F.lit("b"), "shard").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
    discard(numbered)


#: DuckDB SQL of the shards of documents at a limit; the first 32 bits of the hash suffice there.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents),
e AS (SELECT d.*, k, h >> (32 - k) AS p FROM d, (SELECT unnest(range(0, 33)) AS k)),
g AS (SELECT k, p, sum(bytes) AS s, count(*) AS n FROM e GROUP BY k, p),
l AS (SELECT doc_id, min(k) AS k FROM e JOIN g USING (k, p) WHERE s <= {limit} OR n <= 1 GROUP BY doc_id)
SELECT e.doc_id, CAST(e.bytes AS BIGINT) AS n_bytes, CASE WHEN e.k = 0 THEN '' ELSE substr(lpad(bin(e.h), 32, '0'), 1, CAST(e.k AS INTEGER)) END AS shard,
  CAST(e.k AS BIGINT) AS depth, CAST(g.s AS BIGINT) AS shard_bytes
FROM l JOIN e ON l.doc_id = e.doc_id AND l.k = e.k JOIN g ON g.k = e.k AND g.p = e.p
"""

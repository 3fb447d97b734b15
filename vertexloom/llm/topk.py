"""Exact top-k inner products by MaxScore.

A query's terms are the components of its vector. The bound of a term is the most that any vector
of a shard can gain by it. With the k-th best score so far as threshold, the terms of lowest bound
that together stay below it (over the terms' worst case) are non-essential: the others are
traversed for all vectors, and the non-essential ones are probed, highest bound first, only for
vectors that can still reach the threshold. A shard is traversed in steps that grow from
``FIRST_STEP`` vectors on, so that a threshold is known early, and every step starts from the
threshold of those before. The best k of all shards are merged.

The candidates fall into shards and the queries into blocks of bounded size; each pair of a shard
and a block is one group. Queries against all candidates are the contract; no vector meets
another outside such a group.

Components are turned into floor(scale * x), and scores are exact integers (float64 products
while they stay below 2 ** 53, 64-bit integers and then Python integers beyond). A component or
one of the best scores that 64 bits don't hold raises an error that says so.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do
rows with a null id; of vectors of unequal length the missing components count 0; rows that repeat
an id are candidates each (never for a query of that id), and a query's id with several distinct
vectors is asked once for each, with a list of its own from rank 1; ties go to the smaller id; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
FIRST_STEP = 64
LARGEST_STEP = 4096
PROBE_TERMS = 8


def integer_vector(vector: str, scale: int) -> Column:
    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(scale)) * x.cast("double"))
        fits = F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(2.0**63)
        return F.when(fits, scaled.cast("long")).otherwise(F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long"))

    return F.transform(F.col(vector), whole)


def usable(vector: str) -> Column:
    """No null and no non-finite component."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _steps(rows: int) -> list[tuple[int, int]]:
    """The ranges of vectors that are traversed one after the other, each twice the last."""
    out, at, size = [], 0, FIRST_STEP
    while at < rows:
        out.append((at, min(at + size, rows)))
        at, size = at + size, min(2 * size, LARGEST_STEP)
    return out


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, of equal ones those of smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def maxscore(query: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best k (scores, ids) of a query among the vectors of a shard, and how many products of
    two components they took. ``low`` and ``high`` are the extremes of each component in the shard;
    ``own`` marks what is left out."""
    bounds = np.maximum(query * low, query * high)
    terms = np.argsort(-bounds, kind="stable")
    ordered = bounds[terms]
    rest = np.concatenate([np.cumsum(ordered[::-1])[::-1], np.zeros(1, bounds.dtype)])  # the bounds of the terms from each on
    best_scores, best_ids = np.zeros(0, bounds.dtype), np.zeros(0, ids.dtype)
    products = 0
    for start, end in _steps(len(vectors)):
        part = vectors[start:end]
        full = len(best_scores) == k
        threshold = best_scores[-1] if full else None
        # Essential: as many terms as needed so that the rest alone stays below the threshold.
        below = np.flatnonzero(rest < threshold) if full else ()
        essential = max(1, int(below[0])) if len(below) else len(terms)
        rows = np.flatnonzero(~own[start:end])
        scores = (part[:, terms[:essential]] @ query[terms[:essential]])[rows]
        products += len(part) * essential
        done = essential
        while True:
            if full:
                alive = scores + rest[done] >= threshold
                rows, scores = rows[alive], scores[alive]
            if done == len(terms) or not len(rows):
                break
            probed = terms[done : done + PROBE_TERMS]
            scores = scores + part[np.ix_(rows, probed)] @ query[probed]
            products += len(rows) * len(probed)
            done += len(probed)
        if len(rows):
            all_scores = np.concatenate([best_scores, scores])
            all_ids = np.concatenate([best_ids, ids[start:end][rows]])
            keep = _first(all_scores, all_ids, k)
            best_scores, best_ids = all_scores[keep], all_ids[keep]
    return best_scores, best_ids, products


def _in_64_bits(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(2**63) <= x < 2**63 for x in scores):
        raise OverflowError("a score doesn't fit 64 bits")
    return scores.astype(np.int64)


def _search(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    names = ["query_id", "asked", "vec_id", "score"]
    if not len(queries) or not len(shard):
        return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
    width = max(queries["v"].map(len).max(), shard["v"].map(len).max())
    vectors, asked = _matrix(shard["v"], width), _matrix(queries["v"], width)
    ids = shard["id"].to_numpy()
    most = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(asked.astype(float)).max(initial=0)) * max(width, 1)
    if most < 2**53:
        vectors, asked = vectors.astype(np.float64), asked.astype(np.float64)
    elif most >= 2**62:
        vectors, asked = vectors.astype(object), asked.astype(object)
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    found = []
    for query, own_id, number in zip(asked, queries["id"], queries["asked"], strict=True):
        own = ids == own_id
        if width:
            scores, best, _ = maxscore(query, own, vectors, ids, low, high, k)
        else:
            best = np.sort(ids[~own])[:k]
            scores = np.zeros(len(best))
        found.append(pd.DataFrame({"query_id": own_id, "asked": number, "vec_id": best, "score": _in_64_bits(scores)}))
    return pd.concat(found, ignore_index=True)[names]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return (query_id, rank, vec_id, score): for every row that ``is_query`` marks, the ``k``
    other rows of highest integer inner product."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), integer_vector(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    n, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = F.xxhash64(F.monotonically_increasing_id())  # evenly, even if one id or vector repeats
    candidates = rows.select("id", "v", F.pmod(dealt, F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    # The vectors of a repeated id are told apart by a hash.
    number = F.xxhash64("v").alias("asked")
    queries = rows.where("is_query").select("id", number, "v").dropDuplicates(["id", "asked"])
    queries = queries.select("id", "asked", "v", F.pmod(F.xxhash64("id", "asked"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    group = ["shard", "block"]
    best = queries.groupBy(*group).cogroup(candidates.groupBy(*group)).applyInPandas(lambda q, c: _search(q, c, k), "query_id long, asked long, vec_id long, score long")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS asked, c.vec_id,
  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

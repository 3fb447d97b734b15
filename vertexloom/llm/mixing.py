"""Mixing sources to target weights by weighted fair queueing.

Every source has a weight and a target share of the token budget (here: of all words). The
documents of a source are shuffled by a hash of their id; each copy of a document has a virtual
finish time, the cumulative words of its source up to and with it divided by the source's target.
The copies of all sources, ordered by finish time, are cut where their words reach the budget.

Cumulative sums are taken in two steps: sums of hash ranges within a source (or of ranges of
finish time), then rows within a range. No task holds a source or the whole order, however large.
Rows that share one hash, as all rows of a null or much repeated id do, follow the others of their
range, in ranges of their own by a hash of the row's number.

Defined cases: a null text has 0 words; a null source is a source of its own, last in order; a
document without words takes none; a null id counts as the empty string in the shuffle; repeated
rows are mixed each on their own, and each keeps its own copies; equal finish times are ordered by
source, then by hash; an empty table gives an empty result; other columns are not read, but carried
whole by ``mixed_documents``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, whole_row

ROWS_IN_RANGE = 4096
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources in order, repeating
    most_copies: int = 3  # of a document, and so of its source's size


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, settings: MixSettings) -> DataFrame:
    """(source_null, source_key, source_size, target) from (source_null, source_key, size), a row
    for each source. A target is at most ``most_copies`` times the size; what that leaves over
    goes to the other sources by weight, until none is above."""
    totals = sizes.groupBy("source_null", "source_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("source_null", "source_key")
    weights = F.array(*[F.lit(w) for w in settings.weights])
    rows = totals.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(settings.weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * settings.most_copies).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_null", "source_key")
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", F.sum(F.col("source_size").cast("double")).over(everything))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("capped", F.col("cap") * weight_left <= left * F.col("weight"))
    rest = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    rest_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    rows = rows.withColumn("rest", rest).withColumn("rest_weight", rest_weight)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("rest") / F.col("rest_weight") * F.col("weight"))
    return rows.select("source_null", "source_key", "source_size", target.alias("target"))


ORDER = ["finish", "source_null", "source_key", "apart", "shuffle", "tie"]


def _decided(docs: DataFrame, settings: MixSettings, id_col: str, text_col: str, source_col: str, number: Column) -> DataFrame:
    """(id, number, size, source_size, target, taken) of every row; ``number`` tells rows apart."""
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        number.alias("number"),
        source.isNull().alias("source_null"),
        F.coalesce(source, F.lit("")).alias("source_key"),
        word_count(text_col).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
    )
    sizes = materialize(rows, "mix-sizes")
    count = sizes.count()
    digits = max(1, math.ceil(math.log(max(count / ROWS_IN_RANGE, 1), 16)))
    # At most one hash for every ROWS_IN_RANGE rows; Spark broadcasts them where they are few.
    shared = sizes.groupBy("shuffle").count().where(F.col("count") > ROWS_IN_RANGE).select("shuffle", F.lit(True).alias("apart"))
    rows = sizes.join(shared, "shuffle", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    tie = F.md5(F.col("number").cast("string").cast("binary"))
    rows = rows.withColumn("tie", tie).withColumn("range", F.substring("shuffle", 1, digits))
    rows = rows.withColumn("part", F.when(F.col("apart"), F.concat("shuffle", F.substring("tie", 1, digits))).otherwise(""))
    key = ["source_null", "source_key"]
    ranges = rows.groupBy(*key, "range", "part").agg(F.sum("size").alias("range_size"))
    in_source = Window.partitionBy(*key).orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(in_source), F.lit(0)))
    ranges = ranges.join(source_targets(sizes, settings), key).drop("range_size")
    in_range = Window.partitionBy(*key, "range", "part").orderBy("shuffle", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.join(ranges, [*key, "range", "part"]).withColumn("reached", F.col("range_start") + F.sum("size").over(in_range))
    finish = lambda copy: (F.lit(copy) * F.col("source_size") + F.col("reached")).cast("double") / F.col("target")
    timed = materialize(timed.select("id", "number", "source_null", "source_key", "apart", "shuffle", "tie", "size", "source_size", "target", "reached"), "mix-timed")
    discard(sizes)

    budget = timed.agg(F.sum("size")).first()[0] or 0
    copies = [timed.where("size > 0").select(finish(c).alias("finish"), *ORDER[1:], "size") for c in range(settings.most_copies)]
    order = copies[0]
    for more in copies[1:]:
        order = order.union(more)
    last = _last_within(order, budget, count * settings.most_copies)
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        cut = F.struct(*[F.lit(last[c]) for c in ORDER])
        within = [F.when(F.struct(finish(c), *ORDER[1:]) <= cut, 1).otherwise(0) for c in range(settings.most_copies)]
        taken = F.when(F.col("size") > 0, F.col("size") * sum(within[1:], within[0])).otherwise(0).cast("long")
    return timed.select("id", "number", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return (id, size, source_size, target, taken) for every row: the words of the text, the
    words and the target of its source, and the words that the mix takes of it, copies counted."""
    decided = _decided(docs, settings, id_col, text_col, source_col, F.monotonically_increasing_id())
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _last_within(order: DataFrame, budget: int, count: int):
    """The last copy, in order of finish time, up to which all copies fit the budget."""
    steps = max(16, count // ROWS_IN_RANGE)
    order = order.withColumn("step", F.floor(F.col("finish") * steps).cast("long"))
    sums = order.groupBy("step").agg(F.sum("size").alias("step_size"))
    ahead = F.coalesce(F.sum("step_size").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = sums.withColumn("ahead", ahead)
    # The budget ends in the last step that starts below it.
    end = marked.where(F.col("ahead") < budget).orderBy(F.desc("step")).limit(2).collect()
    for step in end:  # the step before it, where not even the first copy of the last step fits
        within = order.where(F.col("step") == step["step"])
        running = F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
        found = within.withColumn("total", running + step["ahead"]).where(F.col("total") <= budget).orderBy(*[F.desc(k) for k in ORDER]).select(*ORDER).first()
        if found is not None:
            return found
    return None


def mixed_documents(docs: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy of each row."""
    # Numbered once, so that the decisions find their rows again.
    numbered = materialize(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("number")), "mix-rows")
    read = numbered.select("number", *[F.col("row").getField(c).alias(f"mix_{n}") for n, c in enumerate((id_col, text_col, source_col))])
    decided = _decided(read, settings, "mix_0", "mix_1", "mix_2", F.col("number")).where("taken > 0")
    copies = decided.select("number", F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")).alias("copies"))
    return numbered.join(copies, "number").select("row", F.explode("copies")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS sk, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s AS (SELECT sn, sk, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY sn, sk) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY sn, sk),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS b FROM s),
f AS (SELECT *, b - coalesce(sum(cap) OVER (ORDER BY cap / w, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl FROM c),
g AS (SELECT *, cap * wl <= lft * w AS capped FROM f),
t AS (SELECT sn, sk, source_size, CASE WHEN capped THEN cap ELSE
  (b - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) * w END AS target FROM g),
r AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY sn, sk ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS reached FROM d JOIN t USING (sn, sk)),
k AS (SELECT r.*, e.copy, CAST(e.copy * source_size + reached AS DOUBLE) / target AS finish FROM r, (VALUES (0), (1), (2)) e(copy) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, sn, sk, h ROWS UNBOUNDED PRECEDING) AS total FROM k),
n AS (SELECT doc_id, count(*) AS copies FROM o WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.source_size, r.target, CAST(r.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM r LEFT JOIN n ON r.doc_id = n.doc_id
"""

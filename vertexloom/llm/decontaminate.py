"""Benchmark decontamination with an FM-index per training shard.

A shard is a piece of a partition: documents of a few megabytes together. Its words become
symbols (the words of the benchmark are numbered, every other word is 0), and an FM-index is
built over it: suffix array, Burrows-Wheeler transform, and a wavelet tree, laid out by bit
levels, that answers rank queries. All test phrases are searched backwards at once, a numpy step
for each phrase position; occurrences are located by walking to the nearest sampled suffix
position, and the removal spans of a document are merged.

A stretch of words of the benchmark that is shorter than the shortest phrase can't hold an
occurrence and is left out of the index; this loses nothing. Phrases reach the tasks in blocks of
bounded size (``block_words``), one at a time: each block is a pass of its own that adds to the
written result of the one before, so neither the driver nor a task holds a second block. A
benchmark of one block, the usual case, takes one pass and writes nothing in between.

Defined cases: null and empty texts have no words, no spans and aren't contaminated; items whose
text is null, empty or without words, or whose id is null, contribute nothing; repeated item ids
are one item with the phrases of all their rows; repeated documents each get a row of their own;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, binary_texts, byte_slices, carried_row, discard, materialize, row_texts

SHARD_BYTES = 4 << 20
SAMPLED_EVERY = 8


@dataclass
class Phrases:
    """The distinct test phrases of a block of items, as numbered words."""

    words: dict[bytes, int]
    symbols: np.ndarray  # phrase x position, right-aligned: the last word is in the last column
    lengths: np.ndarray
    item_starts: np.ndarray  # items of phrase p: items[item_starts[p]:item_starts[p + 1]]
    items: np.ndarray
    item_ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int) -> Phrases:
        words: dict[bytes, int] = {}
        names: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            tokens = tuple(words.setdefault(w, len(words) + 1) for w in text.translate(ALPHANUMERIC).split())
            if tokens:
                item = names.setdefault(name, len(names))
                for i in range(max(1, len(tokens) - window + 1)):
                    owners.setdefault(tokens[i : i + window], set()).add(item)
        symbols = np.zeros((len(owners), window), np.int32)
        for row, phrase in enumerate(owners):
            symbols[row, window - len(phrase) :] = phrase
        counts = np.array([len(x) for x in owners.values()], np.int64)
        return cls(words, symbols, np.array([len(p) for p in owners], np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([i for x in owners.values() for i in sorted(x)], np.int64), list(names))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling: ranks of 1, 2, 4, ... symbols until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or width >= n:
            return order
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: a bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        first, last = np.zeros_like(position), position
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            first = np.where(one, zeros + ones[first], first - ones[first])
            last = np.where(one, zeros + ones[last], last - ones[last])
        return last - first


class FMIndex:
    """Symbols are moved up by one, so that 0 ends the text once."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.concatenate([text + 1, [0]])
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 3))]).astype(np.int64)
        self.tree = WaveletTree(self.last, largest + 1)
        self.sample = np.where(order % SAMPLED_EVERY == 0, order, -1)

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of the phrases, by backward search."""
        symbols = symbols + 1
        low = self.before[symbols[:, -1]]
        high = self.before[symbols[:, -1] + 1]
        for step in range(1, symbols.shape[1]):
            rows = np.flatnonzero((lengths > step) & (low < high))
            if not len(rows):
                break
            symbol = symbols[rows, -1 - step].astype(np.int64)
            low[rows] = self.before[symbol] + self.tree.rank(symbol, low[rows])
            high[rows] = self.before[symbol] + self.tree.rank(symbol, high[rows])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a sampled position is met."""
        found = self.sample[rows].copy()
        steps = 0
        open_ = np.flatnonzero(found < 0)
        at = rows[open_]
        while len(open_):
            steps += 1
            symbol = self.last[at].astype(np.int64)
            at = self.before[symbol] + self.tree.rank(symbol, at)
            sampled = self.sample[at]
            found[open_] = np.where(sampled >= 0, sampled + steps, -1)
            stay = sampled < 0
            open_, at = open_[stay], at[stay]
        return found


def find_spans(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text of a shard: its words, its merged spans [start, end) of hit words and the
    ids of the items that occur in it."""
    counts, parts = [], []
    known = phrases.words.get
    for text in texts:
        words = text.translate(ALPHANUMERIC).split() if text else []
        counts.append(len(words))
        parts.append(np.fromiter(map(known, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    text = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not len(phrases.lengths) or not len(text):
        return counts, spans, items
    inside = np.concatenate([[0], (text > 0).astype(np.int8), [0]])
    edges = np.diff(inside)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_enough = ends - begins >= phrases.lengths.min()
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins):
        return counts, spans, items
    sizes = ends - begins + 1  # with the separator that follows
    where = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    index = FMIndex(text[where], len(phrases.words))
    low, high = index.search(phrases.symbols, phrases.lengths)
    hits = high - low
    which = np.repeat(np.arange(len(hits)), hits)
    if not len(which):
        return counts, spans, items
    rows = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + low[which]
    at = where[index.locate(rows)]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.lengths[which], -1)
    edges = np.diff(np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for doc, begin, end in zip(np.searchsorted(starts, begins, "right") - 1, begins, ends, strict=True):
        spans[doc].append((int(begin - starts[doc]), int(end - starts[doc])))
    docs = np.searchsorted(starts, at, "right") - 1
    pairs = np.unique(docs * len(phrases.lengths) + which)
    for doc, phrase in zip(pairs // len(phrases.lengths), pairs % len(phrases.lengths), strict=True):
        items[doc].extend(phrases.item_ids[i] for i in phrases.items[phrases.item_starts[phrase] : phrases.item_starts[phrase + 1]])
    return counts, spans, [sorted(set(x)) for x in items]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    block: list[tuple[str, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("body")).where("item is not null and body is not null")
    for row in rows.toLocalIterator():
        body = row["body"].encode()
        if block and size + len(body) // 2 > block_words:
            yield Phrases.of(block, window)
            block, size = [], 0
        block.append((row["item"], body))
        size += len(body) // 2
    yield Phrases.of(block, window)


_SPAN = "array<struct<start: long, end: long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_words: int = 2_000_000, with_row: bool = False) -> DataFrame:
    """Return (id, n_words, n_hit, spans, items) for every document: the words, the words inside
    occurrences of a ``window`` of an item, their merged spans and the sorted ids of the items.
    ``with_row`` adds the whole input row as the struct ``row``.

    A pass over the documents without a shuffle for each block of phrases."""
    carried, at = carried_row(docs, text_col, with_row)
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(_SPAN).alias("spans"), F.array().cast("array<string>").alias("items"), carried)
    context = docs.sparkSession.sparkContext
    sent = None
    for phrases in _blocks(benchmark, item_col, item_text_col, window, block_words):
        if sent is not None:
            earlier, rows = rows, materialize(rows, "spans")
            discard(earlier)
            sent.destroy()
        sent = context.broadcast(phrases)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in byte_slices(batch, row_texts(batch, at), SHARD_BYTES):
                    counts, spans, items = find_spans(binary_texts(shard, row_texts(shard, at)), sent.value)
                    earlier = [[(x["start"], x["end"]) for x in s] for s in shard.column("spans").to_pylist()]
                    spans = [merged(s + e) if e else s for s, e in zip(spans, earlier, strict=True)]
                    items = [sorted({*i, *e}) for i, e in zip(items, shard.column("items").to_pylist(), strict=True)]
                    spans_out = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPAN_TYPE)
                    hit = [sum(e - s for s, e in x) for x in spans]
                    columns = [shard.column("id"), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), spans_out, pa.array(items, pa.list_(pa.string())), shard.column(5)]
                    yield pa.RecordBatch.from_arrays(columns, names=shard.schema.names)

        rows = rows.mapInArrow(search, rows.schema)
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items", *(["row"] if with_row else []))


def is_contaminated():
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


#: DuckDB SQL of the query: every occurrence of every window, and the words that it covers.
ORACLE = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS words, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper),
docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, upper, lower(upper)), words), []) AS w
    FROM documents, pattern
),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, upper, lower(upper)), words) AS w FROM benchmark, pattern),
starts AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM starts),
places AS (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
    FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
),
found AS (
    SELECT r, p, n, item
    FROM (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM places) JOIN windows USING (n, phrase)
),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

"""MinHash near-duplicates with min-max hashing.

A document's set holds its distinct shingles (runs of consecutive words). Every permutation of the
hashed shingles gives two signature values, the minimum and the maximum, so a signature of a
given length takes half the hash evaluations. Bands of minima and bands of maxima propose pairs; a
pair is a link if the full sets confirm it.

Documents with the same set are one node, so exact copies never pair up. Within a band's bucket
every node is compared with the bucket's smallest node first, and nodes that links connect get one
label. Buckets whose nodes then have one label are settled, as further links can't change their
component. What is left of the other buckets is found by prefixes: two sets of the wanted
similarity share one of each other's rarest shingles, as many as a fifth of the set and one more,
so nodes of one such shingle and of different labels meet in blocks of bounded size. A block is
compared twice: by bitmaps of a few bits a shingle, which bound the common shingles of two sets from
above, and then, for the nodes that have a partner within the bound, by products of small matrices
of full sets. What comes out are the labels that links join, not the pairs. Shingles of a template that many unlinked documents share are the most
frequent and not in the prefixes, so such a bucket costs no more than its prefixes. All that the
bands propose is confirmed or already connected, without emitting the pairs within a group of
copies.

With 100 permutations in bands of 5, two sets of similarity 0.8 share no band with a probability of
(1 - 0.8 ** 5) ** 40 = 1.3e-7.

Defined cases: documents without words, or with a null text, have no shingles, are linked with
nothing and kept; fewer words than a shingle has are one shingle; a null id is linked with nothing,
its component is null and it is kept; rows of one id are kept or not as their id is (the id of a
repeated row with another text has the links of each of its texts); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, binary_texts, byte_slices, discard, materialize, spread_join, whole_row
from .components import connected_components

SLICE_BYTES = 1 << 19
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 20
MATRIX_COLUMNS = 4096


@dataclass(frozen=True)
class NearDuplicateSettings:
    shingle_words: int = 5
    similarity_percent: int = 80
    permutations: int = 100
    band_rows: int = 5
    seed: int = 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(max(n, 1), base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_BASE = 0x9E3779B97F4A7C15
_CACHED = 2 * SLICE_BYTES
_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    if n > _CACHED:
        return _powers(_BASE, n), _powers(inverse, n)
    if not _cache:
        _cache["up"], _cache["down"] = _powers(_BASE, _CACHED), _powers(inverse, _CACHED)
    return _cache["up"], _cache["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of ``data``, and where each begins."""
    raw = np.frombuffer(data.translate(SPACED), np.uint8)
    edge = np.diff(np.concatenate([[1], (raw == 0x20).view(np.int8), [1]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_random(7, 256)[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * down[begins]), begins


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    starts = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    hashes, begins = word_hashes(b" ".join(t or b"" for t in texts))
    bounds = np.searchsorted(begins, starts)
    factors = _random(11, words) | np.uint64(1)
    n = len(hashes) - words + 1
    full = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        full += hashes[j : j + max(n, 0)] * factors[j]
    full = mixed(full)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(mixed(np.array([(hashes[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minima, then the maxima, under each permutation (a multiplication by an odd number)."""
    low = np.full(len(multipliers), 2**64 - 1, np.uint64)
    high = np.zeros(len(multipliers), np.uint64)
    for at in range(0, len(shingles), 2048):
        permuted = multipliers[:, None] * shingles[None, at : at + 2048]
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_hashes(shingles: np.ndarray, settings: NearDuplicateSettings) -> np.ndarray:
    if not len(shingles):
        return np.zeros(0, np.int64)
    values = signature(shingles, _random(settings.seed, settings.permutations) | np.uint64(1))
    bands = values.reshape(-1, settings.band_rows)
    mixed_bands = mixed((mixed(bands) * (_random(13, settings.band_rows) | np.uint64(1))).sum(axis=1) + np.arange(len(bands), dtype=np.uint64))
    return mixed_bands.view(np.int64)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell a set from every other."""
    return tuple(int(mixed(shingles ^ s).sum().view(np.int64)) if len(shingles) else 0 for s in _random(17, 2))


def _signatures(rows: DataFrame, settings: NearDuplicateSettings) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "body", SLICE_BYTES):
                sets = shingle_sets(binary_texts(piece, "body"), settings.shingle_words)
                keys = [set_keys(s) for s in sets]
                bands = [band_hashes(s, settings) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))],
                    names=["id", "n_shingles", "key1", "key2", "bands"],
                )

    return rows.mapInArrow(sign, f"id {kind}, n_shingles long, key1 long, key2 long, bands array<long>")


def _sets_of(rows: DataFrame, ids: DataFrame, repeated: bool, settings: NearDuplicateSettings) -> DataFrame:
    """(id, shingles, bits) of the documents named in ``ids``, the sets as bytes; a row for each set of an
    id. Texts aren't shuffled to tell repeated rows apart, their sets are, where there are any."""
    kind = rows.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "body", SLICE_BYTES):
                found = shingle_sets(binary_texts(piece, "body"), settings.shingle_words)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([bitmap(s) for s in found], pa.binary())], names=["id", "shingles", "bits"])

    made = rows.join(ids, "id", "left_semi").mapInArrow(sets, f"id {kind}, shingles binary, bits binary")
    return made.dropDuplicates(["id", "shingles"]) if repeated else made


def links_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of different sets are similar enough, as a square matrix."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    met = shared[column]
    owner, column = owner[met], (np.cumsum(shared) - 1)[column[met]]
    width = int(shared.sum())
    common = np.zeros((len(sets), len(sets)), np.float32)
    bounds = np.searchsorted(column, np.arange(0, width + MATRIX_COLUMNS, MATRIX_COLUMNS))
    for at, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        matrix = np.zeros((len(sets), min(MATRIX_COLUMNS, width - at * MATRIX_COLUMNS)), np.float32)
        matrix[owner[low:high], column[low:high] - at * MATRIX_COLUMNS] = 1
        common += matrix @ matrix.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each value of the upper bits of the shingles, four to eight bits a shingle."""
    power = max(3, int(4 * len(shingles) - 1).bit_length()) if len(shingles) else 3
    bits = np.zeros(1 << power, bool)
    bits[shingles >> np.uint64(64 - power)] = True
    return np.packbits(bits).tobytes()


def _halved(bits: np.ndarray) -> np.ndarray:
    """The bitmap of half as many bits."""
    return np.packbits(np.unpackbits(bits).reshape(-1, 2).max(axis=1))


def may_link(bitmaps: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int) -> np.ndarray:
    """Which nodes have a partner of another label that the bitmaps don't rule out. Sets of similar
    sizes have bitmaps of one length, or of lengths that differ by the factor 2."""
    out = np.zeros(len(sizes), bool)
    lengths = np.array([len(b) for b in bitmaps])
    for length in np.unique(lengths):
        at = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        same = np.stack([bitmaps[i] if lengths[i] == length else _halved(bitmaps[i]) for i in at])
        shared = np.zeros((len(at), len(at)), np.float32)
        for start in range(0, length, MATRIX_COLUMNS // 8):
            part = np.unpackbits(same[:, start : start + MATRIX_COLUMNS // 8], axis=1).astype(np.float32)
            shared += part @ part.T
        # A bit that only one of two sets has stands for a shingle that only this one has.
        most = sizes[at][:, None] - np.diag(shared)[:, None] + shared
        most = np.minimum(most, most.T)
        both = sizes[at][:, None] + sizes[at][None, :]
        fits = (100 * most >= percent * (both - most)) & (labels[at][:, None] != labels[at][None, :])
        out[at] |= fits.any(axis=1)
    return out


def joined_labels(labels: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For every label (0, 1, ...), the smallest label that links between its nodes and others reach."""
    n = labels.max() + 1
    meets = np.zeros((n, n), bool)
    x, y = np.nonzero(linked)
    meets[labels[x], labels[y]] = True
    root = np.arange(n)
    while True:
        lowest = np.where(meets, root[None, :], n).min(axis=1)
        following = np.minimum(root, lowest)
        following = following[following]
        if (following == root).all():
            return root
        root = following


def _close(n: Column, m: Column, settings: NearDuplicateSettings) -> Column:
    """Sets whose sizes differ more can't be similar enough."""
    return 100 * F.least(n, m) >= settings.similarity_percent * F.greatest(n, m)


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: NearDuplicateSettings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= settings.similarity_percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right_set"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set").mapInArrow(confirm, f"a {kind}, b {kind}")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open_nodes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of the bands that hold more than one label."""
    rows = _labelled(members, labels)
    bands = rows.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least < most")
    return spread_join(rows.select("band", "node"), bands.select("band", "n"), ["band"], "n", members.count()).select("node").distinct()


def _groups_to_compare(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the prefix shingles by which nodes of different labels may meet, with the
    number of blocks that a group falls into. Of shingles with the same members one is left."""
    count = prefixes.count()
    early = prefixes.groupBy("band").agg(F.min(F.when(F.col("early"), F.col("size"))).alias("least_size"), F.count("*").alias("n")).where("least_size IS NOT NULL AND n > 1")
    # The smaller set of a pair holds the shingle early.
    rows = spread_join(prefixes, early, ["band"], "n", count).where("size >= least_size").select("band", "node", "size")
    rows = materialize(_labelled(rows, labels), "prefix-groups")
    groups = rows.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("members"))
    groups = groups.where("least < most").groupBy("members", "n", "total").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("total") / BLOCK_SHINGLES)).cast("int")
    return spread_join(rows, groups.select("band", blocks.alias("blocks"), "n"), ["band"], "n", count).drop("n")


def _prefix_members(nodes: DataFrame, sets: DataFrame, settings: NearDuplicateSettings) -> DataFrame:
    """(band, node, size, early) with the shingles that two or more of the ``nodes`` share, and that
    are in the prefix of the node, as bands. ``early`` marks those in the shorter prefix that holds
    a shared shingle if the node's set is the smaller one of a pair."""
    kind = nodes.schema["node"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in full])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*full, np.zeros(0, np.int64)])))], names=["node", "tokens"])

    tokens = sets.select(F.col("id").alias("node"), "shingles").join(nodes, "node", "left_semi").mapInArrow(listed, f"node {kind}, tokens array<long>")
    tokens = materialize(tokens.select("node", F.size("tokens").alias("size"), F.explode("tokens").alias("token")), "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    by_node = spread_join(tokens, shared, ["token"], "n", tokens.count()).groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("rarest"))
    # Shingles of one node alone come first in its prefix and lead to nobody.
    alone = F.col("size") - F.size("rarest")
    similar = settings.similarity_percent
    prefix = F.col("size") - F.ceil(F.col("size") * similar / 100) + 1
    as_smaller = F.col("size") - F.ceil(F.col("size") * 2 * similar / (100 + similar)) + 1
    left = F.greatest(prefix - alone, F.lit(0)).cast("int")
    placed = by_node.select("node", "size", alone.alias("alone"), F.posexplode(F.slice("rarest", F.lit(1), left)).alias("place", "x"))
    return placed.select(F.col("x.token").alias("band"), "node", "size", (F.col("alone") + F.col("place") < as_smaller).alias("early"))


def _across(rows: DataFrame, sets: DataFrame, settings: NearDuplicateSettings) -> DataFrame:
    """Pairs of labels that links between nodes of a group join. A group's nodes are dealt to
    blocks, and every two blocks meet in a group of their own."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["band", "lo", "hi"]
    dealt = dealt.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "label", "size")
    kind = rows.schema["node"].dataType.simpleString()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            labels = group.column(4).dictionary_encode()
            if len(labels.dictionary) > 1:
                bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column(6)]
                keep = may_link(bits, group.column(5).to_numpy(), labels.indices.to_numpy(), settings.similarity_percent)
                yield group.select([0, 1, 2, 3, 4]).filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            names = group.column(3).dictionary_encode()
            if len(names.dictionary) == 1:
                continue
            full = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(4)]
            root = joined_labels(names.indices.to_numpy(), links_within(full, settings.similarity_percent))
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(moved)), names.dictionary.take(pa.array(root[moved]))], names=["a", "b"])

    named = sets.withColumnRenamed("id", "node")
    sifted = dealt.join(named.select("node", "bits"), "node").select(*key, "node", "label", "size", "bits").repartition(*key).sortWithinPartitions(*key)
    sifted = materialize(sifted.mapInArrow(sift, f"band long, lo int, hi int, node {kind}, label {kind}"), "sifted")
    left = sifted.join(named.select("node", "shingles"), "node").select(*key, "label", "shingles").repartition(*key).sortWithinPartitions(*key)
    return left.mapInArrow(compare, f"a {kind}, b {kind}")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group of equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield _one(held)
            held = []
        for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield _one(held)
                held = []
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def near_duplicates(docs: DataFrame, settings: NearDuplicateSettings = NearDuplicateSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_shingles, component_id, kept) for every row; ``kept`` marks the document of
    each component whose id is the smallest."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    signed = materialize(_signatures(rows, settings), "signatures")
    key = ["n_shingles", "key1", "key2"]
    can_link = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    linkable = signed.where(can_link)
    nodes = materialize(linkable.groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("n_rows"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    centre = F.min(F.struct("node", "size")).alias("centre")
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), centre).where("n > 1").select("band", "n", F.col("centre.node").alias("c"), F.col("centre.size").alias("c_size"))
    members = materialize(spread_join(banded, shared, ["band"], "n", nodes.count() * 2 * settings.permutations // settings.band_rows), "members")
    repeated = not linkable.groupBy("id").count().where("count > 1").isEmpty()
    sets = materialize(_sets_of(rows, members.select(F.col("node").alias("id")).distinct(), repeated, settings), "sets")

    to_centres = members.where((F.col("node") != F.col("c")) & _close(F.col("size"), F.col("c_size"), settings))
    links = materialize(_confirmed(to_centres.select(F.col("c").alias("a"), F.col("node").alias("b")).distinct(), sets, settings), "links")
    first = materialize(connected_components(links), "first-components")
    labels = first.select(F.col("vertex").alias("node"), F.col("component").alias("label"))
    opened = materialize(_open_nodes(members, labels), "open-nodes")
    prefixes = materialize(_prefix_members(opened, sets, settings), "prefixes")
    across = materialize(_across(_groups_to_compare(prefixes, labels), sets, settings), "across")
    labels = materialize(connected_components(first.toDF("a", "b").union(across)), "components")
    discard(sets, members, links, first, prefixes, across)

    named = nodes.join(labels.select(F.col("vertex").alias("node"), "component"), "node", "left").select(*key, "n_rows", F.coalesce("component", "node").alias("component_id"))
    linked = spread_join(linkable.select("id", *key), named, key, "n_rows", signed.count()).select("id", "n_shingles", "component_id")
    # Rows that can't be linked stand alone.
    out = linked.union(signed.where(~can_link).select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, settings: NearDuplicateSettings = NearDuplicateSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document of the smallest id of each group, with all their columns. Of rows
    that repeat an id and its text, the one of the smallest hash of all its columns stays; rows
    with a null id stay."""
    dropped = near_duplicates(docs, settings, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("dropped")).distinct()
    rows = docs.select(whole_row(docs))
    at = F.col("row").getField(id_col)
    rows = rows.join(dropped, at == F.col("dropped"), "left_anti")
    text = F.md5(F.col("row").getField(text_col).cast("binary"))
    # Ids and digests tell whether any row is repeated at all; only such rows are grouped.
    named = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("digest")).where("id IS NOT NULL")
    repeated = materialize(named.groupBy("id", "digest").count().where("count > 1").select("id").distinct(), "repeated-ids")
    if repeated.isEmpty():
        discard(repeated)
        return rows.select("row.*")
    single = rows.join(repeated, at == F.col("id"), "left_anti")
    several = rows.join(repeated, at == F.col("id"), "left_semi").groupBy(at.alias("id"), text.alias("digest"))
    return single.union(several.agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")).select("row.*")


#: DuckDB SQL of the query with four words a shingle: all pairs that share a shingle, counted in
#: full, and what each document can reach over the links.
ORACLE = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents
),
starts AS (SELECT doc_id, w, least(len(w), 4) AS n, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS p FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + n - 1], ' ') AS shingle FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other),
least_reached AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least_reached USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

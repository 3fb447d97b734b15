"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams (letters in lower case, everything else a space).
The highest order counts occurrences, lower orders count the characters an n-gram was seen to
follow; every order is discounted and interpolated with the next lower one. All models share one
sorted array of n-gram hashes for each order, with a column of discounted probabilities, and one
of context hashes with a column of interpolation weights, for each language.

A text's language is the one of lowest cross-entropy per character. Some documents aren't counted
(one in ``calibration_share``, and ``calibrating_documents`` of each language on average at most)
and calibrate, for each language, the cross-entropy above which a text is marked as rejected: it
fits no learned language well.

All other documents that may be learned from are counted, and all their n-grams are kept. Counts,
discounts, continuation counts, weights and hashes are computed on the executors. The tables are
cut in blocks by the two characters before an n-gram's last one, about ``most_grams`` n-grams of the
highest order and of a language in each; shorter n-grams than three characters are in every block.
The driver holds one block at a time and adds it as a file, which the tasks map and look up only the
characters of that block in, so neither holds all blocks. A text is read once. The tables have a
column for each language, so they are meant for tens of languages.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0; a null language is
not learned from; a text whose cross-entropies tie gets the first language by code point; rows with a null id
are predicted but not learned from; repeated rows are predicted each; without learned languages
every text is ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, materialize
from .near_duplicates import mixed

SLICE_BYTES = 1 << 20
Table = tuple[np.ndarray, np.ndarray]
_STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class LanguageSettings:
    order: int = 4
    calibrating_documents: int = 400
    calibration_share: int = 5
    most_grams: int = 400_000
    rejected_quantile: float = 0.995


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def sequence(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, text, letters of each text): every text begins with order - 1 spaces, runs of
    other characters than letters are one space."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[codes]
    counts = np.bincount(owner[letter], minlength=len(texts))
    codes = np.where(letter, codes, 32).astype(np.uint64)
    fresh = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    keep = letter | fresh | np.concatenate([[True], letter[:-1]])[: len(letter)]
    codes, owner, fresh = codes[keep], owner[keep], fresh[keep]
    times = np.where(fresh, order - 1, 1)
    return np.repeat(codes, times), np.repeat(owner, times), counts


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 to order, the hash of the n characters that end at each position; the first
    order - 1 positions are left out."""
    spread = mixed(codes + np.uint64(1))
    count = max(len(codes) - order + 1, 0)
    out = [np.zeros(count, np.uint64)]
    power = 1
    value = np.zeros(count, np.uint64)
    for n in range(1, order + 1):
        value = value + spread[order - n : order - n + count] * np.uint64(power)
        power = power * _STEP % 2**64
        out.append(mixed(value + np.uint64(n)))
    return out


def _hashes_of(grams: list[str], n: int) -> np.ndarray:
    """The hashes of texts of ``n`` characters, as ``gram_hashes`` gives them."""
    if n == 0:
        return np.zeros(len(grams), np.uint64)
    spread = mixed(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, n) + np.uint64(1))
    value = np.zeros(len(grams), np.uint64)
    for i in range(n):
        value = value * np.uint64(_STEP) + spread[:, i]
    return mixed(value + np.uint64(n))


def _smoothed(counts: DataFrame, order: int) -> tuple[list[tuple[int, DataFrame, DataFrame]], list[DataFrame]]:
    """For n = ``order`` to 1, the n-grams (lang, text, value) with their discounted probabilities
    and their contexts with the weights of the next lower order; and the scratch tables they read."""
    out, scratch = [], []
    level = counts
    for n in range(order, 0, -1):
        kinds = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
        discount = F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.col("ones") / F.greatest(F.col("ones") + 2 * F.col("twos"), F.lit(1)))).alias("discount")
        seen = level.withColumn("context", F.substring("gram", 1, n - 1))
        totals = seen.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        # A row for each language.
        totals = totals.join(F.broadcast(kinds.select("lang", discount)), "lang")
        values = seen.join(totals, ["lang", "context"]).select("lang", F.col("gram").alias("text"), ((F.col("n") - F.col("discount")) / F.col("total")).alias("value"))
        weights = totals.select("lang", F.col("context").alias("text"), (F.col("discount") * F.col("kinds") / F.col("total")).alias("value"))
        out.append((n, values, weights))
        if n > 1:
            level = materialize(level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n")), "continuations")
            scratch.append(level)
    return out, scratch


def _part(codes: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    """The block of the n-grams that end at ``last``."""
    return (codes[last - 2] * np.uint64(8191) + codes[last - 1]) % np.uint64(parts)


def _of_part(rows: DataFrame, n: int, part: int, parts: int) -> DataFrame:
    """The n-grams, or contexts of n-grams, of a block, as ``_part`` deals them."""
    if parts == 1 or n < 3:
        return rows
    code = [F.ascii(F.substring("text", i, 1)).cast("long") for i in (n - 2, n - 1)]
    return rows.where((code[0] * 8191 + code[1]) % parts == part)


def _table(rows: DataFrame, n: int, languages: list[str], missing: float) -> Table:
    """(sorted hashes, a row of values for each) of (lang, text, value), texts of ``n`` characters."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.searchsorted(languages, np.array(batch.column(0).to_pylist(), object)).astype(np.int32)
            hashes = _hashes_of(batch.column(1).to_pylist(), n).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(hashes), batch.column(2).cast(pa.float32())], names=["lang", "hash", "value"])

    found = rows.select("lang", "text", "value").mapInArrow(hashed, "lang int, hash long, value float").toArrow()
    hashes, at = np.unique(found["hash"].to_numpy().view(np.uint64), return_inverse=True)
    values = np.full((len(hashes), len(languages)), missing, np.float32)
    values[at, found["lang"].to_numpy()] = found["value"].to_numpy()
    return hashes, values


@dataclass
class BlockFile:
    """The tables of a block in a file that Spark copies to the tasks' machines."""

    name: str
    places: list[tuple[int, str, tuple[int, ...]]]  # of the arrays, in the order of ``tables``

    @classmethod
    def of(cls, context: SparkContext, folder: str, grams: list[Table], contexts: list[Table]) -> BlockFile:
        name = f"language-{uuid.uuid4().hex}"
        places = []
        with open(os.path.join(folder, name), "wb") as file:
            for array in [a for table in [*grams, *contexts] for a in table]:
                file.write(bytes(-file.tell() % 8))
                places.append((file.tell(), array.dtype.str, array.shape))
                file.write(np.ascontiguousarray(array).data)
        context.addFile(os.path.join(folder, name))
        return cls(name, places)

    def tables(self) -> tuple[list[Table], list[Table]]:
        path = SparkFiles.get(self.name)
        # A mapping needs some bytes.
        arrays = [np.asarray(np.memmap(path, kind, "r", start, shape)) if math.prod(shape) else np.zeros(shape, kind) for start, kind, shape in self.places]
        tables = list(zip(arrays[::2], arrays[1::2], strict=True))
        return tables[: len(tables) // 2], tables[len(tables) // 2 :]


@dataclass
class LanguageModels:
    languages: list[str]
    order: int
    characters: int
    grams: list[Table]  # for each order: sorted hashes, discounted probabilities
    contexts: list[Table]  # for each order: sorted hashes, weights of the lower order
    limits: np.ndarray
    files: tuple[BlockFile, ...] = ()  # instead of the two, one for each block

    @classmethod
    def fit(cls, counts: DataFrame, settings: LanguageSettings, in_files: bool = False) -> LanguageModels | None:
        """From (lang, gram, n) with grams of the highest order; None without any. The tables are
        held whole, or ``in_files`` block by block."""
        sizes = {r["lang"]: r["grams"] for r in counts.groupBy("lang").agg(F.count("*").alias("grams")).collect()}
        if not sizes:
            return None
        languages = sorted(sizes)
        parts = math.ceil(max(sizes.values()) / settings.most_grams) if in_files and settings.order > 2 else 1
        levels, scratch = _smoothed(counts, settings.order)
        if parts > 1:
            levels = [(n, materialize(values, "grams"), materialize(weights, "contexts")) for n, values, weights in levels]
            scratch += [x for _, values, weights in levels for x in (values, weights)]
        models = cls(languages, settings.order, 0, [], [], np.full(len(languages), np.inf))
        if in_files:
            # Spark reads the files from here as long as the session lives.
            folder = tempfile.mkdtemp(prefix="vertexloom-language-")
            atexit.register(shutil.rmtree, folder, True)
        for part in range(parts):
            grams = [_table(_of_part(values, n, part, parts), n, languages, 0.0) for n, values, _ in levels[::-1]]
            contexts = [_table(_of_part(weights, n, part, parts), n - 1, languages, 1.0) for n, _, weights in levels[::-1]]
            models.characters = len(grams[0][0]) + 1
            if in_files:
                models.files += (BlockFile.of(counts.sparkSession.sparkContext, folder, grams, contexts),)
            else:
                models.grams, models.contexts = grams, contexts
        discard(*scratch)
        return models

    def _probabilities(self, tables: tuple[list[Table], list[Table]], hashes: list[np.ndarray], previous: list[np.ndarray]) -> np.ndarray:
        """Of the last characters of n-grams, by the hashes of their ends and of the ends' contexts."""
        grams, contexts = tables
        p = np.full((len(hashes[0]), len(self.languages)), 1 / self.characters, np.float32)
        for n in range(1, self.order + 1):
            p = _looked_up(grams[n - 1], hashes[n], 0.0) + _looked_up(contexts[n - 1], previous[n - 1], 1.0) * p
        return p

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy of each text under each language, characters, letters)."""
        codes, owner, letters = sequence(texts, self.order)
        size = self.order - 1
        hashes = gram_hashes(codes, self.order)
        inside = owner[size:] == owner[: len(owner) - size] if len(owner) > size else np.zeros(0, bool)
        target = owner[size:][inside]
        hashes = [h[inside] for h in hashes]
        # The context of the n-gram that ends at a position: n - 1 characters that end one before it.
        _, first, back = np.unique(hashes[-1], return_index=True, return_inverse=True)
        hashes = [h[first] for h in hashes]
        before = gram_hashes(codes[:-1], size) if size and len(codes) > 1 else [np.zeros(len(inside), np.uint64)]
        previous = [np.zeros(len(first), np.uint64), *[h[: len(inside)][inside][first] for h in before[1:]]]
        if len(self.files) < 2:
            p = self._probabilities(self.files[0].tables() if self.files else (self.grams, self.contexts), hashes, previous)
        else:
            p = np.empty((len(first), len(self.languages)), np.float32)
            part = _part(codes, np.flatnonzero(inside)[first] + size, len(self.files))
            for i, file in enumerate(self.files):
                at = np.flatnonzero(part == i)
                p[at] = self._probabilities(file.tables(), [h[at] for h in hashes], [h[at] for h in previous])
        logs = -np.log(p)
        n_chars = np.bincount(target, minlength=len(texts))
        sums = np.stack([np.bincount(target, logs[back, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return sums / np.maximum(n_chars, 1)[:, None], n_chars, letters


def _looked_up(table: Table, hashes: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full((len(hashes), values.shape[1]), missing, np.float32)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    out = values[at]
    out[keys[at] != hashes] = missing
    return out


def _counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of all n-grams of the highest order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "body", SLICE_BYTES):
                langs = piece.column(1).to_pylist()
                codes, owner, _ = sequence(piece.column(0).to_pylist(), order)
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                hashes = gram_hashes(codes, order)[-1]
                inside = owner[order - 1 :] == owner[: len(owner) - order + 1]
                starts = np.flatnonzero(inside)
                lang = number[owner[starts]]
                _, first, n = np.unique(mixed(hashes[starts]) + lang.astype(np.uint64), return_index=True, return_counts=True)
                grams = ["".join(map(chr, codes[i : i + order].tolist())) for i in starts[first]]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in lang[first]]), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return sample.select("body", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _limits(models: LanguageModels, sample: DataFrame, quantile: float) -> np.ndarray:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "body", SLICE_BYTES):
                entropy, _, _ = models.cross_entropies(piece.column(0).to_pylist())
                langs = piece.column(1).to_pylist()
                known = [models.languages.index(x) if x in models.languages else -1 for x in langs]
                rows = [(k, entropy[i, k]) for i, k in enumerate(known) if k >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([float(e) for _, e in rows], pa.float64())], names=["k", "e"])

    found = sample.select("body", "lang").mapInArrow(measure, "k int, e double").groupBy("k").agg(F.percentile("e", F.lit(quantile)).alias("limit")).collect()
    limits = np.full(len(models.languages), np.inf)
    for row in found:
        limits[row["k"]] = row["limit"]
    return limits


def languages(docs: DataFrame, held_out: Column, settings: LanguageSettings = LanguageSettings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Return (id, held_out, lang_pred, score, cross_entropy, rejected) for every row. ``held_out``
    (over ``docs``) marks rows that are not learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), held_out.alias("held_out"), F.col(lang_col).cast("string").alias("lang"))
    kind = rows.schema["id"].dataType.simpleString()
    learned = rows.where("NOT held_out AND lang IS NOT NULL AND id IS NOT NULL AND body IS NOT NULL")
    sizes = learned.groupBy("lang").agg(F.count("*").alias("documents"))
    share = F.least(F.lit(1 / settings.calibration_share), settings.calibrating_documents / F.col("documents"))
    # A row for each language; very few documents of one are all counted.
    share = F.when(F.col("documents") >= 2 * settings.calibration_share, share).otherwise(0.0)
    marked = learned.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").withColumn("calibrates", F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = materialize(_counts(marked.where("NOT calibrates"), settings.order), "grams")
    models = LanguageModels.fit(counts, settings, in_files=True)
    discard(counts)
    if models is None:
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    models.limits = _limits(models, marked.where("calibrates"), settings.rejected_quantile)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*models.languages, "und"])
        for batch in batches:
            for piece in byte_slices(batch, "body", SLICE_BYTES):
                entropy, n, letters = models.cross_entropies(piece.column(1).to_pylist())
                best = np.argmin(entropy, axis=1)
                lowest = entropy[np.arange(len(best)), best]
                # Neighbouring characters tell much the same, so evidence grows with the root.
                share = 1 / np.exp(-np.sqrt(n)[:, None] * (entropy - lowest[:, None])).sum(axis=1)
                none = letters == 0
                rejected = none | (lowest > models.limits[best])
                score = np.where(none, 0.0, np.where(rejected, share / 2, share))
                pred = names[np.where(none, len(names) - 1, best)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(pred.tolist(), pa.string()), pa.array(score.astype(float)), pa.array(lowest.astype(float), mask=none), pa.array(rejected)], names=[id_col, "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return rows.select("id", "body", "held_out").mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")

"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (shares of character classes, word and line repetition, lengths) are
standardised and mapped to random cosines that approximate a Gaussian kernel. Every partition of
the labelled rows sums its part of the normal equations, the parts are added by row, and the
driver solves one system of the number of features. A fold of the labelled rows that the
regression doesn't see calibrates its outputs: sums of labels by rounded output are made monotone
by pooling adjacent violators.

The labelled rows are a bounded sample (``most_rows``, the smallest hashes of the id); scores cover
every row.

Defined cases: null and empty texts are scored by their (zero) statistics; labels that are null are
ignored, of several labels of one id the mean counts; rows with a null id are scored but never
learned from; repeated rows are scored each; without usable labels every score is 0.5; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, byte_slices, discard, materialize
from .near_duplicates import mixed, word_hashes

SLICE_BYTES = 2 << 20
_CLASSES = 10


@dataclass(frozen=True)
class QualitySettings:
    features: int = 384
    bandwidth: float = 4.0
    ridge: float = 1e-2
    most_rows: int = 200_000
    seed: int = 4
    output_steps: int = 1000  # outputs are rounded to so many steps a unit for calibration


def _byte_classes() -> np.ndarray:
    out = np.full(256, 8, np.int64)  # other punctuation
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[ord(c) for c in ".,;:'\"-()"]] = 3
    out[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
    out[0x0A] = 5
    out[0x80:] = 6
    out[[ord(c) for c in "!?"]] = 7
    out[[ord(c) for c in "<>{}[]|\\/_=@~^`"]] = 9
    return out


_CLASS = _byte_classes()


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of numbers for every text."""
    data = b" ".join(t or b"" for t in texts)
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    raw = np.frombuffer(data, np.uint8)
    doc = np.repeat(np.arange(len(texts)), lengths + 1)[: len(raw)]
    counts = np.bincount(doc * _CLASSES + _CLASS[raw], minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    counts[:-1, 4] -= 1  # the joining space
    words, begins = word_hashes(data)
    bounds = np.searchsorted(begins, starts)
    previous = np.concatenate([[0], words[:-1]]).astype(np.uint64)
    same = words == previous
    pairs = mixed(previous * np.uint64(3) + words)
    first = _CLASS[raw[begins]] if len(begins) else np.zeros(0, np.int64)
    out = []
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        n, size = b - a, max(int(lengths[i]), 1)
        shares = counts[i] / size
        if n:
            values, times = np.unique(words[a:b], return_counts=True)
            distinct, top = len(values) / n, times.max() / n
            pair_distinct = len(np.unique(pairs[a + 1 : b])) / (n - 1) if n > 1 else 1.0
            repeats, capital = same[a + 1 : b].mean() if n > 1 else 0.0, (first[a:b] == 1).mean()
            symbol_start = (first[a:b] >= 7).mean()
        else:
            distinct = top = pair_distinct = repeats = capital = symbol_start = 0.0
        lines = [x for x in (text or b"").split(b"\n") if x.strip()]
        letters = max(counts[i, 0] + counts[i, 1], 1.0)
        out.append(
            [
                *shares, np.log1p(size), np.log1p(n), lengths[i] / max(n, 1), distinct, top, pair_distinct, repeats, capital, symbol_start,
                counts[i, 1] / letters, np.log1p(len(lines)), np.log1p(size / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1),
                np.log1p(counts[i, 7] / max(n, 1)), np.log1p(counts[i, 8] / max(n, 1)), np.log1p(counts[i, 9] / max(n, 1)),
                distinct * np.log1p(n), counts[i, 3] / max(n, 1),
            ]
        )
    return np.array(out, float).reshape(len(texts), -1)


WIDTH = statistics([b"a"]).shape[1]


def _statistics_table(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "body", SLICE_BYTES):
                x = statistics(binary_texts(piece, "body")).astype(np.float32)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["id", "held_out", "x"])

    return rows.mapInArrow(measure, f"id {kind}, held_out boolean, x array<float>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :].reshape(-1, WIDTH)[: len(column)].astype(float)


@dataclass
class KernelMap:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([np.ones((len(x), 1)), waves], axis=1)


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum, over all partitions, of the matrices whose rows are (i, values)."""
    total = parts.groupBy("i").applyInPandas(lambda g: pd.DataFrame({"i": g["i"].iloc[:1], "v": [np.sum(np.stack(g["v"].tolist()), axis=0)]}), "i int, v array<double>")
    return np.stack(total.toPandas().sort_values("i")["v"].tolist())


def _partition_sums(train: DataFrame, of_batch) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(_rows(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return train.select("x", "y").mapInArrow(add, "i int, v array<double>")


def pool_adjacent_violators(outputs: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on increasing outputs: (block centres, block values)."""
    blocks: list[list[float]] = []
    for x, y, w in zip(outputs, labels, weights, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, calibrates: Column, settings: QualitySettings = QualitySettings(), id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Return (id, held_out, score) for every row. ``held_out`` (over ``docs``) marks rows that are
    not learned from; ``calibrates`` (over ``labels``) marks the labels that only calibrate."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), held_out.alias("held_out"))
    measured = materialize(_statistics_table(rows), "statistics")
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"), F.max(calibrates).alias("calibrates"))
    known = measured.where("NOT held_out").join(marks, "id").select("id", "x", "y", "calibrates")
    known = materialize(known.orderBy(F.xxhash64("id")).limit(settings.most_rows), "labelled")
    train, tuning = known.where("NOT calibrates"), known.where("calibrates")
    if train.isEmpty():
        return measured.select(F.col("id").alias(id_col), "held_out", F.lit(0.5).alias("score"))

    n, total, squares = _summed(_partition_sums(train, lambda x, y: np.stack([np.full(WIDTH, len(x)), x.sum(0), (x**2).sum(0)])))
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0))
    random = np.random.default_rng(settings.seed)
    weights = random.normal(size=(WIDTH, settings.features)) / settings.bandwidth
    kernel = KernelMap(mean, np.where(scale > 1e-9, scale, 1.0), weights, random.uniform(0, 2 * np.pi, settings.features))

    def normal_equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = kernel(x)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

    sums = _summed(_partition_sums(train, normal_equations))
    gram, target = sums[:, :-1], sums[:, -1]
    solution = np.linalg.solve(gram + settings.ridge * max(n[0], 1) / settings.features * np.eye(len(gram)), target)

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(kernel(_rows(batch.column(0))) @ solution * settings.output_steps)), batch.column(1)], names=["o", "y"])

    steps = (tuning if not tuning.isEmpty() else train).select("x", "y").mapInArrow(output, "o double, y double").groupBy("o").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("o").toPandas()
    # Half a label of either kind is added at each end, so that no score is certain.
    outputs = np.concatenate([[steps["o"].iloc[0]], steps["o"], [steps["o"].iloc[-1]]]) / settings.output_steps
    centres, values = pool_adjacent_violators(outputs, np.concatenate([[0.0], steps["y"] / steps["n"], [1.0]]), np.concatenate([[0.5], steps["n"], [0.5]]))

    kind = measured.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.interp(kernel(_rows(batch.column(2))) @ solution, centres, values) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(s, 0, 1))], names=[id_col, "held_out", "score"])

    discard(known)
    return measured.select("id", "held_out", "x").mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, score double")

"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is a bag of character n-grams, hashed to buckets, that lie within a word and its edges. The
embeddings of the bag are averaged, each n-gram by its count and by the logarithm of how rare it is
in the labelled documents, together with ``padding`` zero vectors, so that a few n-grams don't
decide alone; a linear softmax turns the average into class probabilities. Embeddings and softmax
are trained jointly in numpy. A misspelt word still shares n-grams with the word it comes from,
and so their vectors.

The labelled documents are a bounded sample (``most_documents``), chosen by label: toxic ones come
first, up to ``toxic_share`` of the sample (more where the others don't fill the rest), each by the
smallest hashes of the id. The bags are made by all executors. One model is trained on all of them
and one for each of ``folds`` folds on the rest, in a task each, which reads its mini-batches from
a file of its own; a logistic curve fitted to the log-odds that the folds' models give the
documents they didn't see, weighted to the odds of all labels, turns log-odds into scores. As the
softmax is linear in the average, scoring needs two numbers for each bucket, and every whole text
is scored where it lies.

Defined cases: null and empty texts, and texts without letters or digits, have an empty bag and
get the score of an average without n-grams; labels that are null are ignored, of several labels of
one id the highest counts; rows with a null id are scored but never learned from; repeated rows
are scored each; without usable labels every score is 0; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, carried_row, discard, materialize, row_texts
from .near_duplicates import mixed

SLICE_BYTES = 1 << 18
LONG_TEXT = 1 << 18


@dataclass(frozen=True)
class ToxicitySettings:
    lengths: tuple[int, ...] = (5, 6, 7)
    bucket_bits: int = 17
    width: int = 4
    epochs: int = 10
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-3
    padding: float = 100  # zero vectors in every average
    scale: float = 30.0  # of the average, which is small over hundreds of n-grams
    most_documents: int = 6_000
    toxic_share: float = 0.5  # of the sample goes to toxic documents first
    least_documents: int = 5  # an n-gram in fewer labelled documents is left untrained
    folds: int = 3  # that calibrate
    seed: int = 8


def _characters(text: str) -> np.ndarray:
    """The characters of a text in lower case, other than letters and digits as spaces."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    digit = (codes >= 48) & (codes <= 57)
    letter = (codes >= 97) & (codes <= 122)
    return np.where(digit | letter | (codes >= 0xC0), codes, np.uint64(32))


def _grams(codes: np.ndarray, n: int, settings: ToxicitySettings, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, bucket) of the n-grams that begin at one of the first ``most`` characters and have no
    space but at their edges."""
    count = max(0, min(len(codes) - n + 1, most))
    inner, spread = codes != 32, mixed(codes)
    value = np.zeros(count, np.uint64)
    ok = np.ones(count, bool)
    for j in range(n):
        value = value * np.uint64(0x9E3779B97F4A7C15) + spread[j : j + count]
        if 0 < j < n - 1:
            ok &= inner[j : j + count]
    return np.flatnonzero(ok), (mixed(value[ok]) >> np.uint64(64 - settings.bucket_bits)).astype(np.int64)


def counted(texts: list[str | None], settings: ToxicitySettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of every distinct n-gram of every text. A space stands around each
    text. A long text is read in parts; every n-gram counts in the part that it begins in."""
    lowered = [(t or "").lower() for t in texts]
    if len(texts) == 1 and len(lowered[0]) > LONG_TEXT:
        counts = np.zeros(1 << settings.bucket_bits, np.int64)
        whole = f" {lowered[0]} "
        for start in range(0, len(whole), LONG_TEXT):
            codes = _characters(whole[start : start + LONG_TEXT + max(settings.lengths) - 1])
            for n in settings.lengths:
                counts += np.bincount(_grams(codes, n, settings, LONG_TEXT)[1], minlength=len(counts))
        bucket = np.flatnonzero(counts)
        return np.zeros(len(bucket), np.int64), bucket, counts[bucket].astype(float)
    codes = _characters(" " + " ".join(lowered) + " ")
    # An n-gram of two characters or more belongs to the text of its second one.
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    keys = []
    for n in settings.lengths:
        begin, bucket = _grams(codes, n, settings, len(codes))
        keys.append((owner[np.minimum(begin, len(owner) - 1)] << settings.bucket_bits) + bucket)
    keys, counts = np.unique(np.concatenate(keys), return_counts=True) if len(owner) else (np.zeros(0, np.int64), np.zeros(0))
    return keys >> settings.bucket_bits, keys & ((1 << settings.bucket_bits) - 1), counts.astype(float)


def _bags(texts: list[str | None], settings: ToxicitySettings) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text, by ascending bucket."""
    owner, bucket, count = counted(texts, settings)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(bucket[a:b], count[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag as compressed bytes: steps between buckets and counts, the low bytes of all first."""
    numbers = np.stack([np.diff(buckets, prepend=0), counts]).astype("<u4")
    return zlib.compress(numbers.view(np.uint8).reshape(2, -1, 4).transpose(2, 0, 1).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, 2, -1)
    steps, counts = np.ascontiguousarray(planes.transpose(1, 2, 0)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(steps), counts


class SpilledBags:
    """Packed bags in a temporary file of the task, which leaves no name behind; in memory are their
    places and labels."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.places: list[tuple[int, bytes, int, int, int]] = []  # order, digest, label, start, length

    def add(self, bag: bytes, label: int, order: int) -> None:
        self.places.append((order, hashlib.md5(bag).digest(), label, self.file.tell(), len(bag)))
        self.file.write(bag)

    def sort(self) -> None:
        """An order that doesn't depend on how the bags arrived."""
        self.places.sort(key=lambda p: p[:3])

    def labels(self) -> np.ndarray:
        return np.array([p[2] for p in self.places], np.int64)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        *_, start, length = self.places[i]
        self.file.seek(start)
        return unpacked(self.file.read(length))


@dataclass
class ToxicityModel:
    """Log-odds of a text: the sum of ``pull`` over its n-grams, over the sum of their ``rarity`` and
    the padding, plus ``bias``."""

    rarity: np.ndarray
    pull: np.ndarray
    bias: float
    padding: float

    def log_odds(self, owner: np.ndarray, bucket: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        total = np.bincount(owner, self.pull[bucket] * count, minlength=texts)
        return total / (np.bincount(owner, self.rarity[bucket] * count, minlength=texts) + self.padding + 1e-9) + self.bias


def losses(embeddings: np.ndarray, softmax: np.ndarray, bias: np.ndarray, batch: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of a batch and its gradients. ``embeddings`` is width by n-gram; the
    batch is (text, n-gram, weight in the text's average) of every n-gram of its texts."""
    owner, gram, weight = batch
    n = len(labels)
    hidden = np.stack([np.bincount(owner, row[gram] * weight, minlength=n) for row in embeddings], axis=1)
    logits = hidden @ softmax + bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(p[np.arange(n), labels]).mean()
    error = (p - np.eye(2)[labels]) / n
    back = softmax @ error.T
    of_grams = np.stack([np.bincount(gram, row[owner] * weight, minlength=embeddings.shape[1]) for row in back])
    return float(loss), [of_grams, hidden.T @ error, error.sum(axis=0)]


def train(bags: SpilledBags, settings: ToxicitySettings) -> ToxicityModel:
    """Train embeddings and softmax together."""
    random = np.random.default_rng(settings.seed)
    labels = bags.labels()
    buckets = 1 << settings.bucket_bits
    seen = np.zeros(buckets, np.int64)
    for i in range(len(bags)):
        seen[bags[i][0]] += 1
    known = seen >= min(settings.least_documents, max(1, len(bags) // 4))
    numbering = np.cumsum(known) - 1
    rarity = np.where(known, np.log((len(bags) + 1) / np.maximum(seen, 1)), 0)

    def averaged(i: int) -> tuple[np.ndarray, np.ndarray]:
        b, c = bags[i]
        w = c * rarity[b]
        of_known = known[b]
        return numbering[b[of_known]], settings.scale * w[of_known] / (w.sum() + settings.padding + 1e-9)

    size = int(known.sum())
    of_ones = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    parameters = [random.normal(0, 0.1, (settings.width, size)), random.normal(0, 0.1, (settings.width, 2)), np.log([1 - of_ones, of_ones])]
    parameters = [p.astype(np.float32) for p in parameters]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        order = random.permutation(len(bags))
        for at in range(0, len(order), settings.batch):
            chosen = order[at : at + settings.batch]
            batch = [averaged(i) for i in chosen]
            gram = np.concatenate([b for b, _ in batch])
            owner = np.repeat(np.arange(len(chosen)), [len(b) for b, _ in batch])
            _, gradients = losses(*parameters, (owner, gram, np.concatenate([c for _, c in batch])), labels[chosen])
            # Only the embeddings of this batch's n-grams decay and move.
            touched = np.zeros(size, np.float32)
            touched[gram] = 1
            step += 1
            for p, (m, v), g, moves, decay in zip(parameters, state, gradients, (touched, 1, 1), (settings.decay, settings.decay, 0), strict=True):
                g = g.astype(np.float32) + np.float32(decay) * p
                m += moves * (g - m) * np.float32(0.1)
                v += moves * (g * g - v) * np.float32(0.01)
                p -= moves * m * np.float32(rate / (1 - 0.9**step)) / (np.sqrt(v * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-6))
    embeddings, softmax, bias = parameters
    pull = np.zeros(buckets)
    pull[known] = settings.scale * rarity[known] * ((softmax[:, 1] - softmax[:, 0]) @ embeddings)
    return ToxicityModel(rarity.astype(np.float32), pull.astype(np.float32), float(bias[1] - bias[0]), settings.padding)


def logistic_curve(log_odds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of labels over log-odds, by Newton's method. Labels are
    drawn in by a row of either kind, so that the curve stays finite; the slope isn't negative."""
    n = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    middle, spread = log_odds.mean(), max(log_odds.std(), 1e-9)
    x = np.stack([(log_odds - middle) / spread, np.ones(len(labels))], axis=1)
    w = weights / weights.sum() * len(labels)

    def loss(b: np.ndarray) -> float:
        return float((w * (np.logaddexp(0, x @ b) - target * (x @ b))).sum()) + 1e-3 * float(b @ b)

    b = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        gradient = x.T @ (w * (p - target)) + 2e-3 * b
        move = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), gradient)
        length = 1.0
        while loss(b - length * move) > loss(b) and length > 1e-6:
            length /= 2
        b = b - length * move
        if np.abs(length * move).max() < 1e-9:
            break
    slope = max(b[0], 0) / spread
    return float(slope), float(b[1] - slope * middle)


def _fold(order: int, folds: int) -> int:
    """The fold, from 1 on, of a document of this hash."""
    return order % folds + 1


def _model(known: DataFrame, settings: ToxicitySettings, weights: tuple[float, float]) -> tuple[ToxicityModel, float, float] | None:
    """The model of the whole sample and its calibration; ``weights`` are those of a row of each
    label."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "body", SLICE_BYTES):
                made = _bags(piece.column(0).to_pylist(), settings)
                yield pa.RecordBatch.from_arrays([pa.array([packed(*bag) for bag in made], pa.binary()), piece.column(1), piece.column(2)], names=["bag", "y", "o"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[SpilledBags, SpilledBags]] = {}
        for batch in batches:
            for number, bag, y, o in zip(*batch.columns, strict=True):
                number, order = number.as_py(), o.as_py()
                learned, rest = sets.setdefault(number, (SpilledBags(), SpilledBags()))
                (rest if _fold(order, settings.folds) == number else learned).add(bag.as_py(), y.as_py(), order)
        for number, (learned, rest) in sets.items():
            learned.sort()
            rest.sort()
            model = train(learned, settings) if len(learned) else None
            if number == 0:
                row = (model.rarity.tobytes(), model.pull.tobytes(), model.bias, None, None)
            elif model is None:
                continue
            else:
                seen = [rest[i] for i in range(len(rest))]
                odds = [float(model.log_odds(np.zeros(len(b), np.int64), b, c, 1)[0]) for b, c in seen]
                row = (None, None, None, odds, rest.labels().tolist())
            columns = [pa.array([number], pa.int32()), pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.float64()), pa.array([row[3]], pa.list_(pa.float64())), pa.array([row[4]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "rarity", "pull", "bias", "odds", "labels"])

    made = known.select("body", "y", "o").mapInArrow(bags, "bag binary, y int, o long")
    every = F.explode(F.sequence(F.lit(0), F.lit(settings.folds))).alias("model")
    # The sample is bounded by most_documents, so one task may train a model on it; each has its own.
    trained = made.select(every, "bag", "y", "o").repartitionById(settings.folds + 1, F.col("model")).mapInArrow(fit, "model int, rarity binary, pull binary, bias double, odds array<double>, labels array<long>")
    found = {r["model"]: r for r in trained.collect()}
    if 0 not in found:
        return None
    whole = found.pop(0)
    model = ToxicityModel(np.frombuffer(whole["rarity"], np.float32), np.frombuffer(whole["pull"], np.float32), whole["bias"], settings.padding)
    ordered = [found[k] for k in sorted(found)]
    odds, labels = np.array([x for r in ordered for x in r["odds"]]), np.array([x for r in ordered for x in r["labels"]], np.int64)
    if len(set(labels.tolist())) < 2:
        return model, 1.0, float(np.log(weights[1] / weights[0])) if all(weights) else 0.0
    return model, *logistic_curve(odds, labels, np.array(weights)[labels])


def _quotas(others: int, toxic: int, settings: ToxicitySettings) -> tuple[int, int]:
    """How many documents of label 0 and of label 1 the sample takes."""
    most = settings.most_documents
    of_toxic = min(toxic, max(round(most * settings.toxic_share), most - others))
    return min(others, most - of_toxic), of_toxic


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, settings: ToxicitySettings = ToxicitySettings(), id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", with_row: bool = False) -> DataFrame:
    """Return (id, held_out, score) for every row. ``held_out`` (over ``docs``) marks rows that are
    not learned from. ``with_row`` adds the whole input row as the struct ``row``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), held_out.alias("held_out"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    learnable = rows.where("NOT held_out AND id IS NOT NULL").select("id").distinct()
    order = F.xxhash64("id")
    labelled = materialize(marks.join(learnable, "id", "left_semi").select("id", "y", order.alias("o")), "labelled")
    sizes = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    quotas = _quotas(sizes.get(0, 0), sizes.get(1, 0), settings)
    parts = [labelled.where(F.col("y") == y).orderBy("o", "id").limit(n) for y, n in enumerate(quotas)]
    chosen = materialize(parts[0].union(parts[1]), "chosen")
    # A row of each label stands for so many.
    weights = tuple(sizes.get(y, 0) / n if n else 0.0 for y, n in enumerate(quotas))
    # At most most_documents rows of three numbers.
    model = _model(rows.where("NOT held_out").join(F.broadcast(chosen), "id").dropDuplicates(["id", "body"]), settings, weights)
    discard(labelled, chosen)
    names = [id_col, "held_out", "score", *(["row"] if with_row else [])]
    carried, at = carried_row(docs, text_col, with_row)
    if model is None:
        return docs.select(F.col(id_col), held_out.alias("held_out"), F.lit(0.0).alias("score"), *([carried] if with_row else []))
    given = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), carried)
    scored = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.lit(0.0).alias("score"), *([carried] if with_row else []))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, slope, shift = sent.value
        for batch in batches:
            for piece in byte_slices(batch, row_texts(batch, at), SLICE_BYTES):
                odds = trained.log_odds(*counted(row_texts(piece, at).to_pylist(), settings), piece.num_rows)
                chance = pa.array(1 / (1 + np.exp(-np.clip(slope * odds + shift, -50, 50))))
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], chance, *([piece.column(2)] if with_row else [])], names=scored_names)

    scored_names = scored.columns
    return given.mapInArrow(score, scored.schema).toDF(*names)

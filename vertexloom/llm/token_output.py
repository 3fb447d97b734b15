"""Token-id output as ORC files.

Documents are range-partitioned and sorted by id, each text is encoded as a whole, an end id is
appended, and every partition is written as one ORC file of a row per document: ``doc_id``,
``part`` (the number of the file in id order), ``start_in_part`` and ``end_in_part`` (ids of the file
before and up to its end) and ``ids``. ORC keeps the ids in stripes with integer run-length encoding, an index
entry for every ``row_stride`` rows, and a Bloom filter on ``doc_id``; readers take stripes in
parallel and skip stripes and row groups by that metadata.

Every space before a character that isn't white space begins a new token of this byte-level
vocabulary, so a text is encoded in pieces that start there, with a bounded memo of pieces seen
before. A text with any other space is encoded whole. A piece of Latin letters and ASCII without
an apostrophe, an added token or double white space has a token's end wherever a letter stands next
to another character, too: its parts are encoded alone, runs of letters by the library's model
without the steps that only split a text.

Defined cases: null and empty texts hold the end id alone; null ids come first; rows of one id are
ordered by a hash of the text; other columns are not read; an empty table gives files without rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

DOCUMENTS_AT_ONCE = 256
KEPT_PIECES = 800_000


class _OtherSpace(Exception):
    pass


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"(?!.*\s\s)[\x00-&(-\x7F{_LETTERS[6:]}]+", re.DOTALL)
_WORD = re.compile(f"[{_LETTERS}]+")
_ENDS = ".,;:!?%&$#*"
_ID = attrgetter("id")
_PARTS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}]+")


class PieceIds(dict):
    """The ids, as little-endian unsigned 32-bit integers, of a space and what follows it."""

    def __init__(self, path: str, most: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spelt = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelt(chr(c))[0][0] for c in [0x20, *range(0xC0, 0x250)]}
        self.others: dict[str, bytes] = {}
        self.inners: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, part: str) -> bytes:
        if not part.isascii():
            part = part.translate(self.spelling)
        elif part[0] == " ":
            part = self.spelling[0x20] + part[1:]
        return array("I", map(_ID, self.tokenize(part))).tobytes()

    def other(self, part: str) -> bytes:
        ids = self.others.get(part)
        if ids is None:
            ids = self.encode(part)
            if len(self.others) < self.most and len(part) <= 64:
                self.others[part] = ids
        return ids

    def inner(self, part: str) -> bytes:
        """Of letters that don't follow a space."""
        ids = self.inners.get(part)
        if ids is None:
            ids = self.letters(part)
            if len(self.inners) < self.most and len(part) <= 64:
                self.inners[part] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        word = piece.rstrip(_ENDS)
        if word.isalpha() and (word.isascii() or _WORD.fullmatch(word)):
            return self.letters(" " + word) if len(word) == len(piece) else self[word] + self.other(piece[len(word) :])
        if not _PLAIN.fullmatch(piece) or any(t in piece for t in self.added):
            return self.encode(" " + piece)
        first, *rest = _PARTS.findall(piece)
        ids = self[first] if first[0].isalpha() else self.other(" " + first)
        for part in rest:
            ids += self.inner(part) if part[0].isalpha() else self.other(part)
        return ids

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            ids = array("I", map(_ID, self.tokenize(self.spelling[0x20] + piece))).tobytes()
        elif not piece or piece[0].isspace():
            raise _OtherSpace
        else:
            ids = self.piece(piece)
            # What goes on in another line hardly ever comes again.
            if "\n" in piece:
                return ids
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def of_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            begin = self.inner(first) if first.isascii() and first.isalpha() else self.encode(first)
            return begin + b"".join(map(self.__getitem__, rest))
        except _OtherSpace:
            return self.encode(text)


_ENCODERS: dict[tuple[str, int], PieceIds] = {}


def _encoder(path: str, most: int) -> PieceIds:
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = PieceIds(path, most)
    return _ENCODERS[path, most]


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", row_stride: int = 10_000, stripe_bytes: int = 64 << 20, kept_pieces: int = KEPT_PIECES) -> str:
    """Write the ids of all documents in ascending order of the id; return ``path``. A Python worker
    goes on holding up to ``kept_pieces`` pieces; 600,000 took 100 MB."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("tie"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(tokenizer_path, kept_pieces), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                piece = batch.slice(at, DOCUMENTS_AT_ONCE)
                ids = [encoder.of_text(t.as_py()) + end for t in piece.column(1)]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(n, part, np.int32)), pa.array(start + ends[:-1], pa.int64()), pa.array(start + ends[1:], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                    names=["doc_id", "part", "start_in_part", "end_in_part", "ids"],
                )
                start += int(ends[-1])

    encoded = ordered.mapInArrow(encode, f"doc_id {kind}, part int, start_in_part long, end_in_part long, ids array<int>")
    # Run lengths leave little for a general compression to find, at several times the cost.
    encoded.write.option("compression", "none").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", str(row_stride)).option("orc.stripe.size", str(stripe_bytes)).option("orc.create.index", "true").orc(path)
    return path


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document: ``start`` counts the ids of all documents before it."""
    rows = spark.read.orc(path)
    # A row for each file, so broadcasting it costs a few bytes a file.
    sizes = rows.groupBy("part").agg(F.max("end_in_part").alias("part_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select(F.col("part").alias("part_no"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(parts), rows["part"] == parts["part_no"]).select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``."""
    rows = read_token_ids(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_ids_round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the files and report on each document from what they hold."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    write_token_ids(docs, tokenizer_path, path, **options)
    return token_digests(spark, path)

"""Token counts by heap-and-linked-list byte-pair merging.

``count_tokens`` gives, for every row, how many tokens a SentencePiece BPE vocabulary makes of
the whole text. Symbols start as characters (a character outside the vocabulary counts as its
UTF-8 bytes); the adjacent pair of lowest rank is popped from a heap and joined in a linked
list until no pair is left, and the count is the initial symbols minus the merges. No
identifier is made.

No piece of the vocabulary has a space after another character, and most pairs of characters
occur next to each other in no piece at all. No merge can cross such a place, so a text falls
into parts that are counted alone; a bounded memo holds the counts of parts seen before.

Defined cases: null and empty texts have 0 tokens and 0 bytes; a null id is passed through;
repeated rows are counted each; an empty table gives an empty result. Other columns of the
input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_RUNS = re.compile(" +[^ ]*")


class PieceVocabulary:
    """The mergeable pieces of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        self.adjacent = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(SPACE in pair[1:] and pair[0] != SPACE for pair in self.adjacent):
            raise ValueError("the vocabulary has a piece with a space after another character")


def merged_count(symbols: list[str], rank: dict[str, float]) -> int:
    """Tokens left of ``symbols`` after all merges."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        if (r := rank.get(pair)) is not None:
            heap.append((r, i, pair))
    heapify(heap)
    symbols = symbols.copy()
    merges = 0
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if j >= n or symbols[i] is None or symbols[i] + symbols[j] != pair:
            continue
        symbols[i], symbols[j] = pair, None
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            wider = pair + symbols[k]
            if (r := rank.get(wider)) is not None:
                heappush(heap, (r, i, wider))
        h = before[i]
        if h >= 0:
            wider = symbols[h] + pair
            if (r := rank.get(wider)) is not None:
                heappush(heap, (r, h, wider))
    return n - merges


class _Parts(dict):
    """Counts of the stretches in which merges can happen."""

    def __init__(self, vocabulary: PieceVocabulary, most: int):
        super().__init__()
        self.rank, self.most = vocabulary.rank, most

    def __missing__(self, part: str) -> int:
        if len(part) == 1:
            count = 1 if part in self.rank else len(part.encode())
        else:
            count = merged_count(list(part), self.rank)
        if len(part) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[part] = count
        return count


class WordCounts(dict):
    """Tokens of a word: a space and what follows up to the next space."""

    def __init__(self, vocabulary: PieceVocabulary, most: int = 400_000):
        super().__init__()
        self.adjacent, self.most, self.parts = vocabulary.adjacent, most, _Parts(vocabulary, most)

    def __missing__(self, word: str) -> int:
        text = SPACE + word.replace(" ", SPACE)
        adjacent, parts = self.adjacent, self.parts
        count = start = 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in adjacent:
                count += parts[text[start:i]]
                start = i
        count += parts[text[start:]]
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = count
        return count

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        if "  " in text or text.endswith(" "):
            words = [run[1:] for run in _RUNS.findall(text)]
        else:
            words = text.split(" ")[1:]
        return sum(map(self.__getitem__, words))


_COUNTS: dict[str, WordCounts] = {}


def _counter(path: str) -> WordCounts:
    """One for each Python worker, which serves many tasks."""
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(PieceVocabulary(path))
    return _COUNTS[path]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_bytes, n_tokens) for every row. One pass over the table without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _counter(vocabulary_path)
        for batch in batches:
            tokens = [words.of_text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("body"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")

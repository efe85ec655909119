"""Token counts of a piece BPE model by heap-and-linked-list merging, without emitting any id.

The symbols of a unit form a doubly linked list; a heap holds its mergeable neighbours by rank (score, then
leftmost). The best pair is popped and merged until none is left: the count is the initial symbols minus the
merges, with a symbol outside the vocabulary counted as its bytes, where the model falls back to bytes.

Merges are local: no piece of the vocabulary spans certain neighbouring characters (for instance a letter and
the space after it), so a text is cut there and each cut's count is exact on its own. Counts of units are
remembered by each worker, up to ``CACHE`` of them; a unit is then merged again when it recurs.

A null text counts as empty: 0 bytes and 0 tokens. Repeated rows and rows with a null id are each counted.
An empty table gives an empty result. Extra columns are ignored. Texts are counted whole and no row is shuffled.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

CACHE = 600_000
SPACE = "▁"
_counters: dict[str, Counter] = {}


class Counter(dict):
    """Maps a space-delimited word to the tokens of the word with its leading space."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        plain = [i for i in range(model.get_piece_size()) if not any(k(i) for k in kinds)]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.bytes = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # the fast way holds where a space only ever begins a piece
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.parts: dict[str, int] = {}

    def merged(self, unit: str) -> int:
        """Tokens of a unit, by heap and linked list."""
        rank = self.rank
        n = len(unit)
        if n == 1:
            return 1 if unit in rank or not self.bytes else len(unit.encode())
        text: list[str | None] = list(unit)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, unit[i : i + 2]) for i in range(n - 1) if (r := rank.get(unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = text[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(text[j]) != len(piece) or left + text[j] != piece:
                continue
            merges += 1
            text[i], text[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(both := piece + text[k])) is not None:
                    heapq.heappush(heap, (r, i, both))
            if (h := before[i]) >= 0 and (r := rank.get(both := text[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, both))
        extra = 0
        if self.bytes:
            extra = sum(len(t.encode()) - 1 for t in text if t is not None and len(t) == 1 and t not in rank)
        return n - merges + extra

    def unit(self, unit: str) -> int:
        """Tokens of a unit, cut where no piece can span."""
        total, start = 0, 0
        joined, parts = self.joined, self.parts
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in joined:
                part = unit[start:i]
                found = parts.get(part)
                if found is None:
                    found = self.merged(part)
                    if len(part) <= 64:
                        if len(parts) >= CACHE:
                            parts.clear()
                        parts[part] = found
                total += found
                start = i
        return total

    def __missing__(self, word: str) -> int:
        found = self.unit(SPACE + word)
        if len(word) <= 32 and "\n" not in word:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a text as the model's library gives them: one space is put in front, spaces become marks."""
        if not text:
            return 0
        words = text.split(" ")
        if self.by_word and SPACE not in text and "" not in words:
            return sum(map(self.__getitem__, words))
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.unit(marked)
        return sum(map(self.unit, re.findall(f"{SPACE}+[^{SPACE}]*", marked)))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def run(batches):
        c = counter(model_path)
        for whole in batches:
            for b in kernels.slices(whole, "text", 8 << 20):
                _, offsets = kernels.text_buffers(b.column(1))
                n = np.fromiter((c.count(t.as_py() or "") for t in b.column(1)), np.int64, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

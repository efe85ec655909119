"""Best-fit packing of token sequences by hierarchical merging of underfull bins.

Each task tokenizes its documents, cuts the longer ones into pieces, and best-fits the pieces into bins of
``capacity``, largest first. Bins that are full but for ``SLACK`` tokens are final. The others go on as
items: rounds regroup them, ``GROUP`` bins or fewer to a task, and best-fit them again, until one task has
held all that is left or a round saves less than one bin in a thousand. Only underfull bins are shuffled; a task's work is
bounded however many there are (items over half the capacity never fit together, and simply end as bins).

A document of more than ``capacity`` tokens is cut so that its first piece may be shorter and all others are
full. A null text is an empty text; every document has at least its ending token, hence a piece. Repeated
rows and rows with a null id are packed each on its own. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

SLACK = 2
GROUP = 200_000
CACHE = 300_000  # units of a generation
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts, as the tokenizer library gives them, remembered by space-delimited unit.

    In a byte-level BPE with the usual splitting rule no token spans a single space or line break from the
    character before it, so a text whose white space is single spaces and line breaks is the sequence of its units.
    Any other text is encoded whole. Units are remembered in two generations: a full one becomes the older, and what is met again moves over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.newline = self.encode("\n")
        self.marks = {x: self.encode(x) for x in (".", ",")}
        # a word of Latin letters after a space is one piece of the usual splitting rule, so the library's model may have it at once
        split, model = t.pre_tokenizer, t.model
        usual = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and t.normalizer is None and t.truncation is None and t.padding is None
        plain = isinstance(model, models.BPE) and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        apart = not any(a.content.isalpha() for a in t.get_added_tokens_decoder().values())
        self.model = model if usual and plain and apart else None
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.bytes = {c: 256 + n for n, c in enumerate(c for c in range(256) if c not in shown)}
        self.units = _Units(self, {})

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """The ids of a word and the space before it, if any."""
        letters = text[1:] if text[0] == " " else text
        if self.model is None or not letters.isalpha():
            return self.encode(text)
        if text.isascii():
            text = text.replace(" ", "\u0120")
        elif max(letters) > "\u024f":
            return self.encode(text)
        else:
            text = text.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self.units) > CACHE:
            self.units = _Units(self, dict(self.units))
        units = text.replace("\n", " \n").split(" ")
        units[0] = " " + units[0]
        try:
            return b"".join(map(self.units.__getitem__, units))
        except _Odd:
            return self.encode(text)

    def forget(self) -> None:
        """Lets go of all units: workers outlive a task, and what follows in them needs the memory."""
        self.units = _Units(self, {})


class _Odd(ValueError):
    """White space other than a single space or line break between words."""


class _Units(dict):
    """Ids of units: a word alone follows a space, after a line break it keeps the break, and the first of a text has a space."""

    def __init__(self, encoder: Encoder, older: dict[str, bytes]):
        super().__init__()
        self.encoder, self.older = encoder, older

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None and unit.isalpha():
            found = self.encoder.word(" " + unit)
        elif found is None:
            lead = unit[:1]
            word = unit[1:] if lead in (" ", "\n") else unit
            if word.split() != [word]:
                raise _Odd
            if word[-1] in (".", ",") and word[:-1].isalpha():
                found = self[unit[:-1]] + self.encoder.marks[word[-1]]  # letters and punctuation never share a token
            elif lead == "\n":
                found = self.encoder.newline + self.encoder.word(word)
            else:
                found = self.encoder.word(word if lead == " " else " " + word)
        if len(unit) <= 64:
            self[unit] = found
        return found


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items are taken largest first, each into the fullest bin that holds it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets


_SCHEMA = pa.schema([("bin", pa.int64()), ("final", pa.bool_()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_SQL = "bin long, final boolean, doc_id long, piece int, start long, length long, ids_crc32 long, offset long"


def _tokenize(path: str, end_id: int, capacity: int):
    def run(batches):
        common.trim()  # what earlier tasks of this worker left
        enc = encoder(path)
        end = array("I", [end_id]).tobytes()
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def flush():
            nonlocal number
            length = np.array([r[3] for r in rows], np.int64)
            bins, offsets = best_fit(length, capacity)
            fill = np.bincount(bins, length)
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(bins + number), pa.array(fill[bins] >= capacity - SLACK), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(length), pa.array(cols[4], pa.int64()), pa.array(offsets)], schema=_SCHEMA)
            number += len(fill)
            rows.clear()
            return out

        for batch in (b for whole in batches for b in kernels.slices(whole, "text")):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "") + end
                n = len(ids) // 4
                cut = n % capacity or capacity
                start, piece = 0, 0
                while start < n:
                    stop = cut if not start else start + capacity
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, piece = stop, piece + 1
                if len(rows) >= GROUP:
                    yield flush()
        if rows:
            yield flush()
        enc.forget()
        common.trim()

    return run


def _merge(capacity: int, last: bool):
    def run(key, table):
        b = table["bin"].to_numpy()
        table = table.take(pa.array(np.lexsort((table["offset"].to_numpy(), b))))
        b, length = table["bin"].to_numpy(), table["length"].to_numpy()
        ids, item = np.unique(b, return_inverse=True)
        fill = np.bincount(item, length).astype(np.int64)
        bins, offsets = best_fit(fill, capacity)
        whole = np.bincount(bins, fill)
        lead = np.zeros(len(whole), np.int64)
        lead[bins[::-1]] = ids[::-1]  # a merged bin is named after one of its members
        final = np.ones(len(b), bool) if last else whole[bins[item]] >= capacity - SLACK
        new = {"bin": pa.array(lead[bins[item]]), "final": pa.array(final), "offset": pa.array(table["offset"].to_numpy() + offsets[item])}
        return pa.Table.from_arrays([new[n] if n in new else table[n] for n in _SCHEMA.names], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    state = common.staged(texts.mapInArrow(_tokenize(tokenizer_path, end_id, capacity), _SQL), "packed")
    done = [state.where("final")]
    left, turn = state.where("not final"), 0
    before = None
    while True:
        n = left.select("bin").distinct().count()
        if not n:
            break
        if before is not None and n > 0.999 * before:
            done.append(left)
            break
        groups = math.ceil(n / GROUP)
        g = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)).alias("g")
        merged = left.select(g, *_SCHEMA.names).groupBy("g").applyInArrow(_merge(capacity, groups == 1), _SQL)
        state = common.staged(merged, "packed")
        done.append(state.where("final"))
        left, turn, before = state.where("not final"), turn + 1, n
        if groups == 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")

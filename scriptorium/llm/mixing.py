"""Mixing sources to target weights by pseudorandom draws of fixed-length blocks.

The words of each source are laid end to end and cut into blocks of ``block`` words. The mix is a row of
output shards of ``shard`` slots. Each shard draws its count of slots per source from a multinomial whose
chances are the sources' remaining targets (shards are drawn along a binary tree, so that any shard can be
drawn alone, and counts that exceed what a source still owes go to the others: totals are exact, where free
draws would miss small targets). Slot j of a source is the block at position j of a keyed permutation of the
source's block numbers, a new permutation for every pass over the source. Blocks are joined to slots by number.
The last slot of a source is cut so that the source gives exactly floor(target) words.

Targets: the total number of words, shared by weight; a source's target stops at ``most`` times its size and
the excess goes to the others by weight. No document gives more than ``most`` times its size, as each pass
takes a block at most once.

Scale: positions in a source are prefix sums over ``BUCKETS`` hash buckets per source, so a source that holds
a third of all rows is spread over as many groups. Only ids and sizes are shuffled. Sources are counted on the
driver, one row each, at most ``MAX_SOURCES``.

Defined results: null text has size 0 and gives nothing; null source is a source, after all others; rows with a
null id are mixed like others; repeated rows count each. An empty table gives an empty result.
Extra columns are ignored by plan() and kept by mixed_documents().
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels

BUCKETS = 4096
MAX_SOURCES = 1_000_000
SEED = 20250


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, src (sorts as the source by code point, null last), size in words, text_hash."""

    def run(batches):
        for whole in batches:
            for b in kernels.slices(whole, "text", 8 << 20):
                n = kernels.word_counts(*kernels.text_buffers(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), b.column(3)], names=["doc_id", "src", "size", "text_hash"])

    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, src string, size long, text_hash long")


def targets(totals: list[tuple[str, int]], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str, float]:
    """Target words of each source, given (source, words): the whole shared by weight, capped, the excess reshared."""
    order = sorted(totals, key=lambda x: x[0].encode())
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, share, out = sum(n for _, n in order), sum(weight.values()), {}
    level = None  # words per unit of weight of the sources below their cap
    for s, n in sorted(order, key=lambda x: (most * x[1] / weight[x[0]], x[0].encode())):
        if level is None and most * n * share <= left * weight[s]:
            out[s] = float(most * n)
            left, share = left - most * n, share - weight[s]
        else:
            level = left / share if level is None else level
            out[s] = level * weight[s]
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1 for each element: a four-round Feistel network walked until it is inside."""
    x, n, key = (np.asarray(v).astype(np.uint64) for v in (x, n, key))
    salts = [np.array([r], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for r in range(4)]
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(float), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in (3, 2, 1, 0) if inverse else (0, 1, 2, 3):
            salt = k + salts[r]
            if inverse:
                left, right = right ^ (kernels.mix64(left ^ kernels.mix64(salt)) & m), left
            else:
                left, right = right, left ^ (kernels.mix64(right ^ kernels.mix64(salt)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def shard_counts(slots: np.ndarray, shard: int, g: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in shard g, and how many the shards before it hold."""
    total = int(slots.sum())
    lo, hi = 0, max(1, -(-total // shard))
    here, before = slots.astype(np.int64).copy(), np.zeros(len(slots), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        room = (mid - lo) * shard
        rng = np.random.default_rng((seed, lo, hi))
        left = np.minimum(rng.multinomial(room, here / here.sum()), here)
        short = room - int(left.sum())
        while short > 0:  # what some sources no longer owe, the others give
            free = here - left
            give = np.minimum(free, np.ceil(short * free / free.sum()).astype(np.int64))
            over = np.maximum(0, np.cumsum(give) - short)
            give = np.maximum(0, give - np.minimum(give, over))
            left += give
            short -= int(give.sum())
        if g < mid:
            here, hi = left, mid
        else:
            here, before, lo = here - left, before + left, mid
    return here, before


def plan(docs: DataFrame, weights=(1, 2, 3), most: int = 3, block: int = 128, shard: int = 8192) -> DataFrame:
    """One row per document and taken stretch: doc_id, src, text_hash, twin (numbers equal rows), size, source_size,
    target, and pass, from_word, to_word (of the document; null where nothing of it is taken)."""
    spark = docs.sparkSession
    sized = common.staged(sizes(docs), "sizes")
    totals = [(r["src"], r["n"]) for r in sized.groupBy("src").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = targets(totals, weights, most)
    info = pd.DataFrame([(s, n, target[s]) for s, n in sorted(totals, key=lambda x: x[0].encode())], columns=["src", "source_size", "target"])
    n_words = info["source_size"].to_numpy(np.int64)
    want = np.floor(info["target"].to_numpy(float)).astype(np.int64)
    blocks = -(-n_words // block)
    whole = np.where(n_words > 0, want // np.maximum(n_words, 1), 0)
    rest = want - whole * n_words
    short = blocks * block - n_words
    slots = whole * blocks + np.minimum(blocks, -(-(rest + np.where(rest > 0, short, 0)) // block))
    keys = kernels.mix64(np.arange(len(info)).astype(np.uint64) + np.uint64(SEED))

    source = spark.createDataFrame(info.assign(s=range(len(info))), "src string, source_size long, target double, s int")
    bucket = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS))
    rows = sized.withColumn("bucket", bucket)
    per = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    per = per.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("base"))
    ordered = Window.partitionBy("src", "bucket").orderBy("doc_id", "text_hash", "size")
    rows = rows.join(per, ["src", "bucket"]).withColumn("start", F.col("base") + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.withColumn("twin", F.row_number().over(Window.partitionBy("src", "bucket", "doc_id", "text_hash").orderBy("start")))
    rows = rows.join(source, "src").drop("bucket", "base")
    last = F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    rows = rows.withColumn("index", F.explode(F.sequence(F.floor(F.col("start") / block), last)))

    n_shards = max(1, math.ceil(int(slots.sum()) / shard))

    def draw(frames):
        for frame in frames:
            for g in frame["id"].tolist():
                here, before = shard_counts(slots, shard, g)
                s = np.repeat(np.arange(len(slots)), here)
                j = np.arange(len(s)) - np.repeat(np.cumsum(here) - here, here) + before[s]
                turn = j // np.maximum(blocks[s], 1)
                at = j - turn * blocks[s]
                salt = keys[s] ^ kernels.mix64(turn.astype(np.uint64) + np.uint64(77))
                index = permuted(at, blocks[s], salt)
                length = np.where(index == blocks[s] - 1, block - short[s], block)
                # words that earlier slots of this pass hold: full blocks, but for the short one if it came before
                tail = permuted(blocks[s] - 1, blocks[s], salt, inverse=True)
                past = at * block - np.where(tail < at, short[s], 0)
                take = np.where(turn < whole[s], length, np.clip(rest[s] - past, 0, length))
                yield pd.DataFrame({"s": s.astype(np.int32), "index": index, "pass": turn.astype(np.int32), "take": take, "shard": np.full(len(s), g)})[take > 0]

    tasks = max(1, min(n_shards, 4 * common.shuffle_width(spark)))
    drawn = spark.range(0, n_shards, 1, tasks).mapInPandas(draw, "s int, index long, pass int, take long, shard long")
    # Spark takes a Python stage's output to be as small as its input, here a range; the slots grow with the corpus
    joined = rows.join(drawn.hint("merge"), ["s", "index"], "left")
    offset = F.col("index") * block
    begin = F.greatest(F.col("start"), offset)
    end = F.least(F.col("start") + F.col("size"), offset + F.col("take"))
    taken = F.col("take").isNotNull() & (end > begin)  # least() passes over a missing take
    return joined.select(
        "doc_id", "src", "text_hash", "twin", "size", "source_size", "target", F.when(taken, F.col("pass")).alias("pass"),
        F.when(taken, begin - F.col("start")).alias("from_word"), F.when(taken, end - F.col("start")).alias("to_word"),
    )


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, taken words."""
    n = F.coalesce(F.col("to_word") - F.col("from_word"), F.lit(0))
    out = plan(docs, **options).groupBy("doc_id", "src", "text_hash", "twin", "size", "source_size", "target").agg(F.sum(n).alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for every pass a document is taken in, one row with all its columns whose text holds the
    stretches taken (the whole text as it was where all words are). n_chars, if there, is counted anew."""
    parts = plan(docs, **options).where("to_word is not null").groupBy("doc_id", "src", "text_hash", "twin", "size", "pass").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"))
    per_doc = parts.groupBy("doc_id", "src", "text_hash", "twin").agg(F.array_sort(F.collect_list(F.struct("pass", "spans"))).alias("passes"))
    per_doc = per_doc.select(F.col("doc_id").alias("_mix_id"), F.col("src").alias("_mix_src"), F.col("text_hash").alias("_mix_hash"), F.col("twin").alias("_mix_twin"), F.col("passes").alias("_mix_passes"))
    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    keyed = docs.select("*", F.col("doc_id").cast("long").alias("_id"), src.alias("_src"), F.xxhash64("text").alias("_hash"))
    keyed = keyed.withColumn("_twin", F.row_number().over(Window.partitionBy("_id", "_src", "_hash").orderBy(F.lit(1))))
    joined = keyed.join(per_doc, F.col("_id").eqNullSafe(F.col("_mix_id")) & (F.col("_src") == F.col("_mix_src")) & (F.col("_hash") == F.col("_mix_hash")) & (F.col("_twin") == F.col("_mix_twin")))
    joined = joined.select(*docs.columns, F.col("_mix_passes"))
    names, schema = docs.columns, docs.schema

    def run(batches):
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                at = b.schema.get_field_index("text")
                buf, offsets = kernels.text_buffers(b.column(at))
                w = kernels.words_of(buf, offsets)
                row, text = [], []
                for i, passes in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    first, count = int(w.first[i]), int(w.first[i + 1] - w.first[i])
                    for p in passes:
                        spans: list[list[int]] = []
                        for s in p["spans"]:
                            if spans and spans[-1][1] == s["from_word"]:
                                spans[-1][1] = s["to_word"]
                            else:
                                spans.append([s["from_word"], s["to_word"]])
                        row.append(i)
                        if spans == [[0, count]]:
                            text.append(buf[offsets[i] : offsets[i + 1]].tobytes().decode())
                        else:
                            text.append(" ".join(buf[w.start[first + f] : w.end[first + t - 1]].tobytes().decode() for f, t in spans))
                out = pa.Table.from_batches([b]).select(names).take(pa.array(row, pa.int64()))
                out = out.set_column(names.index("text"), "text", pa.array(text, out.schema.field("text").type))
                if "n_chars" in names:
                    kind = out.schema.field("n_chars").type
                    out = out.set_column(names.index("n_chars"), "n_chars", pa.array([len(t) for t in text], pa.int64()).cast(kind))
                yield from out.combine_chunks().to_batches()

    return joined.mapInArrow(run, schema)

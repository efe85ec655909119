"""Quality rules with thresholds learnt from mergeable quantile sketches per language and source.

Two layers. The fixed base rule fails a text of fewer than ``min_words`` words, or one of whose words
more than ``max_repeat_percent`` per cent lie in windows of ``window`` words that occur twice or more.
The adaptive layer replaces further fixed cut-offs: for each (lang, source) group and each measure a
quantile sketch gives an upper fence from median and upper quartile, and a text beyond its own group's fence is rejected.

The sketch is a log-bucketed histogram (relative error ``ACCURACY``): bucket counts add up, so merging
is a sum, exact in any order, and reruns agree. A group has at most a few thousand buckets a measure, so
pre-aggregated counts are all that is shuffled, however large a group is.

Rows in which a column is null: a null text has no words and fails; null lang or source form groups of
their own. Repeated rows are judged each alike. An empty table gives an empty result. Extra columns of
the input are ignored by measure() and verdicts(), and kept by filter_quality().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["mean_word", "symbols", "dup_lines", "repeats"]
ACCURACY = 0.001  # spreads are differences of near values, which a coarser sketch would blur
REACH = 8.0
PRIOR = 50  # texts
#: Least spread of a measure, in its own unit.
LEAST = {"mean_word": 0.05, "symbols": 0.01, "dup_lines": 0.04, "repeats": 0.03}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_counts(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of COUNTS and n_lines (lines with a word) for each text of a string column."""
    buf, offsets = kernels.text_buffers(column)
    n = len(offsets) - 1
    w = kernels.words_of(buf, offsets)
    n_words = np.diff(w.first)
    inside = ~kernels._SEP[buf] & ((buf & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": kernels.per_doc(inside, offsets), "n_symbols": kernels.per_doc(_SYMBOL[buf], offsets)}

    newline = np.flatnonzero(buf == 0x0A)
    start = np.sort(np.concatenate((offsets[:-1], newline + 1)))
    doc = np.searchsorted(offsets[1:], start, side="right")
    # line starts past the last byte of a text belong to it: an ending newline opens an empty line
    doc = np.minimum(doc, max(n - 1, 0))
    end = np.concatenate((start[1:], [len(buf)])) if len(start) else start
    with_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[with_word], end[with_word], doc[with_word]
    end = end - ((end > start) & (buf[np.maximum(end - 1, 0)] == 0x0A)) if len(end) else end
    h = kernels.span_hash(buf, start, end)
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][again], minlength=n)[:n]
    out["n_lines"] = np.bincount(doc, minlength=n)[:n]

    m = len(w.hash) - window + 1
    repeated = np.zeros(n, dtype=np.int64)
    if m > 0:
        ok = w.doc[:m] == w.doc[window - 1 :]
        h = np.zeros(m, dtype=np.uint64)
        for k in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + m]
        at = np.flatnonzero(ok)
        h = kernels.mix64(h[at] ^ kernels.mix64(w.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + window, -1)
        repeated = np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=n)[:n]
    out["n_repeat_words"] = repeated
    return out


def base_failed(counts: dict, min_words: int, max_repeat_percent: int):
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])


def measures(c: dict) -> dict[str, np.ndarray]:
    """Ratios that the sketches hold; each is 0 or more, and larger means worse or odder."""
    words = np.maximum(c["n_words"], 1)
    return {
        "mean_word": c["word_chars"] / words,
        "symbols": c["n_symbols"] / words,
        "dup_lines": c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        "repeats": c["n_repeat_words"] / words,
    }


def measure(docs: DataFrame, window: int = 8) -> DataFrame:
    """One row per document: doc_id, lang, source, COUNTS and n_lines. No shuffle."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"])

    def run(batches):
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                c = text_counts(b.column(1), window)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *(pa.array(c[k].astype(np.int64)) for k in [*COUNTS, "n_lines"])], names=["doc_id", "lang", "source", *COUNTS, "n_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").mapInArrow(run, schema)


def _ratio(name: str):
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }[name]


def fences(measured: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, reach: float = REACH, least: dict[str, float] | None = None) -> DataFrame:
    """Upper fence of each measure per (lang, source), from the sketches of the texts that pass the base rule: the
    median plus ``reach`` times the spread, which is the distance from the median to the upper quartile.

    Junk moves these two little as long as it is under a quarter of a group. A group whose median lies beyond the fence of
    its language is mostly junk and takes the language's median and spread; every other group's are drawn to the
    language's with the weight of ``PRIOR`` texts, and its spread is at most twice that of the language, whose own
    spread is drawn to the corpus's likewise (not its median: languages differ in the length of words). A spread is at least
    ``least``, so that groups whose texts are all alike keep what differs by a hair.
    """
    least = LEAST if least is None else least
    gamma = math.log((1 + ACCURACY) / (1 - ACCURACY))
    passed = measured.where((F.col("n_words") >= min_words) & (100 * F.col("n_repeat_words") <= max_repeat_percent * F.col("n_words")))
    long = passed.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _ratio(k).alias("v")) for k in MEASURES))).alias("m"))
    bucket = F.when(F.col("m.v") <= 1e-6, F.lit(-(10**6))).otherwise(F.ceil(F.log(F.col("m.v")) / gamma).cast("int"))
    sketch = common.staged(long.groupBy("lang", "source", F.col("m.k").alias("k"), bucket.alias("bucket")).agg(F.count("*").alias("n")), "sketch")

    def quantile(q: float):
        need = F.ceil(F.lit(q) * F.col("total"))
        hit = F.aggregate(
            "s", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["n"] >= need), x["bucket"]).otherwise(a["at"]).alias("at")),
        )["at"]
        return F.when(hit == -(10**6), F.lit(0.0)).otherwise(F.exp(hit * F.lit(gamma)) * (1 - ACCURACY))

    def level(name: str, *keys: str) -> DataFrame:
        """Texts, median and spread at this level; sketches merge by adding up, and one is bounded by its number of buckets."""
        counts = sketch.groupBy(*keys, "k", "bucket").agg(F.sum("n").alias("n"))
        merged = counts.groupBy(*keys, "k").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("total"))
        return merged.select(*(F.col(c).alias(f"{name}_{c}") for c in (*keys, "k")), F.col("total").alias(f"{name}_n"), quantile(0.5).alias(f"{name}_mid"), (quantile(0.75) - quantile(0.5)).alias(f"{name}_spread"))

    def drawn(own: str, to: str, n: str):
        return (F.col(n) * F.col(own) + PRIOR * F.col(to)) / (F.col(n) + PRIOR)

    corpus, langs, groups = level("c"), level("l", "lang"), level("g", "lang", "source")
    floor = lambda k: F.coalesce(*(F.when(F.col(k) == m, F.lit(v)) for m, v in least.items()))
    langs = langs.join(corpus, F.col("l_k") == F.col("c_k")).select("l_lang", "l_k", "l_mid", F.greatest(floor("l_k"), drawn("l_spread", "c_spread", "l_n")).alias("l_spread"))
    rows = groups.join(langs, F.col("g_lang").eqNullSafe(F.col("l_lang")) & (F.col("g_k") == F.col("l_k")))
    junk = F.col("g_mid") > F.col("l_mid") + reach * F.col("l_spread")
    mid = F.when(junk, F.col("l_mid")).otherwise(drawn("g_mid", "l_mid", "g_n"))
    spread = F.when(junk, F.col("l_spread")).otherwise(F.greatest(floor("g_k"), F.least(drawn("g_spread", "l_spread", "g_n"), 2 * F.col("l_spread"))))
    rows = rows.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.col("g_k").alias("k"), (mid + reach * spread).alias("fence"))
    return rows.groupBy("lang", "source").pivot("k", MEASURES).agg(F.first("fence"))


def verdicts(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept: the base rule, then the fences joined by language and source."""
    measured = common.staged(measure(docs, window), "measured")
    limits = common.staged(fences(measured, min_words, max_repeat_percent), "fences").select(F.col("lang").alias("l"), F.col("source").alias("s"), *MEASURES)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    beyond = F.lit(False)
    for k in MEASURES:
        beyond = beyond | F.coalesce(_ratio(k) > F.col(k), F.lit(False))
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~beyond).alias("kept"))


def filter_quality(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """The documents that the rules keep, all columns as they came. The texts themselves are never shuffled unless
    the fences outgrow Spark's broadcast threshold."""
    measured = common.staged(measure(docs, window), "measured")
    limits = common.staged(fences(measured, min_words, max_repeat_percent), "fences")
    names = [f"_fence_{k}" for k in MEASURES]
    limits = limits.select(F.col("lang").alias("_fence_lang"), F.col("source").alias("_fence_source"), *(F.col(k).alias(n) for k, n in zip(MEASURES, names, strict=True)))
    joined = docs.join(limits, docs["lang"].eqNullSafe(limits["_fence_lang"]) & docs["source"].eqNullSafe(limits["_fence_source"]), "left")
    fields = [f.name for f in docs.schema.fields]

    def run(batches):
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                c = text_counts(b.column(b.schema.get_field_index("text")), window)
                bad = base_failed(c, min_words, max_repeat_percent)
                for (_, v), name in zip(measures(c).items(), names, strict=True):
                    fence = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float)
                    bad |= np.nan_to_num(v) > np.where(np.isnan(fence), np.inf, fence)
                yield b.select(fields).filter(pa.array(~bad))

    return joined.drop("_fence_lang", "_fence_source").mapInArrow(run, docs.schema)

"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased; every run of characters that are no letters or marks becomes one space. The n-gram counts
of a bounded sample of labelled texts (about ``sample_chars`` characters a language, whole texts chosen by
hash) make one model of order ``ORDER`` per language: absolute discounting at the top, continuation counts
below, all orders interpolated. The models lie in sorted arrays of n-gram hashes with one column of log
probabilities per language, so a position of a text costs one binary search at the top order, and more only
where no language knows the n-gram. The language of lowest cross-entropy per character wins.

The score is a calibrated probability: a softmax whose temperature minimises the log loss on labelled texts
apart from those counted. Rejection: a text whose cross-entropy exceeds what ``1 - REJECT`` of the calibration
texts of the winning language stay under, by a margin, is marked as rejected.

The model is at most ``MODEL_BYTES`` large (rarest n-grams are left out beyond that) and at most
``MAX_LANGUAGES`` languages with the most labelled texts are learnt; the bounds concern only what is learnt from.

A null text, or one without a letter, gets ``und`` and score 0; so do all where nothing could be learnt. A null
lang is never learnt from; rows with a null id are predicted but not learnt from. Repeated rows are each
predicted alike. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

ORDER = 4
MODEL_BYTES = 64 << 20
MAX_LANGUAGES = 256
REJECT = 0.005
MARGIN = 0.75
_UNIFORM = 1 / 5000
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters or marks."""
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])
    return _letters


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the normalised texts, each text after ORDER - 1 zeros; begin of each; letters of each."""
    gap = "\0" * (ORDER - 1)
    joined = "".join(gap + (t or "").replace("\0", " ") for t in texts).lower()
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[cp]
    zero = cp == 0
    space = ~letter & ~zero
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    out = np.where(space, np.uint32(0x20), cp)[keep]
    zero = out == 0
    first = np.flatnonzero(zero)[:: ORDER - 1] if len(out) else np.zeros(0, np.int64)
    alpha = np.concatenate(([0], np.cumsum(letter[keep])))
    return out, first, np.diff(np.append(alpha[first], alpha[-1]))


def gram_keys(cp: np.ndarray, order: int, before: int = 0) -> np.ndarray:
    """Hash of the n-gram that ends at, or so many places before, each position from ORDER - 1 on."""
    h = np.full(len(cp) - ORDER + 1, order, np.uint64)
    for k in range(order - 1 + before, before - 1, -1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[ORDER - 1 - k : len(cp) - k].astype(np.uint64) + np.uint64(1)
    return kernels.mix64(h)


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order from 1: sorted hashes, the last entry a sentinel
    logp: list[np.ndarray]  # by order from 1: (n-grams, languages)
    context: list[np.ndarray]  # by order from 2: sorted hashes of contexts
    back: list[np.ndarray]  # by order from 2: log weight of the order below
    unseen: np.ndarray  # log probability of an unknown character
    temperature: float = 1.0
    limit: np.ndarray | None = None

    def score(self, cp: np.ndarray) -> np.ndarray:
        """Log probability of the character at each position from ORDER - 1 on, under each language."""
        n = len(cp) - ORDER + 1
        out = np.zeros((n, len(self.langs)), np.float32)
        todo = np.arange(n)
        for order in range(ORDER, 0, -1):
            key = gram_keys(cp, order)[todo]
            at = np.searchsorted(self.keys[order - 1], key)
            hit = self.keys[order - 1][at] == key
            out[todo[hit]] += self.logp[order - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if order > 1:
                ctx = gram_keys(cp, order - 1, 1)[todo]
                at = np.searchsorted(self.context[order - 2], ctx)
                hit = self.context[order - 2][at] == ctx
                out[todo[hit]] += self.back[order - 2][at[hit]]
            else:
                out[todo] += self.unseen
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log probability of each text per language, its length, its letters."""
        cp, first, alpha = characters(texts)
        total = np.zeros((len(texts), len(self.langs)), np.float64)
        length = np.diff(np.append(first, len(cp))) - (ORDER - 1)
        if len(cp) < ORDER:
            return total, length, alpha
        begin = first  # position ORDER - 1 of a text, shifted by ORDER - 1
        step = max(1 << 12, (24 << 20) // (4 * len(self.langs)))
        for s in range(0, len(cp) - ORDER + 1, step):
            part = cp[s : s + step + ORDER - 1]
            value = self.score(part)
            value[part[ORDER - 1 :] == 0] = 0
            owner = np.searchsorted(begin, np.arange(s, s + len(value)), side="right") - 1
            edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            total[owner[edge]] += np.add.reduceat(value, edge, axis=0, dtype=np.float64)
        return total / np.maximum(length, 1)[:, None], length, alpha

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        mean, length, alpha = self.texts(texts)
        best = mean.argmax(axis=1)
        p = posterior(mean, length, self.temperature)[np.arange(len(texts)), best]
        none = alpha == 0
        rejected = none | (-mean[np.arange(len(texts)), best] > self.limit[best])
        return ["und" if x else self.langs[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, p), rejected


def posterior(mean: np.ndarray, length: np.ndarray, temperature: float) -> np.ndarray:
    x = mean * (np.minimum(length, 400) / temperature)[:, None]
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """The models from counts: language index, ORDER code points, how often."""
    n_lang = len(langs)
    uniq, inv = np.unique(gram, axis=0, return_inverse=True)
    inv = inv.ravel()
    while len(uniq) * n_lang * 4 > MODEL_BYTES:
        total = np.bincount(inv, count)
        keep = total[inv] > np.partition(total, len(total) // 4)[len(total) // 4]
        if not keep.any():
            break
        lang, gram, count = lang[keep], gram[keep], count[keep]
        uniq, inv = np.unique(gram, axis=0, return_inverse=True)
        inv = inv.ravel()
    table = np.zeros((len(uniq), n_lang))
    np.add.at(table, (inv, lang), count)
    tables = {ORDER: (uniq, table)}
    for order in range(ORDER - 1, 0, -1):
        upper, t = tables[order + 1]
        grams, place = np.unique(upper[:, 1:], axis=0, return_inverse=True)
        place = place.ravel()
        cont = np.zeros((len(grams), n_lang))
        np.add.at(cont, place, t > 0)
        tables[order] = (grams, cont)
    keys, logp, context, back = [], [], [], []
    below: tuple[np.ndarray, np.ndarray] | None = None
    unseen = None
    for order in range(1, ORDER + 1):
        grams, t = tables[order]
        ones, twos = (t == 1).sum(axis=0), (t == 2).sum(axis=0)
        d = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
        ctx, place = np.unique(grams[:, :-1], axis=0, return_inverse=True) if order > 1 else (np.zeros((1, 0)), np.zeros(len(grams), np.int64))
        place = place.ravel()
        mass, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
        np.add.at(mass, place, t)
        np.add.at(kinds, place, t > 0)
        rest = np.where(mass > 0, d * kinds / np.maximum(mass, 1), 1.0)
        if order == 1:
            lower = np.full((len(grams), n_lang), _UNIFORM)
            unseen = np.log(rest[0] * _UNIFORM).astype(np.float32)
        else:
            suffix = _hash(grams[:, 1:])
            lower = below[1][np.searchsorted(below[0], suffix)]
        p = np.where(mass[place] > 0, np.maximum(t - d, 0) / np.maximum(mass[place], 1), 0.0) + rest[place] * lower
        h = _hash(grams)
        order_ = np.argsort(h)
        below = (h[order_], p[order_])
        keys.append(np.append(h[order_], np.uint64(2**64 - 1)))
        logp.append(np.log(p[order_]).astype(np.float32))
        if order > 1:
            h = _hash(ctx)
            order_ = np.argsort(h)
            context.append(np.append(h[order_], np.uint64(2**64 - 1)))
            back.append(np.log(rest[order_]).astype(np.float32))
    return Model(langs, keys, logp, context, back, unseen, 1.0, np.full(n_lang, np.inf))


def _hash(grams: np.ndarray) -> np.ndarray:
    """As gram_keys, of rows of code points."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64) + np.uint64(1)
    return kernels.mix64(h)


def fit(labelled: DataFrame, sample_chars: int = 3_000_000, calibration_texts: int = 1500) -> Model | None:
    """A model from text and lang of labelled rows (doc_id chooses the sample); None where there is nothing to learn."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)).alias("u")
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample_chars / max(1, r["chars"])))) for r in sizes))
    few = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, calibration_texts * 5 / max(1, r["n"])))) for r in sizes))
    index = F.coalesce(*(F.when(F.col("lang") == x, F.lit(i)) for x, i in number.items()))
    # every fifth text calibrates, the others are counted
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))
    rows = rows.where(F.col("lang").isin(langs)).select("text", index.alias("l"), fold.alias("fold"), u, share.alias("share"), few.alias("few"))

    def count(batches):
        for whole in batches:
            for b in kernels.slices(whole, "text", 2 << 20):
                cp, first, _ = characters(b.column(0).to_pylist())
                if len(cp) < ORDER:
                    continue
                grams = np.stack([cp[k : len(cp) - ORDER + 1 + k] for k in range(ORDER)], axis=1).astype(np.int64)
                owner = np.searchsorted(first, np.arange(len(grams)), side="right") - 1
                lang = b.column(1).to_numpy()[owner].astype(np.int64)
                ok = grams[:, -1] != 0
                both, c = np.unique(np.column_stack([lang[ok], grams[ok]]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(both[:, k]) for k in range(ORDER + 1)), pa.array(c)], names=["l", *(f"c{k}" for k in range(ORDER)), "n"])

    cols = ["l", *(f"c{k}" for k in range(ORDER))]
    sampled = rows.where("fold <> 0 and u < share").select("text", "l")
    counts = sampled.mapInArrow(count, ", ".join(f"{c} long" for c in [*cols, "n"])).groupBy(*cols).agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    m = {c: counts[c].to_numpy() for c in [*cols, "n"]}
    model = train(langs, m["l"], np.stack([m[f"c{k}"] for k in range(ORDER)], axis=1), m["n"].astype(float))
    shared = spark.sparkContext.broadcast(model)

    def judge(batches):
        for whole in batches:
            for b in kernels.slices(whole, "text", 2 << 20):
                mean, length, alpha = shared.value.texts(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(length.astype(np.int64)), pa.array(alpha.astype(np.int64)), pa.array(list(mean), pa.list_(pa.float64()))], names=["l", "n", "alpha", "mean"])

    found = rows.where("fold = 0 and u < few").select("text", "l").mapInArrow(judge, "l int, n long, alpha long, mean array<double>").where("alpha > 0").toPandas()
    if len(found):
        # short texts decide what a score is worth: calibrate on their margins
        mean, n, true = np.stack(found["mean"]), found["n"].to_numpy(), found["l"].to_numpy()
        loss = {t: -np.log(np.maximum(posterior(mean, n, t)[np.arange(len(n)), true], 1e-12)).mean() for t in (1, 1.5, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)}
        model.temperature = min(loss, key=loss.get)
        own = -mean[np.arange(len(n)), true]
        model.limit = np.array([np.quantile(own[true == k], 1 - REJECT) + MARGIN if (true == k).any() else np.inf for k in range(len(langs))])
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected. Texts are read whole; nothing is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in kernels.slices(whole, "text", 2 << 20):
                if m is None:
                    lang, score, rejected = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
                else:
                    lang, score, rejected = m.decide(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(F.pmod(common.crc_of_id(), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def predict(docs: DataFrame, **options) -> DataFrame:
    """identify() with a model learnt from the documents whose crc32(doc_id as text) mod 4 is not 2."""
    learnt = docs.where(F.pmod(common.crc_of_id(), F.lit(4)) != 2).select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), fit(learnt, **options))

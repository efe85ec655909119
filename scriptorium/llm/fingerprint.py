"""Document fingerprints: a canonical exact digest, with byte comparison inside equal buckets.

A text is canonicalised (NFKC, case folding, NFKC again, white space runs to one space, ends trimmed) and its
digest is the 128-bit xxh3 hash. Texts whose digests meet share a bucket. The canonical bytes of a bucket's
members are compared with those of its first document; a member that differs gets its
SHA-256 as a suffix (the hash is 128 bits wide, so this is for adversaries). Equal canonical texts have equal
fingerprints, and equal fingerprints mean equal canonical texts. The likeness of two fingerprints is exact: 1.0 where they are equal, else 0.0.

Scale: digests are computed where the text is read. Only buckets of several documents are compared, against the
bucket's first document, which is joined by digest; hot buckets are pre-aggregated, so no task holds a bucket.

A null text counts as empty. Repeated rows get equal fingerprints. Rows with a null id are fingerprinted as
well. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def bucket_clashes(docs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(doc_id, suffix) of documents whose canonical bytes differ from their bucket's first document's.
    fingerprints has doc_id and fingerprint, one row per row of docs."""
    shared = fingerprints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = common.staged(shared.select("fingerprint", "first"), "buckets")
    if shared.isEmpty():
        return fingerprints.where("false").select("doc_id", F.lit("").alias("suffix"))
    ids = common.staged(fingerprints.join(shared, "fingerprint").select("doc_id").distinct(), "bucket-ids")

    def bytes_of(batches):
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                text = [canonical(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_hexdigest(t) for t in text]), pa.array(text, pa.binary())], names=["doc_id", "fingerprint", "bytes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").mapInArrow(bytes_of, "doc_id long, fingerprint string, bytes binary")
    first = texts.join(shared, (texts["fingerprint"] == shared["fingerprint"]) & (texts["doc_id"] == shared["first"])).select(texts["fingerprint"].alias("f"), F.col("bytes").alias("first_bytes")).dropDuplicates(["f"])
    differing = texts.join(first, F.col("fingerprint") == F.col("f")).where("bytes <> first_bytes")
    return differing.select("doc_id", F.concat(F.lit("-"), F.sha2("bytes", 256)).alias("suffix")).distinct()


def with_edited(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint, and for its edited text (the last floor(n_chars / 2) code
    points replaced by as many, or all, first ones of the next document by descending id) edited_sha256,
    edited_fingerprint, near_edited, near_next. Rows of one id follow each other by text; null ids come last.

    The texts are shuffled once, into ranges of ids of about equal bytes; the first document of each range goes to the range
    before as well, so every task sees the next document of its last one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(1, common.shuffle_width(spark))
    # ids alone are read here; the bounds are ranges - 1 numbers
    bounds = texts.select("doc_id").agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("q")).first()["q"] or []
    bounds = sorted(set(bounds))
    # range 0 holds the largest ids; null ids come after all others
    place = F.lit(len(bounds)) - F.size(F.filter(F.array(*(F.lit(b) for b in bounds)) if bounds else F.array().cast("array<bigint>"), lambda x: x < F.col("doc_id")))
    placed = texts.withColumn("r", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(place).cast("int"))
    tops = placed.groupBy("r").agg(F.max("doc_id").alias("i")).orderBy("r").collect()
    rank = {t["r"]: n for n, t in enumerate(tops)}
    total = len(tops)
    if not total:
        return spark.createDataFrame([], _SCHEMA_SQL)
    # the first document of range n is shown to range n - 1, that of range 0 to the last
    show = F.coalesce(*(F.when((F.col("r") == t["r"]) & F.col("doc_id").eqNullSafe(F.lit(t["i"]).cast("long")), F.lit((rank[t["r"]] - 1) % total)) for t in tops))
    number = F.coalesce(*(F.when(F.col("r") == k, F.lit(n)) for k, n in rank.items()))
    home = F.struct(number.alias("t"), F.lit(0).alias("guest"))
    guest = F.when(show.isNotNull(), F.struct(show.alias("t"), F.lit(1).alias("guest")))
    spread = placed.select("doc_id", "text", F.explode(F.filter(F.array(home, guest), lambda x: x.isNotNull())).alias("p")).select("p.t", "p.guest", "doc_id", "text")
    ordered = spread.repartition(total, "t").sortWithinPartitions("t", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def edit(batches):
        held: tuple | None = None  # the document waiting for its next one
        done = -1  # the range whose guest was met

        def finish(doc, nxt):
            i, text, fp = doc
            half = len(text) // 2
            edited = (text[: len(text) - half] + nxt[1][:half]) if half else text
            efp = digest(edited)
            return (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, efp, float(fp == efp), float(fp == nxt[2]))

        at = -1
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                out = []
                for t, g, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if t == done:
                        continue
                    if t != at:
                        at, held = t, None
                    doc = (i, text, digest(text))
                    if held is not None:
                        out.append(finish(held, doc))
                    held = doc
                    if g:
                        done, held = t, None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return ordered.mapInArrow(edit, _SCHEMA_SQL)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_SCHEMA_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """with_edited(), fingerprints of clashing buckets set apart by byte comparison."""
    found = common.staged(with_edited(docs), "fingerprints")
    clashes = common.staged(bucket_clashes(docs, found.select("doc_id", "fingerprint")), "clashes")
    if clashes.isEmpty():
        return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    out = found.join(clashes, "doc_id", "left").withColumn("fingerprint", F.concat("fingerprint", F.coalesce("suffix", F.lit(""))))
    near = (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), "near_next")

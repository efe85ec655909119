"""Streams of open-buffer events: the latest text of each key, its validation as it changes, and changes of polled values.

Events have key, version, event (open, change, save, close) and text. Per micro-batch only a key's last
event counts, so a burst of changes is validated once; closing a key clears its results. The batch form, latest(), gives the
same rows as the stream over all events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(events: DataFrame) -> DataFrame:
    """The last event of each key by version: key, version, event, text. One partial aggregation."""
    last = F.max_by(F.struct("version", "event", "text"), "version")
    return events.groupBy("key").agg(last.alias("e")).select("key", "e.*")


def validate_stream(events: DataFrame, check: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, DataFrame], None], **options: Any):
    """A started query: each micro-batch is reduced to the last event a key, checked as a batch is, and handed to publish(issues, keys),
    keys being all that changed (those without issues are clean or closed)."""

    def step(batch: DataFrame, _: int) -> None:
        now = latest(batch).persist()
        try:
            publish(check(now.where("event <> 'close'")), now.select("key", (F.col("event") == "close").alias("closed")))
        finally:
            now.unpersist()

    writer = events.writeStream.foreachBatch(step)
    for k, v in options.items():
        writer = writer.trigger(**v) if k == "trigger" else writer.option(k, v)
    return writer.start()


def debounced(events: DataFrame, quiet_ms: int = 250) -> DataFrame:
    """One row per key when no change came for quiet_ms of processing time; open and save pass at once, close emits an empty text
    and clears the key's state. Output: key, version, event, text."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = None
        if state.hasTimedOut:
            out = state.get
            state.remove()
        else:
            best = tuple(state.get) if state.exists else None
            for f in frames:
                for v, e, t in zip(f["version"], f["event"], f["text"], strict=True):
                    if best is None or v >= best[0]:
                        best = (int(v), e, t)
            if best[1] == "change":
                state.update(best)
                state.setTimeoutDuration(quiet_ms)
            else:
                out = best if best[1] != "close" else (best[0], "close", "")
                if state.exists:
                    state.remove()
        if out is not None:
            yield pd.DataFrame({"key": [key[0]], "version": [out[0]], "event": [out[1]], "text": [out[2]]})

    kind = "version long, event string, text string"
    return events.groupBy("key").applyInPandasWithState(run, f"key string, {kind}", kind, "append", GroupStateTimeout.ProcessingTimeTimeout)


def changes(seen: DataFrame) -> DataFrame:
    """Of a polled stream (key, value), a row whenever a key's value differs from the last one seen; the first sighting is silent.
    Output: key, old, value."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for f in frames:
            for v in f["value"]:
                if last is not None and v != last:
                    rows.append((key[0], last, v))
                last = v
        state.update((last,))
        yield pd.DataFrame(rows, columns=["key", "old", "value"])

    return seen.groupBy("key").applyInPandasWithState(run, "key string, old string, value string", "value string", "append", GroupStateTimeout.NoTimeout)


def upsert_index(index_path: str, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that keeps an index of documents in Parquet, partitioned by batch: each batch appends the new state of the keys it changed;
    current_index() shows the newest state of each key. Writing a batch again replaces it, so retries do no harm."""

    def step(batch: DataFrame, number: int) -> None:
        now = latest(batch)
        parse(now).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return step


def current_index(rows: DataFrame) -> DataFrame:
    """The newest row of each key over all batches; closed keys are gone."""
    columns = [c for c in rows.columns if c not in ("batch", "key")]
    newest = rows.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("batch", "version")).alias("e"))
    return newest.select("key", "e.*").where("event <> 'close'")

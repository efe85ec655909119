"""The one way from columns into Python: Arrow batches in, rows out, Arrow batches back."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

VALUE = pa.struct([("t", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("a", pa.list_(pa.string()))])
VALUES = pa.map_(pa.string(), VALUE)
ISSUE = pa.struct([("level", pa.string()), ("field", pa.string()), ("message", pa.string()), ("error_type", pa.string()), ("fix", pa.string()), ("body_line", pa.int32())])
ROWS = 1000  # input rows whose output is held at once


def _array(column: Iterable, kind: pa.DataType) -> pa.Array:
    """A column of Arrow; maps of value structs come as dicts, and are put together from their parts, which takes a fraction of the time."""
    if kind != VALUES:
        return pa.array(list(column), kind)
    keys, values, ends = [], [], [0]
    for d in column:
        keys += d
        values += d.values()
        ends.append(len(keys))
    parts = [pa.array([v and v[f.name] for v in values], f.type) for f in VALUE]
    structs = pa.StructArray.from_arrays(parts, fields=list(VALUE), mask=pa.array([v is None for v in values], pa.bool_()))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), structs)


def crossed(df: DataFrame, columns: list[str | Column], each: Callable[..., Iterable[tuple]], schema: pa.Schema, sql: str) -> DataFrame:
    """For each row of the columns the rows that each() gives. Nothing is shuffled, and at most ROWS rows' output is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                gc.disable()  # what is held is walked through again and again otherwise
                try:
                    rows = [r for x in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in each(*x)]
                finally:
                    gc.enable()
                made = zip(*rows, strict=True) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return df.select(*columns).mapInArrow(run, sql)


def tasks_for(df: DataFrame, bytes_a_task: int = 16 << 20) -> int:
    """How many tasks Python work on df should have: by its estimated size, at least two a core. Estimates of joins without statistics
    can be far too large, so the shuffle width bounds them."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = 2 * spark.sparkContext.defaultParallelism
    return max(least, min(max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))), math.ceil(size / bytes_a_task)))

"""Dynamically typed values as one Spark struct, so that rules over front matter compile to plain columns.

A value has its type tag ``t`` (string, number, boolean, date, array, object), its text ``s`` as a template
string would show it, its number ``n`` (numbers; dates as milliseconds since the epoch) and, for arrays, the texts ``a``
of its items. A missing or null value is a null struct. The same struct is built from the typed columns of any table
(from_column) and by the front-matter parser, so every rule runs on both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_SQL = "struct<t:string,s:string,n:double,a:array<string>>"


def number_text(n: Column) -> Column:
    """A number as text: whole numbers without a fraction."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(whole, F.format_string("%.0f", n)).otherwise(n.cast("string"))


def from_column(c: Column, kind: T.DataType) -> Column:
    """The value struct of a typed column; unlike null, an empty string is a value."""
    null_array = F.lit(None).cast("array<string>")
    none = F.lit(None).cast("double")
    if isinstance(kind, T.StringType):
        out = F.struct(F.lit("string").alias("t"), c.alias("s"), none.alias("n"), null_array.alias("a"))
    elif isinstance(kind, T.BooleanType):
        out = F.struct(F.lit("boolean").alias("t"), c.cast("string").alias("s"), none.alias("n"), null_array.alias("a"))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        at = c.cast("timestamp")
        out = F.struct(F.lit("date").alias("t"), F.date_format(at, "yyyy-MM-dd").alias("s"), F.unix_millis(at).cast("double").alias("n"), null_array.alias("a"))
    elif isinstance(kind, T.NumericType):
        n = c.cast("double")
        out = F.struct(F.lit("number").alias("t"), number_text(n).alias("s"), n.alias("n"), null_array.alias("a"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: x.cast("string"))
        out = F.struct(F.lit("array").alias("t"), F.array_join(items, ",").alias("s"), none.alias("n"), items.alias("a"))
    else:
        out = F.struct(F.lit("object").alias("t"), F.to_json(c).alias("s"), none.alias("n"), null_array.alias("a"))
    return F.when(c.isNotNull(), out)


class Fields:
    """Where a rule finds the value of a field: typed columns of a table, or a map column of value structs.

    In a map column nested keys are stored under their dotted path next to the top-level keys."""

    def __init__(self, columns: dict[str, T.DataType] | None = None, map_column: str | None = None, synthetic: dict[str, str] | None = None):
        self.columns, self.map_column = columns or {}, map_column
        self.synthetic = synthetic or {}

    @classmethod
    def of_table(cls, df, **options):
        return cls({f.name: f.dataType for f in df.schema.fields}, **options)

    def value(self, name: str) -> Column:
        if name.startswith("$"):
            column = self.synthetic.get(name)
            return from_column(F.col(column), T.StringType()) if column else F.lit(None).cast(VALUE_SQL)
        if self.map_column:
            return F.try_element_at(F.col(self.map_column), F.lit(name))
        if name in self.columns:
            return from_column(F.col(f"`{name}`"), self.columns[name])
        return F.lit(None).cast(VALUE_SQL)

    def keys(self) -> Column:
        """Top-level keys that hold something."""
        if self.map_column:
            return F.filter(F.map_keys(F.col(self.map_column)), lambda k: ~k.contains("."))
        return F.filter(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in self.columns)), lambda k: k.isNotNull())

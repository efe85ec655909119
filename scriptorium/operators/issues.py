"""Issues: one struct per violation, and how an array of optional issues becomes rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE_SQL = "struct<level:string,field:string,message:string,error_type:string,fix:string,body_line:int>"


def issue(level: str, field: Column | str, message: Column | str, error_type: str | None = None, fix: Column | str | None = None, body_line: Column | None = None) -> Column:
    def text(x):
        return F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x

    line = F.lit(None).cast("int") if body_line is None else body_line.cast("int")
    return F.struct(F.lit(level).alias("level"), text(field).alias("field"), text(message).alias("message"), text(error_type).alias("error_type"), text(fix).alias("fix"), line.alias("body_line")).cast(ISSUE_SQL)


def gathered(found: list[Column], lists: list[Column] | None = None) -> Column:
    """Array of the issues that are not null, in order; then those of the given arrays."""
    one = F.filter(F.array(*found) if found else F.array().cast(f"array<{ISSUE_SQL}>"), lambda x: x.isNotNull())
    return F.concat(one, *(F.coalesce(x, F.array().cast(f"array<{ISSUE_SQL}>")) for x in lists)) if lists else one


def exploded(df: DataFrame, keys: list[str], issues: Column) -> DataFrame:
    """One row per issue: the keys, seq (its place), and the issue's columns. One scan, no shuffle."""
    rows = df.select(*keys, F.posexplode(issues).alias("seq", "i"))
    return rows.select(*keys, "seq", "i.*")

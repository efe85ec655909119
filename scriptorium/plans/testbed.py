"""Markdown rendered from relational rows by columns alone, so that what documents should yield can be computed from the rows.

Each order becomes a document: front matter from its columns, a level-1 title, a Summary, an Items table of its line items, a Parts
list, a code fence, and for finished orders an Outcome section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import crossing

TEMPLATE_PATH = "templates/order-template.md"
TEMPLATE = """---
title: Order template
fields:
  title:
    required: true
    type: string
  template:
    required: true
    type: string
  status:
    required: true
    type: string
    enum: [open, done, partial]
  total:
    type: number
    min: 50000
  placed:
    type: date
    after: "1995-06-01"
  priority:
    pattern: ^[1-3]-
  reviewer:
    required:
      when: status in ["done"]
      severity: warning
strict: true
sections: [summary, items, parts]
---
# Order

## Summary

```yaml section-rules
required: true
code:
  lang: json
  min: 1
```

## Items

```yaml section-rules
required: true
formula: total >= 40000
table:
  columns:
    - name: Line
      values: {type: integer, unique: true}
    - name: Quantity
      values: {type: number, max: 49}
    - name: Flag
      values: {enum: [A, N]}
  rows: {min: 2, max: 6}
  strict: true
```

## Parts

```yaml section-rules
list:
  min: 1
  unique: true
  items: {pattern: "^part [0-9]+$"}
```

## Outcome

```yaml section-rules
required:
  when: status in ["done", "partial"]
```
"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of one document per order. Orders without items have no table and no list.

    Both tables are laid out by order once, in as many tasks as the parsing that follows needs (Spark would else broadcast the one and keep
    the single file of the other as a single task); grouping and join then shuffle no more. Lists gain nothing from partial aggregation."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    whole = (F.col("l_quantity") > 0) & (F.col("l_quantity") < 1e15) & (F.col("l_quantity") == F.floor("l_quantity"))  # these need no formatter, which is slow
    quantity = F.when(whole, F.col("l_quantity").cast("long").cast("string")).otherwise(F.format_string("%.0f", "l_quantity"))
    line = lambda x: F.concat(F.lit("| "), shown(x["l_linenumber"]), F.lit(" | "), x["quantity"], F.lit(" | "), shown(x["l_returnflag"]), F.lit(" |"))
    part = lambda x: F.concat(F.lit("- part "), shown(x["l_suppkey"] % 10))
    found = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", quantity.alias("quantity"))))
    tasks = crossing.tasks_for(items)
    per = items.repartition(tasks, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(found.alias("items"))
    per = per.select("o_orderkey", F.array_join(F.transform("items", line), "\n").alias("rows"), F.array_join(F.transform("items", part), "\n").alias("parts"))
    joined = orders.repartition(tasks, "o_orderkey").join(per.hint("shuffle_merge"), "o_orderkey", "left")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("partial")
    reviewer = F.when(F.col("o_custkey") % 3 != 0, F.format_string("reviewer: person-%d\n", "o_custkey")).otherwise("")
    extra = F.when(F.col("o_orderkey") % 7 == 0, F.lit("region: north\n")).otherwise("")
    front = F.concat(
        F.lit("---\ntitle: Order "), F.col("o_orderkey"), F.lit(f"\ntemplate: {TEMPLATE_PATH}\nstatus: "), status, F.lit("\ntotal: "), F.format_string("%.2f", "o_totalprice"),
        F.lit("\nplaced: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\npriority: "), F.col("o_orderpriority"), F.lit("\n"), reviewer, extra, F.lit("---\n"),
    )
    summary = F.concat(F.lit("# Order\n\n## Summary\n\nFor [customer](../customers/customer-"), F.col("o_custkey"), F.lit(".md).\n\n```json\n# {}\n```\n"))
    table = F.when(F.col("rows").isNotNull(), F.concat(F.lit("\n## Items\n\n| Line | Quantity | Flag |\n|---|---|---|\n"), F.col("rows"), F.lit("\n\n## Parts\n\n"), F.col("parts"), F.lit("\n"))).otherwise("")
    outcome = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 != 0), F.lit("\nOutcome\n-------\n\nDelivered.\n")).otherwise("")
    path = F.format_string("docs/orders/order-%d.md", "o_orderkey")
    return joined.select(path.alias("path"), F.concat(front, summary, table, outcome).alias("text"))

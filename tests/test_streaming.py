from pyspark.sql import functions as F

from scriptorium.streaming import buffers

EVENTS = "key string, version long, event string, text string"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "open", "x"), ("a", 2, "change", "y"), ("b", 1, "open", "z"), ("b", 2, "close", ""), ("a", 3, "save", "w")]
    events = spark.createDataFrame(rows, EVENTS)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []

    def publish(issues, keys):
        seen.extend((r["key"], r["closed"]) for r in keys.collect())
        seen.extend(("issue", r["key"], r["text"]) for r in issues.collect())

    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = buffers.validate_stream(stream, lambda docs: docs.select("key", "text"), publish, trigger={"availableNow": True}, checkpointLocation=str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen, key=str) == sorted([("a", False), ("b", True), ("issue", "a", "w")], key=str)
    assert {(r["key"], r["text"]) for r in buffers.latest(events).collect()} == {("a", "w"), ("b", "")}


def test_index_upsert(spark, tmp_path):
    step = buffers.upsert_index(str(tmp_path / "ix"), lambda d: d.withColumn("size", F.length("text")))
    step(spark.createDataFrame([("a", 1, "open", "x"), ("b", 1, "open", "yy")], EVENTS), 0)
    step(spark.createDataFrame([("a", 2, "save", "xxx"), ("b", 2, "close", "")], EVENTS), 1)
    step(spark.createDataFrame([("a", 2, "save", "xxx"), ("b", 2, "close", "")], EVENTS), 1)
    now = buffers.current_index(spark.read.parquet(str(tmp_path / "ix")))
    assert [(r["key"], r["size"]) for r in now.collect()] == [("a", 3)]


def test_polled_changes(spark, tmp_path):
    kind = "key string, value string"
    for i, rows in enumerate([[("main", "1"), ("dev", "7")], [("main", "1"), ("dev", "8")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = buffers.changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        del i
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("dev", "7", "8")]

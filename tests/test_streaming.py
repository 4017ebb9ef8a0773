from loomgraph.operators import quads as Q
from loomgraph.streaming import ingest
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(5).write.parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest(spark, f"file://{tmp_path}/in", events.schema, lambda b, k: b.write.mode("append").parquet(out), f"file://{tmp_path}/cp", files_per_trigger=2)
        q.awaitTermination(120)
    got = {tuple(r) for r in ingest.totals(spark.read.parquet(out)).collect()}
    assert got == {tuple(r) for r in ingest.totals(events).collect()}


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = ingest.windowed(events).agg(F.sum("n")).first()[0]
    assert got == events.count()


def test_quads_schema(spark):
    assert spark.createDataFrame([], Q.SCHEMA).columns == Q.KEY

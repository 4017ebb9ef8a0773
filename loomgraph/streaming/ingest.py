"""Streaming: articles and events as they arrive.

Articles go to the quad table, each batch as one commit that names the stream and the batch: what a stream that
was killed repeats is not applied again, so every quad is there once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.api import BODY, Engine
from loomgraph.operators import quads as Q
from loomgraph.operators.stored import stored


def totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window and type; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def ingest(spark: SparkSession, folder: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """New files of a folder go through sink(batch, id) once each; the checkpoint remembers which."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(batch: DataFrame, table: Q.QuadTable, repo: str, name: str, number: int, late: str, width: str) -> DataFrame:
    """Quads of a batch's articles by window of their time of publication: how many, and how many were late, that is more
    than `late` before the latest of the batches before. Articles without a valid time are in no window."""
    graph = f"{repo}_arrivals"
    told = table.read(repo, [graph]).filter((F.col("p") == ":latest") & F.startswith("s", F.lit(f":Arrivals_{name}_")))
    latest = told.agg(F.max(F.col("o").try_cast("timestamp_ntz"))).first()[0]
    at = batch.select(F.col("published").try_cast("timestamp_ntz").alias("at")).filter("at is not null")
    behind = F.lit(False) if latest is None else F.col("at") < F.lit(latest) - F.expr(f"interval {late}")
    got = at.groupBy(F.window("at", width)["start"].alias("begins")).agg(F.count("*").alias("articles"), F.count(F.when(behind, 1)).alias("late"), F.max("at").alias("latest"))
    s = F.concat(F.lit(f":Arrivals_{name}_{number}_"), F.date_format("begins", "yyyyMMddHHmmss"))
    time = lambda c: (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "xsd:dateTime")
    return Q.triplify(got, s, F.lit(repo), F.lit(graph), **{":begins": time("begins"), ":articles": (F.col("articles"), "xsd:integer"), ":late": (F.col("late"), "xsd:integer"), ":latest": time("latest")})


def arrived(table: Q.QuadTable, repo: str) -> DataFrame:
    """begins, articles, late of each window, over all streams and batches."""
    s = Q.star(table.read(repo, [f"{repo}_arrivals"]), begins=":begins", articles=":articles", late=":late")
    return s.groupBy(F.col("begins").try_cast("timestamp_ntz").alias("begins")).agg(F.sum(F.col("articles").cast("long")).alias("articles"), F.sum(F.col("late").cast("long")).alias("late"))


def articles(engine: Engine, repo: str, folder: str, checkpoint: str, name: str = "articles", late: str = "1 day", width: str = "1 hour", files_per_trigger: int = 100) -> StreamingQuery:
    """New JSON files of a folder, narratives with title, source, text, published and url, to graphs of a repository.

    Each batch is one commit, exactly once: quads, names that its narratives define, and its arrivals by window. Late
    articles are ingested like others. name: of the stream; one checkpoint, one name."""
    rows = engine.spark.readStream.schema(", ".join(f"{c} string" for c in BODY)).option("maxFilesPerTrigger", files_per_trigger).json(folder)

    def sink(batch: DataFrame, number: int) -> None:
        if engine.store.state(repo).streams.get(name, -1) >= number:  # committed before the stream was killed
            return
        batch = stored(batch)
        more = arrivals(batch, engine.store, repo, name, number, late, width)
        engine.ingest_narratives(repo, batch, more, (name, number))

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""What the operators share: the folder all executors see, tables written there, and word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.stored import spread

#: A word, and what stands between words, in the Java and Python dialects alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see, in one of the application's
    own: what an application wrote can be deleted in one go once its results are read.

    Only where that setting is absent (a local session) is a temporary folder used."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/loomgraph/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """The name, with marks behind it as long as df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound the bytes of one Arrow batch, so that rows of very long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def n_words(text: Column) -> Column:
    """Number of words as a long, 0 for null; needs no array of the words."""
    marks = F.regexp_replace(F.regexp_replace(text, WORD, "x"), GAP, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one of documents in as many parts as there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" else df

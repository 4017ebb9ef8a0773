"""Tables between the steps of a computation: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir, which the driver and all executors see.

    Only where that setting is absent, in a local session, is a temporary folder used."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/loomgraph/{sc.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back with its schema."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """stored() and the number of its rows, which Parquet's footers know."""
    got = stored(df)
    return got, got.count()


def large(df: DataFrame) -> DataFrame:
    """df as a side that grows with the input: joined by sorting both, never collected for a broadcast.

    Spark judges a side by its compressed bytes, and names that are alike take ten times as many on the driver."""
    return df.hint("merge")


#: Bytes of a table up to which it is dealt out before rows that take long are worked on.
SMALL = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table in as many parts as there are cores: a file of one row group would be read and worked on by one
    task. Tables of more files or bytes stay as they are, so nothing large moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(cores, key)

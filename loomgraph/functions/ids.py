"""Deterministic identifiers, so that the same input gives the same graph."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_id(*parts: Column, length: int = 13) -> Column:
    return F.left(F.sha2(F.concat_ws("\u0001", *parts), 256), F.lit(length))

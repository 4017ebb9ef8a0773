"""Which texts contain which others, as equi-joins on short substrings instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.stored import large

#: Characters of the substring that the join compares first.
GRAM = 5


def grams(text: Column, width: int = GRAM) -> Column:
    """All distinct substrings of one to `width` characters."""
    return F.array_distinct(F.flatten(F.array(*[_of_length(text, k) for k in range(1, width + 1)])))


def _of_length(text: Column, k: int) -> Column:
    n = F.length(text)
    of = F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substring(text, at, F.lit(k)))
    return F.when(n >= k, of).otherwise(F.array().cast("array<string>"))


def containing(parts: DataFrame, part: str, wholes: DataFrame, whole: str, width: int = GRAM) -> DataFrame:
    """Columns of parts and of wholes for each pair where the text `whole` contains the text `part`.

    A part is looked up by that of its substrings of `width` characters (a shorter part: by itself) which the fewest
    wholes have, so parts that begin alike don't meet all wholes that do; one that no whole has ends the search.
    What is found is verified. Null and empty parts are in nothing."""
    p = parts.select(F.col(part).alias("the part")).filter(F.length("the part") > 0).distinct()
    w = wholes.select(F.col(whole).alias("the whole")).filter(F.length("the whole") > 0).distinct()
    mine = F.when(F.length("the part") < width, F.array("the part")).otherwise(F.array_distinct(_of_length(F.col("the part"), width)))
    p = p.select("the part", F.explode(mine).alias("gram"))
    short = {r[0] for r in p.filter(F.length("the part") < width).select(F.length("the part")).distinct().collect()}  # under width many
    w = w.select("the whole", F.explode(F.array_distinct(F.flatten(F.array(*[_of_length(F.col("the whole"), k) for k in sorted({width, *short})])))).alias("gram"))
    w = w.join(large(p.select("gram").distinct()), "gram", "left_semi")
    common = w.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = p.join(large(common), "gram", "left").groupBy("the part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("by"))
    rarest = rarest.filter("by.n > 0").select("the part", "by.gram")
    pairs = rarest.join(large(w), "gram").filter(F.contains("the whole", F.col("the part"))).drop("gram")
    got = parts.join(large(pairs), F.col(part) == F.col("the part"))
    return got.join(large(wholes), F.col(whole) == F.col("the whole")).drop("the part", "the whole")

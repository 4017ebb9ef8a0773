"""Documents to packed sequences: toxicity, near-duplicates, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written as Parquet
before the next one reads it. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import minhash, mixing, packing, pseudonyms, toxicity
from loomgraph.llm._common import n_words, shared_dir, table, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, by a model fitted on the labels of sf_dir."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    score, toxic = unused(docs, "score"), unused(docs, "toxic")
    return toxicity.scored(docs, model, keep=docs.columns, out=(score, toxic)).filter(F.col(toxic) == 0).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-copies: sets of five-word
    shingles of a Jaccard similarity of 0.8 or more, each link verified on the whole texts. SimHash fingerprints
    within op4's bits propose links, MinHash bands those beyond them.

    A doc_id that several rows have stays once. Rows without a doc_id are not compared and stay."""
    kept, rows = unused(docs, "kept"), unused(docs, "rows")
    groups = minhash.copy_groups(docs)
    named = written(groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(kept)).agg(F.count("*").alias(rows)), "kept")
    got = docs.join(named.hint("merge"), F.col("doc_id") == F.col(kept))  # ids grow with the input
    if not named.filter(F.col(rows) > 1).isEmpty():
        got = got.filter(F.col(rows) == 1).unionByName(got.filter(F.col(rows) > 1).dropDuplicates(["doc_id"]))
    return got.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as pseudonyms by the session's key; n_chars follows the text."""
    got = pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark), out=unused(docs, "found"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, so a source's last document stays if at least
    half of it is inside of the target. Documents without words are in no mix.

    Rows that share a doc_id are taken equally often."""
    mixed, passes = unused(docs, "mixed"), unused(docs, "passes")
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = mixing.mix(sizes).filter(2 * F.col("taken") >= F.col("size"))
    rows = sizes.groupBy("doc_id").agg(F.count("*").alias("rows"))
    times = taken.groupBy(F.col("doc_id").alias(mixed)).agg(F.count("*").alias("n")).join(rows, F.col(mixed).eqNullSafe(F.col("doc_id")))
    times = times.select(mixed, F.ceil(F.col("n") / F.col("rows")).cast("int").alias(passes))
    got = docs.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col(mixed)))
    return got.withColumn(unused(got, "pass"), F.explode(F.sequence(F.lit(1), F.col(passes)))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of the mix."""
    return packing.packed(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pseudonyms", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the trained model; tests hold run() against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

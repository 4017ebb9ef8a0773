"""Article files, request bodies, gazetteers and lexicons."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.vocab import BACKGROUND_NER

ARTICLE_FIELDS = ["Title", "Source", "Published", "URL"]
BACKGROUND_SCHEMA = "backgroundNames array<struct<name: string, type: string, alsoKnownAs: array<string>, isCollection: boolean>>"
NARRATIVE_SCHEMA = "title string, source string, text string, published string, url string"
NOT_DEFINED = "not defined"


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Files of a header in any order and a text: path, title, source, published, url, text.

    Files without a header are all text; absent fields are null."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    cols = [F.when(F.col("v").rlike(f"(?m)^{f}: "), F.trim(F.regexp_extract("v", f"(?m)^{f}: ([^\\n]*)", 1))).alias(f.lower()) for f in ARTICLE_FIELDS]
    text = F.when(F.col("v").rlike("(?m)^Text: "), F.regexp_extract("v", r"(?s)(?:^|\n)Text: (.*)$", 1)).otherwise(F.col("v"))
    return raw.select("path", *cols, text.alias("text"))


def narratives(spark: SparkSession, path: str) -> DataFrame:
    """JSON bodies; title, source and text are required: rows without them carry an error."""
    n = spark.read.schema(NARRATIVE_SCHEMA).json(path)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in ("title", "source", "text")])
    filled = n.select("title", "source", "text", *[F.coalesce(c, F.lit(NOT_DEFINED)).alias(c) for c in ("published", "url")])
    return filled.withColumn("error", F.when(missing != "", F.concat(F.lit("missing "), missing)))


def background(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped) background names; accepted have their NER type, plural for collections."""
    b = spark.read.schema(BACKGROUND_SCHEMA).json(path).select(F.explode("backgroundNames").alias("b")).select("b.*")
    return background_names(b)


def background_names(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    kinds = F.create_map(*[F.lit(x) for kv in BACKGROUND_NER.items() for x in kv])
    b = b.withColumn("ner", F.try_element_at(kinds, F.lower("type")))
    plural = F.when(F.coalesce("isCollection", F.lit(False)), "PLURAL").otherwise("")
    more = [c for c in b.columns if c not in ("name", "type", "alsoKnownAs", "isCollection", "ner")]
    ok = b.filter("ner is not null").select("name", "type", F.coalesce("alsoKnownAs", F.array().cast("array<string>")).alias("also"), F.concat(plural, "ner").alias("ner"), *more)
    return ok, b.filter("ner is null").select("name", "type", *more)


def names(spark: SparkSession, path: str) -> DataFrame:
    """A newline list as (name)."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")


def country_info(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated country rows with # comments; rows of fewer than 17 columns are left out."""
    r = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 17)
    return r.select(*[F.col("c")[k].alias(n) for k, n in ((0, "iso_alpha2"), (1, "iso_alpha3"), (4, "label"), (8, "continent"), (10, "currency"), (16, "geo_id"))], F.try_element_at("c", F.lit(18)).alias("neighbours"))


def country_names(labels: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, geo_id) of labels and synonyms; a name of several countries keeps the least id."""
    return labels.select(F.col("label").alias("name"), "geo_id").unionByName(synonyms.select(F.col("synonym").alias("name"), "geo_id")).groupBy("name").agg(F.min("geo_id").alias("geo_id"))


def adjacency(info: DataFrame) -> DataFrame:
    """Unordered neighbour pairs of country_info()."""
    n = info.select("iso_alpha2", F.explode(F.split("neighbours", ",")).alias("n")).filter("n <> ''")
    return n.select(F.least("iso_alpha2", "n").alias("geo_a"), F.greatest("iso_alpha2", "n").alias("geo_b")).distinct()


def synsets(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon data lines: offset, words of lexical id 0, hypernym offsets ('@', not '@i')."""
    r = spark.read.text(path).filter(~F.col("value").startswith("  ")).select(F.split("value", " ").alias("t"), "value")
    n = F.conv(F.col("t")[3], 16, 10).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.struct(F.get("t", 4 + 2 * k).alias("w"), F.get("t", 5 + 2 * k).alias("id")))
    words = F.transform(F.filter(pairs, lambda p: p["id"] == "0"), lambda p: F.replace(p["w"], F.lit("_"), F.lit(" ")))
    return r.select(F.col("t")[0].alias("synset"), words.alias("words"), F.regexp_extract_all("value", F.lit(r" @ (\d{8})"), F.lit(1)).alias("hypernyms"))


def verb_classes(spark: SparkSession, path: str) -> DataFrame:
    """Verb class XML files: (class, member) of classes and of their subclasses at any depth."""

    def of(batches):
        for b in batches:
            rows, open_ = [], [ElementTree.fromstring(v) for v in b["value"]]
            while open_:
                c = open_.pop()
                rows += [(c.get("ID"), m.get("name")) for m in c.findall("MEMBERS/MEMBER")]
                open_ += c.findall("SUBCLASSES/VNSUBCLASS")
            yield pd.DataFrame(rows, columns=["class", "member"])

    return spark.read.text(path, wholetext=True).mapInPandas(of, "class string, member string").distinct()


NEWS = "articles array<struct<title: string, url: string, content: string, publishedAt: string, source: struct<name: string>>>"
CONSENT = "https://consent.google.com/ml?continue="


def news(spark: SparkSession, path: str) -> DataFrame:
    """News API replies, all pages of them: title, published, source, url, content of articles that are whole,
    without the marker of removed ones; addresses without the consent page before them."""
    a = spark.read.schema(NEWS).json(path, multiLine=True).select(F.explode("articles").alias("a")).select("a.*")
    whole = a.filter((F.col("title") != "[Removed]") & F.contains("content", F.lit(" [+")))
    return whole.select("title", F.col("publishedAt").alias("published"), F.col("source.name").alias("source"), F.replace("url", F.lit(CONSENT), F.lit("")).alias("url"), "content")


NYT = "response struct<meta: struct<hits: int>, docs: array<struct<headline: struct<main: string>, pub_date: string, web_url: string>>>"


def nyt(spark: SparkSession, path: str) -> DataFrame:
    """New York Times search replies, ten articles each: title, published, source, url."""
    d = spark.read.schema(NYT).json(path, multiLine=True).filter("response.meta.hits > 0").select(F.explode("response.docs").alias("d"))
    return d.select(F.col("d.headline.main").alias("title"), F.col("d.pub_date").alias("published"), F.lit("New York Times").alias("source"), F.col("d.web_url").alias("url"))


def nyt_date(date: F.Column) -> F.Column:
    """yyyy-mm-dd as that search takes it."""
    return F.replace(date, F.lit("-"), F.lit(""))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Turtle files of classes with :noun_synonym and :verb_synonym: term, kind (label, noun, verb), class."""
    from loomgraph.sources import turtle

    kinds = F.create_map(*[F.lit(x) for kv in (("rdfs:label", "label"), (":noun_synonym", "noun"), (":verb_synonym", "verb")) for x in kv])
    q = turtle.read(spark, path, "synonyms")
    return q.withColumn("kind", F.try_element_at(kinds, F.col("p"))).filter("kind is not null").select(F.col("o").alias("term"), "kind", F.col("s").alias("class"), "o_lang")


def lookups(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(term) against synonyms(): term, kind, class; terms that no class has are left out."""
    return terms.select("term").distinct().join(known.select("term", "kind", "class").distinct(), "term")


def clean_labels(labels: DataFrame) -> DataFrame:
    """(label, lang) in English that are fit as names: plain ASCII, over 3 characters, without ' of ', ' in ',
    ' people' and ' culture'."""
    keep = (F.col("lang") == "en") & (F.length("label") > 3) & ~F.col("label").rlike("[^\\x00-\\x7F]")
    for part in (" of ", " in ", " people", " culture"):
        keep = keep & ~F.contains("label", F.lit(part))
    return labels.filter(keep)


def phrases(terms: DataFrame) -> DataFrame:
    """(term) of several words: more than one blank, a lower-case start, no bracket."""
    blanks = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit("")))
    return terms.filter((blanks > 1) & F.col("term").rlike(r"^\p{Ll}") & ~F.contains("term", F.lit("(")))


def without_part(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column doesn't contain the part; nulls go, as in a filter of a graph query."""
    return rows.filter(~F.contains(column, F.lit(part)))


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema all columns are strings, so that nothing is read twice."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def dumped(graph: DataFrame, details: DataFrame, path: str) -> None:
    """A narrative's graph as Turtle and its details as JSON, side by side."""
    from loomgraph.sources import turtle

    turtle.write(graph, f"{path}/graph")
    details.coalesce(1).write.mode("overwrite").json(f"{path}/details")


def saved(rows: DataFrame, path: str) -> DataFrame:
    """A dictionary kept as Parquet, and read back from there."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON strings, for a response."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))

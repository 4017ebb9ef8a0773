"""Articles from news sites: which addresses are read, text out of their pages, duplicate titles, searches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.vocab import EXCLUDED_URL_PARTS, SITE_RULES
from loomgraph.operators import html as H

#: An article's text has more characters than this.
LEAST_TEXT = 500
INTERIM = "https://news.google.com/"


def _any_part(url: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(url, F.lit(part))
    return out


def excluded(url: Column, sites=tuple(SITE_RULES)) -> Column:
    """Video and live pages, which hold little text, and sites without a rule. sites=None: only the former."""
    out = _any_part(url, EXCLUDED_URL_PARTS)
    return out if sites is None else out | ~_any_part(url, sites)


def site_rules(spark: SparkSession, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """(ordinal from 1, url_key, rule) in the order in which they are tried."""
    rules = SITE_RULES if rules is None else rules
    return spark.createDataFrame([(n, k, r) for n, (k, r) in enumerate(rules.items(), 1)], "ordinal int, url_key string, rule array<string>")


def first_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Each page with the first rule whose key its url contains; pages without one are dropped.

    Rules are a short list by construction, so they are broadcast; the least ordinal is a partial
    aggregate, not a sort."""
    hit = pages.join(F.broadcast(rules), F.contains(pages["url"], rules["url_key"]))
    best = hit.groupBy("page_id").agg(F.min(F.struct("ordinal", "url_key", "rule")).alias("r"))
    return best.select("page_id", "r.ordinal", "r.url_key", "r.rule")


def extracted(pages: DataFrame, start: str = "article", at: str = "p", least: int = 0) -> DataFrame:
    """page_id and the text of the pages that have over `least` characters of it, by one rule for all."""

    def of(batches):
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "text": [H.read(H.page(h), [start, at]) for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(of, "page_id long, text string").filter(F.length("text") > least)


def redirect(html: Column) -> Column:
    """The only og:url of a page, unless it is an error page; null otherwise."""
    found = F.regexp_extract_all(html, F.lit(r'<meta[^>]*property="og:url"[^>]*content="([^"]*)"'), F.lit(1))
    return F.when((F.size(found) == 1) & ~F.contains(found[0], F.lit("404")), found[0])


def article_texts(pages: DataFrame, rules: dict[str, list[str]] | None = None, least: int = LEAST_TEXT) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text of the pages with an article of over `least` characters.

    Removed and excluded pages and sites without a rule have none. An interim page stands for the page of its
    og:url, which is taken from the same pages. The first rule whose key the url contains decides."""
    rules = SITE_RULES if rules is None else rules
    pages = pages.filter(~F.contains("url", F.lit("removed.com")))
    interim = F.startswith("url", F.lit(INTERIM))
    direct = pages.filter(~interim & ~excluded(F.col("url"), rules)).select("page_id", "url", "html")
    moved = pages.filter(interim).select("page_id", redirect(F.col("html")).alias("url")).filter(~excluded(F.col("url"), rules))
    target = pages.filter(~interim).groupBy(F.col("url").alias("target")).agg(F.min("html").alias("html"))
    all_ = direct.unionByName(moved.join(target, F.col("url") == F.col("target")).select("page_id", "url", "html"))
    listed = list(rules.items())

    def of(batches):
        for b in batches:
            texts = [H.read(H.page(h), next((r for k, r in listed if k in u), [])) for u, h in zip(b["url"], b["html"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    return all_.mapInPandas(of, "page_id long, url string, text string").filter(F.length("text") > least)


def article_body(pages: DataFrame) -> DataFrame:
    """page_id and the text that the page's JSON-LD holds; without one it is empty."""

    def of(batches):
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "text": [H.body_of_json(H.page(h)) for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(of, "page_id long, text string")


def without_prefix_titles(titles: DataFrame, width: int = 30) -> DataFrame:
    """(id, title): rows are dropped whose first `width` characters start another row's title.

    The prefixes are of one length, so this is an equi-join on the prefix, not a theta join. Rows that
    match each other are all dropped; shorter titles are compared as a whole. A null title starts nothing
    and stays; an empty one starts every other."""
    t = titles.select("id", "title")
    known = t.filter("title is not null")
    head = F.left("title", F.lit(width))
    n = known.groupBy(head.alias("head")).agg(F.count("*").alias("n"))
    kept_long = known.filter(F.length("title") >= width).withColumn("head", head).join(n, "head").filter("n = 1").select("id", "title")
    # a short title is a prefix of other titles of any length: its own length picks the key
    lengths = F.sequence(F.lit(0), F.least(F.lit(width - 1), F.length("title")))
    keys = known.select(F.explode(F.transform(lengths, lambda k: F.left(F.col("title"), k))).alias("head")).groupBy("head").agg(F.count("*").alias("n"))
    kept_short = known.filter(F.length("title") < width).join(keys, F.col("title") == F.col("head")).filter("n = 1").select("id", "title")
    return kept_long.unionByName(kept_short).unionByName(t.filter("title is null"))


def matching_articles(sources: list[DataFrame], width: int = 30, aggregator: str = "Google News") -> DataFrame:
    """(id, title, published, source, url) of several searches together: without excluded addresses, and
    without the aggregator's articles whose first characters start another one's title."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    from_it = F.coalesce(F.col("source") == aggregator, F.lit(False))
    alone = without_prefix_titles(every, width).select("id").withColumn("alone", F.lit(True))
    got = every.join(alone, "id", "left").filter(~from_it | F.coalesce("alone", F.lit(False))).drop("alone")
    return got.filter(~F.coalesce(excluded(F.col("url"), None), F.lit(False)))


def pages_needed(total: Column, size: int = 100) -> Column:
    return F.ceil(total / F.lit(size)).cast("int")

"""Queries over texts: overviews, sentences, quotations and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.plans.base import query

NORM = "trim(replace(replace(text, chr(10), ' '), '  ', ' '), ' ')"
_SHORT = r"regexp_replace({0}, '\b(" + "|".join(T.ABBREVIATIONS) + r"|[A-Z])\.(\s)', '\1.' || chr(2) || '\2', 'g')"
SENTS = r"list_filter(list_transform(string_split(regexp_replace(" + _SHORT + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(replace(s, chr(2), ''), ' ')), lambda s: length(s) > 0)"
N_QUOTES = {"straight": "len(regexp_extract_all(text, '\"(.*?)\"'))", "single": "len(regexp_extract_all(text, '‘(.*?)’'))", "double": "len(regexp_extract_all(text, '“(.*?)”'))"}


@query(
    "article_overview",
    f"""WITH d AS (SELECT doc_id, source, {SENTS.format(NORM)} AS s, {N_QUOTES['straight']} + {N_QUOTES['single']} + {N_QUOTES['double']} AS q FROM documents),
    w AS (SELECT doc_id, source, len(s) AS n, list_transform(s, lambda x: len(string_split(x, ' '))) AS c, q FROM d)
    SELECT w.doc_id, source, CAST(n AS BIGINT) AS n_sentences, CAST(list_min(c) AS BIGINT) AS min_words, CAST(list_max(c) AS BIGINT) AS max_words,
    round(list_sum(c) * 1.0 / n, 6) AS avg_words, CAST(q AS BIGINT) AS n_quotes, round(100.0 * q / n, 2) AS quote_pct, quality, toxic
    FROM w LEFT JOIN labels l ON w.doc_id = l.doc_id ORDER BY n_sentences DESC, doc_id""",
)
def article_overview(t):
    """The per-article panel. Texts become a few numbers before anything moves; the numbers are shuffled
    once, so that neither the join nor the sort's sampling computes on the texts again."""
    d = t("documents").select("doc_id", "source", T.sentences(T.normalised(F.col("text"))).alias("s"), sum(F.size(T.quotes(F.col("text"), k)) for k in T.QUOTE_STYLES).alias("q"))
    words = d.select("doc_id", "source", "q", F.transform("s", lambda x: F.size(F.split(x, " "))).alias("c"))
    total = F.aggregate("c", F.lit(0), lambda a, x: a + x)
    w = words.select("doc_id", "source", "q", F.size("c").alias("n"), F.array_min("c").alias("least"), F.array_max("c").alias("most"), total.alias("total")).repartition("doc_id")
    out = w.join(t("labels"), "doc_id", "left").select(
        "doc_id", "source", F.col("n").cast("long").alias("n_sentences"), F.col("least").cast("long").alias("min_words"), F.col("most").cast("long").alias("max_words"),
        F.round(F.when(F.col("n") > 0, F.col("total") / F.col("n")), 6).alias("avg_words"), F.col("q").cast("long").alias("n_quotes"), F.round(F.when(F.col("n") > 0, 100.0 * F.col("q") / F.col("n")), 2).alias("quote_pct"), "quality", "toxic",
    )
    return out.orderBy(F.desc("n_sentences"), "doc_id")


@query("narr_by_length_desc", f"SELECT doc_id, source, CAST(len({SENTS.format(NORM)}) AS BIGINT) AS n_sentences FROM documents ORDER BY n_sentences DESC, doc_id")
def narr_by_length_desc(t):
    return t("documents").select("doc_id", "source", F.size(T.sentences(T.normalised(F.col("text")))).cast("long").alias("n_sentences")).repartition("doc_id").orderBy(F.desc("n_sentences"), "doc_id")


@query(
    "narr_list",
    "SELECT d.doc_id AS narrative, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.source IS NOT NULL AND d.lang IS NOT NULL AND d.n_chars IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL",
)
def narr_list(t):
    got = t("documents").join(t("labels"), "doc_id").select(F.col("doc_id").alias("narrative"), "source", "lang", "n_chars", "quality", "toxic")
    return got.dropna()


@query(
    "bias_class_counts",
    "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'center' WHEN source IN ('src3', 'src4', 'src5') THEN 'conservative' ELSE 'liberal' END AS bias, count(*) AS articles FROM documents GROUP BY 1",
)
def bias_class_counts(t):
    return t("documents").groupBy(T.bias_class(F.col("source"), ["src1", "src2"], ["src3", "src4", "src5"]).alias("bias")).agg(F.count("*").alias("articles"))


@query("text_normalize", f"SELECT doc_id, {NORM} AS norm FROM documents")
def text_normalize(t):
    return t("documents").select("doc_id", T.normalised(F.col("text")).alias("norm"))


_REPAIR_IN = "concat(replace(text, 'e ', 'e- '), ' 5 % ]')"
_REP = "regexp_replace(regexp_replace({0}, '([0-9]) %', '\\1%', 'g'), ' (\\])', '\\1', 'g')"
_HY = "regexp_replace({0}, '([a-zA-Z])- ([a-zA-Z])', '\\1-\\2', 'g')"


@query("text_token_repair", f"SELECT doc_id, {_HY.format(_HY.format(_REP.format(_REPAIR_IN)))} AS repaired FROM documents")
def text_token_repair(t):
    raw = F.concat(F.replace("text", F.lit("e "), F.lit("e- ")), F.lit(" 5 % ]"))
    return t("documents").select("doc_id", T.repaired(raw).alias("repaired"))


@query("text_article_strip", "SELECT p_partkey, regexp_replace(concat('the ', p_name), '^(?:a|A|an|An|the|The) ', '') AS stripped FROM part")
def text_article_strip(t):
    return t("part").select("p_partkey", T.without_article(F.concat(F.lit("the "), F.col("p_name"))).alias("stripped"))


@query("text_conjunction_strip", "SELECT p_partkey, regexp_replace(concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' and' ELSE ' or' END), ' (?:and|or)$', '') AS stripped FROM part")
def text_conjunction_strip(t):
    return t("part").select("p_partkey", T.without_conjunction(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " and").otherwise(" or"))).alias("stripped"))


@query("text_possessive_strip", "SELECT c_custkey, regexp_replace(concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN '''s' ELSE '’' END), '[''’]s?$', '') AS stripped FROM customer")
def text_possessive_strip(t):
    return t("customer").select("c_custkey", T.without_possessive(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "'s").otherwise("’"))).alias("stripped"))


@query("text_from_capital", f"WITH n AS (SELECT doc_id, {NORM} AS t FROM documents) SELECT doc_id, regexp_extract(lower(left(t, 5)) || substr(t, 6), '(\\p{{Lu}}.*)$', 1) AS cut FROM n")
def text_from_capital(t):
    n = t("documents").select("doc_id", T.normalised(F.col("text")).alias("t"))
    return n.select("doc_id", T.from_capital(F.concat(F.lower(F.left("t", F.lit(5))), F.expr("substr(t, 6)"))).alias("cut"))


_I = "replace(regexp_replace(c_name, '[^:a-zA-Z0-9_]', '_', 'g'), '__', '_')"


@query("iri_mint", f"WITH i AS (SELECT c_custkey, {_I} AS t FROM customer), j AS (SELECT c_custkey, ':' || CASE WHEN starts_with(t, '_') THEN substr(t, 2) ELSE t END AS t FROM i) SELECT c_custkey, CASE WHEN ends_with(t, '_') THEN left(t, length(t) - 2) ELSE t END AS iri FROM j")
def iri_mint(t):
    return t("customer").select("c_custkey", T.iri(F.col("c_name")).alias("iri"))


@query("base_type", "SELECT c_custkey, replace(replace(replace(replace(k, 'PLURAL', ''), 'SING', ''), 'FEMALE', ''), 'MALE', '') AS base FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PLURALPERSON' WHEN 1 THEN 'SINGFEMALEPERSON' WHEN 2 THEN 'MALEPERSON' ELSE 'GPE' END AS k FROM customer)")
def base_type(t):
    k = F.col("c_custkey") % 4
    kind = F.when(k == 0, "PLURALPERSON").when(k == 1, "SINGFEMALEPERSON").when(k == 2, "MALEPERSON").otherwise("GPE")
    return t("customer").select("c_custkey", T.base_type(kind).alias("base"))


@query("name_parts", "SELECT p_partkey, array_to_string(list_filter(flatten(list_transform(string_split(p_name || ' Smith-Evans', ' '), lambda w: string_split(w, '-'))), lambda x: x <> ''), '|') AS parts FROM part")
def name_parts(t):
    return t("part").select("p_partkey", F.array_join(T.name_parts(F.concat("p_name", F.lit(" Smith-Evans"))), "|").alias("parts"))


_DAY = "CAST(day(o_orderdate) AS VARCHAR)"


@query(
    "time_iri",
    f"""SELECT o_orderkey, ':PiT' || CASE o_orderkey % 7 WHEN 0 THEN '_Yr' || strftime(o_orderdate, '%Y') || '_Mo' || strftime(o_orderdate, '%B') || '_Day' || {_DAY}
    WHEN 1 THEN '_Yr' || strftime(o_orderdate, '%Y') || '_Mo' || strftime(o_orderdate, '%B') || '_Day' || {_DAY} WHEN 2 THEN '_Day' || strftime(o_orderdate, '%A')
    WHEN 3 THEN '_Mo' || strftime(o_orderdate, '%B') WHEN 4 THEN '_Yr' || strftime(o_orderdate, '%Y') WHEN 5 THEN '_the_day_after_' || CAST(o_orderkey % 10 AS VARCHAR) ELSE '_Mo' || strftime(o_orderdate, '%B') || '_Day' || {_DAY} END AS iri FROM orders""",
)
def time_iri(t):
    """Full dates, dates with a weekday, bare weekdays, months, years, words, and days of a month."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    month, day, year, weekday = F.date_format(d, "MMMM"), F.dayofmonth(d).cast("string"), F.date_format(d, "yyyy"), F.date_format(d, "EEEE")
    said = F.when(k == 0, F.concat(month, F.lit(" "), day, F.lit(", "), year)).when(k == 1, F.concat(weekday, F.lit(", "), month, F.lit(" "), day, F.lit(", "), year)).when(k == 2, F.concat(F.lit("on "), weekday))
    said = said.when(k == 3, F.concat(F.lit("in "), month)).when(k == 4, F.concat(F.lit("since "), year)).when(k == 5, F.concat(F.lit("the Day after: "), (F.col("o_orderkey") % 10).cast("string"))).otherwise(F.concat(day, F.lit(" "), month))
    return t("orders").select("o_orderkey", T.time_iri(said).alias("iri"))


_SAID = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2024-' || (o_orderkey % 15) || '-' || (o_orderkey % 37) WHEN 2 THEN (1890 + o_orderkey % 230) || '-02-31' WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%y-%m-%d') END"


@query(
    "date_valid",
    f"SELECT o_orderkey, coalesce(len(p) = 3 AND length(p[1]) = 4 AND list_bool_and(list_transform(p, lambda x: regexp_full_match(x, '[0-9]+'))) AND TRY_CAST(p[1] AS INT) > 1900 AND TRY_CAST(p[1] AS INT) < 2100 AND TRY_CAST(p[2] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(p[3] AS INT) BETWEEN 1 AND 31, false) AS valid FROM (SELECT o_orderkey, string_split({_SAID}, '-') AS p FROM orders)",
)
def date_valid(t):
    """Dates of several forms, years, months and days inside and outside of the bounds."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    k, n = key % 5, lambda m: (key % m).cast("string")
    said = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.concat(F.lit("2024-"), n(15), F.lit("-"), n(37))).when(k == 2, F.concat((1890 + key % 230).cast("string"), F.lit("-02-31")))
    said = said.when(k == 3, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yy-MM-dd"))
    return t("orders").select("o_orderkey", T.date_valid(said).alias("valid"))


@query("trunc90", "SELECT doc_id, CASE WHEN length(text) < 91 THEN text ELSE left(text, 90) || ' ...' END AS short FROM documents")
def trunc90(t):
    return t("documents").select("doc_id", T.truncated(F.col("text")).alias("short"))


@query("strafter", "SELECT url_key, count(*) AS pages FROM (SELECT CASE WHEN strpos(url, '//') > 0 THEN split_part(substr(url, strpos(url, '//') + 2), '/', 1) ELSE '' END AS url_key FROM pages) GROUP BY 1")
def strafter(t):
    return t("pages").groupBy(F.substring_index(T.after(F.col("url"), "//"), "/", 1).alias("url_key")).agg(F.count("*").alias("pages"))


@query("literal_encode", "SELECT doc_id, CASE WHEN contains(x, chr(10)) THEN '\"\"\"' || x || '\"\"\"' ELSE '\"' || x || '\"' END AS lit FROM (SELECT doc_id, replace(replace(text, '\"', ''''), '\\', '\\\\') AS x FROM documents)")
def literal_encode(t):
    return t("documents").select("doc_id", T.literal(F.col("text")).alias("lit"))


@query("punctuation_flags", "SELECT doc_id, contains(text, '?') AS question, contains(text, '!') AS exclamation FROM documents")
def punctuation_flags(t):
    q, e = T.punctuation(F.col("text"))
    return t("documents").select("doc_id", q.alias("question"), e.alias("exclamation"))


@query("quote_styles", f"SELECT doc_id, CAST({N_QUOTES['straight']} AS BIGINT) AS straight, CAST({N_QUOTES['single']} AS BIGINT) AS single, CAST({N_QUOTES['double']} AS BIGINT) AS double FROM documents")
def quote_styles(t):
    return t("documents").select("doc_id", *[F.size(T.quotes(F.col("text"), s)).cast("long").alias(s) for s in T.QUOTE_STYLES])


@query("quote_dominant", f"WITH q AS (SELECT doc_id, {N_QUOTES['straight']} a, {N_QUOTES['single']} b, {N_QUOTES['double']} c FROM documents) SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'straight' WHEN b >= c THEN 'single' ELSE 'double' END AS style FROM q")
def quote_dominant(t):
    return t("documents").select("doc_id", T.dominant_style(F.col("text")).alias("style"))


@query("sentence_split", f"SELECT doc_id, CAST(unnest(generate_series(1, len(s))) AS BIGINT) AS \"offset\", unnest(s) AS sentence FROM (SELECT doc_id, {SENTS.format(NORM)} AS s FROM documents)")
def sentence_split(t):
    d = t("documents").select("doc_id", F.posexplode(T.sentences(T.normalised(F.col("text")))).alias("k", "sentence"))
    return d.select("doc_id", (F.col("k") + 1).cast("long").alias("offset"), "sentence")


@query("sentence_guard", f"SELECT doc_id, count(*) FILTER (length(x) >= 3 AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS good, count(*) FILTER (NOT (length(x) >= 3 AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS skipped FROM (SELECT doc_id, unnest({SENTS.format(NORM)}) AS x FROM documents) GROUP BY 1")
def sentence_guard(t):
    s = T.sentences(T.normalised(F.col("text")))
    d = t("documents").select("doc_id", s.alias("s"), F.size(F.filter(s, T.guarded)).cast("long").alias("good"))
    return d.filter(F.size("s") > 0).select("doc_id", "good", (F.size("s") - F.col("good")).cast("long").alias("skipped"))


@query(
    "paragraph_split",
    "SELECT doc_id, CAST(unnest(generate_series(1, len(p))) AS BIGINT) AS k, unnest(p) AS paragraph FROM (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents)",
)
def paragraph_split(t):
    """Paragraphs are what blank lines divide; here a line that ends with a full stop is made one."""
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    return t("documents").select("doc_id", F.posexplode(T.paragraphs(text)).alias("k", "paragraph")).select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "paragraph")


@query("sentence_grades", f"SELECT CAST(count(*) AS BIGINT) AS cnt, min(w) AS least, max(w) AS most, round(avg(w), 6) AS mean FROM (SELECT CAST(len(string_split(unnest({SENTS.format(NORM)}), ' ')) AS BIGINT) AS w FROM documents)")
def sentence_grades(t):
    """Global count, min, max and mean; one row even for no sentences, with a mean of 0."""
    s = t("documents").select(F.explode(T.sentences(T.normalised(F.col("text")))).alias("s")).select(F.size(F.split("s", " ")).cast("long").alias("w"))
    return s.agg(F.count("*").alias("cnt"), F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.coalesce(F.avg("w"), F.lit(0.0)), 6).alias("mean"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "json_reply",
    "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type || ' ' || CASE event_id % 4 WHEN 1 THEN 'a b' ELSE 'c' END END AS said FROM events",
)
def json_reply(t):
    """Replies over several lines, with a line end inside of a string, and cut off: null."""
    k = F.col("event_id") % 4
    said = F.concat(F.col("event_type"), F.lit(" "), F.when(k == 1, "a\nb").otherwise("c"))
    reply = F.concat(F.lit('{\n"k":\n'), F.get_json_object("props", "$.k"), F.lit(', "said": "'), said, F.lit('"'), F.when(k == 3, "").otherwise("\n}"))
    got = T.json_reply(reply, "k long, said string")
    return t("events").select("event_id", got["k"].alias("k"), got["said"].alias("said"))


@query(
    "xml_xpath",
    "SELECT n_nationkey, n_name || ' & co' AS name, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN n_name ELSE n_name || '|' || lower(n_name) END AS names, CASE WHEN n_nationkey % 2 = 0 THEN 'https://en.wikipedia.org/wiki/' || n_name END AS link FROM nation",
)
def xml_xpath(t):
    """A gazetteer's reply: its name, none to two English names among others, a link that may be absent."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    one = lambda lang, x: F.concat(F.lit(f'<alternateName lang="{lang}">'), x, F.lit("</alternateName>"))
    names = F.concat(F.when(k % 3 > 0, one("en", name)).otherwise(""), one("fr", F.lit("autre")), F.when(k % 3 == 2, one("en", F.lower(name))).otherwise(""))
    links = F.concat(one("link", F.lit("https://fr.wikipedia.org/wiki/x")), F.when(k % 2 == 0, one("link", F.concat(F.lit("https://en.wikipedia.org/wiki/"), name))).otherwise(""))
    xml = F.concat(F.lit("<g><toponymName>"), name, F.lit(" &amp; co</toponymName>"), names, links, F.lit("</g>"))
    english, link = T.alternate_names(xml)
    return t("nation").select("n_nationkey", F.xpath_string(xml, F.lit("/g/toponymName")).alias("name"), F.array_join(english, "|").alias("names"), link.alias("link"))


@query("pagination", "SELECT p_brand, count(*) AS n, CAST(ceil(count(*) / 100.0) AS INTEGER) AS pages FROM part GROUP BY 1")
def pagination(t):
    from loomgraph.operators.news import pages_needed

    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", "n", pages_needed(F.col("n")).alias("pages"))


@query("numbered_vocab", "SELECT string_agg(k || '. ' || p_type, ' ' ORDER BY k) AS prompt FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) AS k FROM (SELECT DISTINCT p_type FROM part))")
def numbered_vocab(t):
    kinds = F.sort_array(F.collect_set("p_type"))
    return t("part").agg(F.array_join(F.transform(kinds, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)), " ").alias("prompt"))

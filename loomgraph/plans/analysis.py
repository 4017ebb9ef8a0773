"""Analytical queries: counts, comparisons, resolution, semantics, news."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import vocab as V
from loomgraph.operators import align as A
from loomgraph.operators import news as N
from loomgraph.operators import resolve as R
from loomgraph.operators import semantics as S
from loomgraph.plans.base import query


@query("device_counts_values", "SELECT v AS device, count(*) AS cnt FROM events JOIN (SELECT unnest(['click', 'view', 'error', 'none']) AS v) ON event_type = v GROUP BY 1 ORDER BY device")
def device_counts_values(t):
    """Counts over an inline relation of values; values without events give no group."""
    e = t("events")
    values = e.sparkSession.createDataFrame([(x,) for x in ("click", "view", "error", "none")], "device string")
    return e.join(F.broadcast(values), F.col("event_type") == F.col("device")).groupBy("device").agg(F.count("*").alias("cnt")).orderBy("device")


@query("mention_counts_typed", "SELECT n_name AS entity, c_mktsegment AS label, count(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY cnt DESC, entity, label")
def mention_counts_typed(t):
    got = t("orders").select("o_custkey").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return got.groupBy(F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "entity", "label")


@query("mention_and_device", "SELECT p_type AS device, o_orderpriority AS label, count(*) AS cnt, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL")
def mention_and_device(t):
    li = t("lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_extendedprice")
    got = li.join(t("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return got.groupBy(F.col("p_type").alias("device"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("cnt"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("quotes_group_concat", "SELECT d.doc_id, coalesce(string_agg(DISTINCT c.role, ', ' ORDER BY c.role), '') AS roles FROM documents d LEFT JOIN conversations c ON d.doc_id = c.conv_id GROUP BY 1")
def quotes_group_concat(t):
    """Optional join and concatenation; an empty group is an empty string, not null."""
    roles = t("conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ", ").alias("roles"))
    return t("documents").select("doc_id").join(roles, F.col("doc_id") == F.col("conv_id"), "left").select("doc_id", F.coalesce("roles", F.lit("")).alias("roles"))


@query("attribution_counts", "SELECT s_name AS agent, n_name AS label, count(*) AS cnt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2 GROUP BY ALL")
def attribution_counts(t):
    """Counts by agent and optional label; the group without a label stays."""
    per = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    got = per.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").filter("n_regionkey <> 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return got.groupBy(F.col("s_name").alias("agent"), F.col("n_name").alias("label")).agg(F.sum("n").alias("cnt"))


@query("quote_sentiment_counts", "SELECT CASE WHEN value < 10 THEN 'negative' WHEN value < 30 THEN 'neutral' ELSE 'positive' END AS sentiment, count(*) AS cnt FROM events GROUP BY 1")
def quote_sentiment_counts(t):
    return t("events").groupBy(F.when(F.col("value") < 10, "negative").when(F.col("value") < 30, "neutral").otherwise("positive").alias("sentiment")).agg(F.count("*").alias("cnt"))


@query(
    "subtopic_flow",
    "SELECT DISTINCT e.event_type AS type, ':confidence-' || e.event_type AS predicate, CAST(floor(e.value / 10) AS BIGINT) AS confidence, r.r_name AS negated, n.n_name AS label FROM events e LEFT JOIN region r ON e.user_id = r.r_regionkey LEFT JOIN nation n ON e.user_id = n.n_nationkey WHERE e.event_type <> 'view' ORDER BY type, confidence, label",
)
def subtopic_flow(t):
    e = t("events").filter("event_type <> 'view'")
    got = e.join(t("region"), F.col("user_id") == F.col("r_regionkey"), "left").join(t("nation"), F.col("user_id") == F.col("n_nationkey"), "left")
    got = got.select(F.col("event_type").alias("type"), F.concat(F.lit(":confidence-"), "event_type").alias("predicate"), F.floor(F.col("value") / 10).alias("confidence"), F.col("r_name").alias("negated"), F.col("n_name").alias("label"))
    return got.distinct().orderBy("type", "confidence", "label")


_NEG = "CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0"


@query("event_counts_having", f"SELECT CASE WHEN {_NEG} THEN '!' || event_type ELSE event_type END AS event, count(*) AS cnt FROM events WHERE value >= 8 GROUP BY 1 HAVING count(*) > 2")
def event_counts_having(t):
    """Confident classes with a '!' where negated, seen more than twice."""
    negated = F.get_json_object("props", "$.k").cast("long") % 2 == 0
    return t("events").filter("value >= 8").groupBy(F.when(negated, F.concat(F.lit("!"), "event_type")).otherwise(F.col("event_type")).alias("event")).agg(F.count("*").alias("cnt")).filter("cnt > 2")


@query("event_counts_faithful", "SELECT event_type AS event, count(*) AS cnt FROM events GROUP BY 1 HAVING count(*) > 2")
def event_counts_faithful(t):
    """The variant that never marks negation and counts unconfident classes too."""
    return t("events").groupBy(F.col("event_type").alias("event")).agg(F.count("*").alias("cnt")).filter("cnt > 2")


@query("event_types_union", "SELECT user_id AS subject, event_type AS type FROM events UNION ALL SELECT conv_id, role FROM conversations")
def event_types_union(t):
    return t("events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("type")).unionAll(t("conversations").select("conv_id", "role"))


@query(
    "compare_full_outer",
    "WITH a AS (SELECT source AS k, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source AS k, count(*) AS n FROM documents WHERE lang = 'fr' AND source <> 'src1' GROUP BY 1) SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS first, coalesce(b.n, 0) AS second FROM a FULL JOIN b ON a.k = b.k ORDER BY key",
)
def compare_full_outer(t):
    count = lambda f, n: t("documents").filter(f).groupBy(F.col("source").alias("key")).agg(F.count("*").alias(n))
    got = count("lang = 'en'", "first").join(count("lang = 'fr' and source <> 'src1'", "second"), "key", "full")
    return got.select("key", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("second", F.lit(0)).alias("second")).orderBy("key")


@query("set_union_keys", "SELECT source AS key FROM documents UNION SELECT event_type FROM events")
def set_union_keys(t):
    return t("documents").select(F.col("source").alias("key")).union(t("events").select("event_type")).distinct()


_LANGS = ("en", "de", "fr", "es")


@query("publisher_pivot", "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in _LANGS) + " FROM documents GROUP BY 1")
def publisher_pivot(t):
    return t("documents").groupBy("source").pivot("lang", list(_LANGS)).agg(F.count(F.lit(1))).na.fill(0)


@query("dup_labels_selfjoin", "SELECT p_name AS term, p_type || '' AS class1, q AS class2, count(*) AS n FROM (SELECT DISTINCT p_name, p_type FROM part) a JOIN (SELECT DISTINCT p_name AS m, p_type AS q FROM part) b ON p_name = m AND p_type < q GROUP BY ALL")
def dup_labels_selfjoin(t):
    """Terms that two classes share, each unordered pair once. One shuffle: classes are paired in their
    term's set, which the vocabulary of classes bounds."""
    sets = t("part").groupBy(F.col("p_name").alias("term")).agg(F.array_sort(F.collect_set("p_type")).alias("c"))
    pairs = sets.select("term", F.posexplode("c").alias("i", "class1"), "c").select("term", "class1", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("class2"))
    return pairs.withColumn("n", F.lit(1).cast("long"))


@query("dup_first_class", "SELECT p_name AS term, arg_min(p_type, p_partkey) AS \"class\", count(DISTINCT p_type) AS classes FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def dup_first_class(t):
    return t("part").groupBy(F.col("p_name").alias("term")).agg(F.min_by("p_type", "p_partkey").alias("class"), F.countDistinct("p_type").alias("classes")).filter("classes > 1")


@query("title_prefix_dedupe", "SELECT doc_id AS id, text AS title FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id <> a.doc_id AND starts_with(b.text, left(a.text, 30)))")
def title_prefix_dedupe(t):
    return N.without_prefix_titles(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title")))


_KEYS = "VALUES " + ", ".join(f"({n}, '{k}')" for n, k in enumerate(V.SITE_RULES, 1))
_URL = f"CASE WHEN page_id % 50 < 41 THEN 'https://www' || (SELECT list(k ORDER BY n) FROM rules)[page_id % 50 + 1] || 'com/' || CASE page_id % 7 WHEN 0 THEN 'video/1' WHEN 1 THEN 'live/2' ELSE 'a' END ELSE url END"
_SITES = f"WITH rules AS (SELECT n, k FROM ({_KEYS}) r(n, k)), p AS (SELECT page_id, {_URL} AS url FROM pages)"


def site_pages(t):
    """Pages under addresses of all sites with a rule, and of none."""
    keys, k = F.array(*[F.lit(x) for x in V.SITE_RULES]), (F.col("page_id") % 50).cast("int")
    end = F.when(F.col("page_id") % 7 == 0, "video/1").when(F.col("page_id") % 7 == 1, "live/2").otherwise("a")
    url = F.when(k < 41, F.concat(F.lit("https://www"), F.get(keys, k), F.lit("com/"), end)).otherwise(F.col("url"))
    return t("pages").select("page_id", url.alias("url"), "html")


@query("site_rule_first_match", f"{_SITES} SELECT page_id, CAST(min(n) AS INTEGER) AS ordinal, min_by(k, n) AS url_key FROM p JOIN rules ON contains(url, k) GROUP BY 1")
def site_rule_first_match(t):
    pages = site_pages(t).select("page_id", "url")
    return N.first_rule(pages, N.site_rules(pages.sparkSession)).select("page_id", "ordinal", "url_key")


@query("url_excluded", f"{_SITES} SELECT page_id, contains(url, '/video') OR contains(url, '/live') OR contains(url, '/tv') OR contains(url, 'bbc.co.uk/programmes') OR NOT EXISTS (SELECT 1 FROM rules WHERE contains(url, k)) AS excluded FROM p")
def url_excluded(t):
    """Video and live pages, and sites without a rule."""
    return site_pages(t).select("page_id", N.excluded(F.col("url")).alias("excluded"))


_PLAIN = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)^.*?<p>', '<p>'), '<[^>]*>', '', 'g')"
for _code, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_code}', '{_char}')"
_ARTICLE = f"SELECT page_id, trim({_PLAIN}, ' ' || chr(9) || chr(10)) || ' ' AS text FROM pages"


@query("html_text", f"SELECT * FROM ({_ARTICLE}) WHERE length(text) > 1")
def html_text(t):
    """Paragraph texts inside of the article element, by an HTML parser in Arrow batches. In these pages the first
    paragraph isn't closed and holds the others, which the SQL takes for granted."""
    return N.extracted(t("pages"))


@query("html_text_min500", f"SELECT * FROM ({_ARTICLE}) WHERE length(text) > 500")
def html_text_min500(t):
    return N.extracted(t("pages"), least=500)


_INNER = "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g')"
for _code, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _INNER = f"replace({_INNER}, '{_code}', '{_char}')"


@query(
    "article_texts",
    f"""{_SITES}, s AS (SELECT *, CASE WHEN page_id % 50 < 41 THEN (SELECT list(k ORDER BY n) FROM rules)[page_id % 50 + 1] END AS site FROM p),
    a AS (SELECT page_id, trim({_INNER}, ' ' || chr(9) || chr(10)) || ' ' AS whole FROM pages)
    SELECT page_id, url, CASE site WHEN 'economictimes.indiatimes.' THEN whole ELSE text END AS text FROM s JOIN ({_ARTICLE}) USING (page_id) JOIN a USING (page_id)
    WHERE page_id % 7 > 1 AND site IN ('abcnews.go.', '.afr.', 'globalnews.ca', 'thehill.', '.usatoday.', 'nypost.', 'economictimes.indiatimes.') AND length(CASE site WHEN 'economictimes.indiatimes.' THEN whole ELSE text END) > 500""",
)
def article_texts(t):
    """Articles by their sites' rules: the pages here have an article element only, so sites whose rules start at another
    one have none; of the others one takes every paragraph of the page and one the article with its heading."""
    return N.article_texts(site_pages(t))


@query("html_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_titles(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_MENTION = """CASE p_partkey % 8 WHEN 0 THEN 'NATION_' || (p_partkey % 30) WHEN 1 THEN 'ASIA' WHEN 2 THEN 'Greater NATION_' || (p_partkey % 7) WHEN 3 THEN 'ATION_2'
 WHEN 4 THEN 'the old ATION_' || (p_partkey % 9) WHEN 5 THEN 'NATION_' || (p_partkey % 5) || ' border region' WHEN 6 THEN 'North river' ELSE 'Nobody ' || (p_partkey % 11) END"""
_RUN = r"regexp_replace(regexp_extract(mention, '(?:^|\s)((?:[^{0}\s]\S*)(?:\s+[^{0}\s]\S*)*)\s*$', 1), '\s+', ' ', 'g')"


@query(
    "entity_resolve_priority",
    f"""WITH labels AS (SELECT n_name AS label, ':N' || n_nationkey AS iri, n_nationkey AS seq FROM nation UNION ALL SELECT 'river', ':river', 100 UNION ALL SELECT 'the border region', ':border', 101), c AS (SELECT r_name AS name, ':R' || r_regionkey AS iri FROM region),
    m AS (SELECT DISTINCT {_MENTION} AS mention FROM part),
    b AS (SELECT mention, CASE WHEN contains(mention, ' ') AND regexp_matches(mention, '\\p{{Lu}}') THEN CASE WHEN regexp_matches(mention, '(?:^|\\s)\\p{{Lu}}\\S*\\s*$') THEN {_RUN.format('a-z')} ELSE {_RUN.format('A-Z')} END ELSE mention END AS base FROM m),
    cand AS (SELECT mention, 1 AS p, 0 AS seq, c.iri FROM m JOIN c ON name = mention UNION ALL SELECT mention, 2, seq, iri FROM m JOIN labels ON label = mention
     UNION ALL SELECT mention, 3, seq, iri FROM b JOIN labels ON contains(base, label) UNION ALL SELECT mention, 4, seq, iri FROM b JOIN labels ON contains(label, base))
    SELECT m.mention, arg_min(iri, p * 1000 + seq) AS iri, CAST(coalesce(min(p), 5) AS INTEGER) AS priority FROM m LEFT JOIN cand ON m.mention = cand.mention GROUP BY 1""",
)
def entity_resolve_priority(t):
    """Countries, labels, labels inside of the mention's base words, base words inside of a label, and none."""
    text = lambda c: c.cast("string")
    labels = t("nation").select(F.col("n_name").alias("label"), F.concat(F.lit(":N"), text(F.col("n_nationkey"))).alias("iri"), F.col("n_nationkey").cast("long").alias("seq"))
    labels = labels.unionByName(labels.sparkSession.createDataFrame([("river", ":river", 100), ("the border region", ":border", 101)], "label string, iri string, seq long"))
    countries = t("region").select(F.col("r_name").alias("name"), F.concat(F.lit(":R"), text(F.col("r_regionkey"))).alias("iri"))
    key = F.col("p_partkey")
    k = key % 8
    said = F.when(k == 0, F.concat(F.lit("NATION_"), text(key % 30))).when(k == 1, "ASIA").when(k == 2, F.concat(F.lit("Greater NATION_"), text(key % 7))).when(k == 3, "ATION_2")
    said = said.when(k == 4, F.concat(F.lit("the old ATION_"), text(key % 9))).when(k == 5, F.concat(F.lit("NATION_"), text(key % 5), F.lit(" border region"))).when(k == 6, "North river").otherwise(F.concat(F.lit("Nobody "), text(key % 11)))
    return R.resolved(t("part").select(said.alias("mention")), labels, countries).select("mention", "iri", "priority")


@query("phrase_fallback", "WITH k AS (SELECT 'ring' AS phrase, 'agent' AS role UNION ALL SELECT 'small ring', 'theme' UNION ALL SELECT 'widget', 'patient') SELECT p_partkey, coalesce(a.role, b.role) AS role FROM part LEFT JOIN k a ON a.phrase = p_name LEFT JOIN k b ON b.phrase = regexp_replace(p_name, '^\\S+ ', '') WHERE coalesce(a.role, b.role) IS NOT NULL")
def phrase_fallback(t):
    p = t("part").select("p_partkey", F.col("p_name").alias("phrase"))
    known = p.sparkSession.createDataFrame([("ring", "agent"), ("small ring", "theme"), ("widget", "patient")], "phrase string, role string")
    return p.join(R.phrase_or_rest(p.select("phrase").distinct(), known), "phrase").select("p_partkey", "role")


@query(
    "hyphen_split_all_known",
    """WITH m AS (SELECT DISTINCT s_name || '-' || (CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Nobody' END) AS mention, s_suppkey FROM supplier), known AS (SELECT s_name AS name FROM supplier UNION SELECT mention FROM m WHERE s_suppkey % 6 = 0),
    p AS (SELECT mention, unnest(string_split(mention, '-')) AS part FROM m), a AS (SELECT mention, bool_and(part IN (SELECT name FROM known)) AS ok FROM p GROUP BY 1)
    SELECT p.mention, part FROM p JOIN a ON p.mention = a.mention WHERE ok UNION ALL SELECT mention, mention FROM a WHERE NOT ok UNION ALL SELECT mention, mention FROM a WHERE ok AND mention IN (SELECT name FROM known)""",
)
def hyphen_split_all_known(t):
    """Parts where all are known, the whole where not, and also the whole where that is known."""
    s = t("supplier")
    m = s.select(F.concat("s_name", F.lit("-"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("Nobody")).alias("mention"), "s_suppkey")
    known = s.select(F.col("s_name").alias("name")).union(m.filter("s_suppkey % 6 = 0").select("mention"))
    return R.hyphen_parts(m, known, keep_known=True)


@query("adjacent_merge")
def adjacent_merge(t):
    """Words of whole turns as places: neighbours of one type that the text has as 'a, b' are one place."""
    c = t("conversations").withColumn("names", F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)))
    places = F.transform("names", lambda n: F.struct(n.alias("text"), F.when(F.length(n) % 3 == 0, "LOC").otherwise("GPE").alias("kind")))
    rows = c.filter(F.size("names") > 0).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence_id"), F.col("text").alias("sentence"), places.alias("entities"))
    return R.merge_neighbours(rows).select("sentence_id", "sentence", F.to_json("entities").alias("entities"))


_FIRST = "['Mary', 'Jack', 'Robin', 'Ann', 'Customer#', 'X', 'mary']"


@query("gender_lookup", f"SELECT c_custkey, CASE WHEN f IN ('Mary', 'Ann', 'Robin') THEN 'FEMALE' WHEN f IN ('Jack', 'Robin') THEN 'MALE' ELSE '' END AS gender FROM (SELECT c_custkey, {_FIRST}[c_custkey % 7 + 1] AS f FROM customer)")
def gender_lookup(t):
    """First names in one list, in both (the female one is asked first) and in none."""
    first = F.get(F.array(*[F.lit(x) for x in ("Mary", "Jack", "Robin", "Ann", "Customer#", "X", "mary")]), (F.col("c_custkey") % 7).cast("int"))
    people = t("customer").select("c_custkey", F.concat(first, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name")).otherwise("")).alias("name"))
    names = lambda *x: people.sparkSession.createDataFrame([(n,) for n in x], "name string")
    of = R.gender(people.select("name").distinct(), names("Mary", "Ann", "Robin"), names("Jack", "Robin"))
    return people.join(of, "name").select("c_custkey", "gender")


@query("country_lookup", "SELECT c_custkey, n_nationkey AS geo_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def country_lookup(t):
    return t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_nationkey").alias("geo_id"))


_ABOUT = "['a political party', 'a Religious order', 'an ethnic and religious group', 'an ideology', 'ethnography', 'a nationality', 'a club', 'of ideological, political kind']"


@query("norp_concept", f"SELECT p_partkey, CASE WHEN contains(d, 'politic') THEN ':PoliticalIdeology' WHEN contains(d, 'ideolog') THEN ':PoliticalIdeology' WHEN contains(d, 'religio') THEN ':ReligiousBelief' WHEN contains(d, 'ethnic') OR contains(d, 'ethno') OR contains(d, 'nationality') THEN ':Ethnicity' END AS \"class\" FROM (SELECT p_partkey, lower({_ABOUT}[p_partkey % 8 + 1]) AS d FROM part)")
def norp_concept(t):
    """The first keyword of the list that a description has decides."""
    about = F.array(*[F.lit(x) for x in ("a political party", "a Religious order", "an ethnic and religious group", "an ideology", "ethnography", "a nationality", "a club", "of ideological, political kind")])
    return t("part").select("p_partkey", S.concept_class(F.get(about, (F.col("p_partkey") % 8).cast("int"))).alias("class"))


_SAY = V.MODALS + ["will", "Can"]
_SAYS = "['" + "', '".join(_SAY) + "']"


@query(
    "modal_map",
    f"""SELECT event_id, CASE WHEN m IN ('can', 'could') THEN CASE WHEN f THEN ':OpportunityAndPossibility' ELSE ':ReadinessAndAbility' END WHEN m IN ('may', 'might', 'would') THEN ':OpportunityAndPossibility'
    WHEN m IN ('have to', 'must', 'shall') THEN ':RequirementAndDependence' WHEN m IN ('ought to', 'should') THEN ':AdviceAndRecommendation' END AS "class" FROM (SELECT event_id, {_SAYS}[event_id % 13 + 1] AS m, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 20 END AS f FROM events)""",
)
def modal_map(t):
    """All modals, others and none, with the future tense known or not."""
    modal = F.get(F.array(*[F.lit(x) for x in _SAY]), (F.col("event_id") % 13).cast("int"))
    return t("events").select("event_id", S.modal_class(modal, F.when(F.col("event_id") % 3 != 0, F.col("value") > 20)).alias("class"))


_ROLES = V.ROLES + ["co-agent", "Agent", ""]
_NOUNS = [":Person", ":Person, :Collection", ":Plant", ":GeopoliticalEntity", ":Location, :Collection", ":LineOfBusiness", ":EthnicGroup", ":Prison", ":OrganizationalEntity", ":Affiliation", ":Measurement", ":Resource", ":Animal"]
_EVENTS = [":Win", ":Measurement", ":AssessmentMeasurement", ":AttributeAndCharacteristic", ":Affiliation", ":MovementTravelAndTransportation", ":EmotionalResponse", ":SensoryPerception", ":Cognition"]
_list = lambda x: "['" + "', '".join(x) + "']"
_AGENT, _PLACE = "(" + _list(V.AGENT_CLASSES)[1:-1] + ")", "(" + _list(V.LOCATION_BUSINESS)[1:-1] + ")"
_ANIMATE = "(" + _list([x for x in V.AGENT_CLASSES if ":Plant" not in x])[1:-1] + ")"
_MAP = " ".join(f"WHEN '{r}' THEN '{V.ROLE_PREDICATE[r]}'" for r in V.ROLES)


@query(
    "predicate_case",
    f"""WITH x AS (SELECT event_id, user_id, {_list(_ROLES)}[event_id % {len(_ROLES)} + 1] AS role, {_list(_NOUNS)}[event_id // 5 % {len(_NOUNS)} + 1] AS noun,
     [{_list(_EVENTS)}[event_id // 3 % {len(_EVENTS)} + 1], {_list(_EVENTS)}[event_id // 11 % {len(_EVENTS)} + 1]] AS ev, CASE WHEN event_id % 2 = 0 THEN props ELSE event_type END AS text FROM events),
    y AS (SELECT *, max((role = 'agent')::INT) OVER (PARTITION BY user_id) = 1 AS any_agent, lower(role) AS r FROM x)
    SELECT event_id, CASE WHEN list_has_any(ev, [':Measurement', ':AssessmentMeasurement']) OR contains(noun, ':Measurement') OR contains(noun, ':AssessmentMeasurement') THEN CASE WHEN regexp_matches(text, '[0-9]') THEN ':has_quantification' ELSE ':has_context' END
     WHEN list_contains(ev, ':AttributeAndCharacteristic') AND (contains(noun, ':LineOfBusiness') OR contains(noun, ':EthnicGroup') OR contains(noun, ':PoliticalGroup') OR contains(noun, ':ReligiousGroup')) THEN ':has_aspect'
     WHEN list_contains(ev, ':AttributeAndCharacteristic') AND r IN ('agent', 'experiencer') THEN ':has_context'
     WHEN list_contains(ev, ':Affiliation') THEN CASE WHEN r IN ('agent', 'experiencer', 'subject') THEN ':has_context' ELSE ':affiliated_with' END
     WHEN noun = ':Affiliation' THEN ':has_context'
     WHEN list_contains(ev, ':MovementTravelAndTransportation') AND r = 'theme' AND noun IN {_PLACE} THEN ':has_destination'
     WHEN list_has_any(ev, [':EmotionalResponse', ':SensoryPerception', ':AttributeAndCharacteristic', ':Cognition']) AND r = 'experiencer' THEN ':has_active_entity'
     WHEN r = 'location' AND noun NOT IN {_PLACE} THEN ':has_context'
     WHEN r = 'source' AND noun IN {_AGENT} THEN ':has_source'
     WHEN r = 'recipient' AND noun IN {_PLACE} THEN ':has_destination'
     WHEN r = 'patient' AND noun IN {_PLACE} THEN ':has_location'
     WHEN r = 'experiencer' AND noun NOT IN {_ANIMATE} THEN ':has_context'
     WHEN r = 'experiencer' AND NOT any_agent THEN ':has_active_entity'
     WHEN r = 'goal' AND noun IN {_ANIMATE} THEN ':has_affected_entity'
     WHEN r = 'goal' AND noun NOT IN {_PLACE} THEN ':has_context'
     ELSE CASE r {_MAP} END END AS predicate FROM y""",
)
def predicate_case(t):
    """All roles, with nouns and pairs of event classes that reach every rule; agents by the events of one user."""
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    key = F.col("event_id")
    x = t("events").select(key, "user_id", pick(_ROLES, key).alias("role"), pick(_NOUNS, F.floor(key / 5)).alias("noun"), F.array(pick(_EVENTS, F.floor(key / 3)), pick(_EVENTS, F.floor(key / 11))).alias("ev"), F.when(key % 2 == 0, F.col("props")).otherwise(F.col("event_type")).alias("text"))
    x = S.with_any_agent(x, "user_id")
    return x.select("event_id", S.predicate(F.col("role"), F.col("ev"), F.col("noun"), F.col("text"), F.col("any_agent")).alias("predicate"))


_KINDS = [":Avoidance", ":EventAndState", ":Affiliation", ":AssessmentMeasurement", ":AttributeAndCharacteristic", ":CommunicationAndSpeechAct", ":Win"]
_GONE = "({c} IN (':Avoidance', ':EventAndState') OR ({c} = ':Affiliation' AND {a}) OR ({c} = ':AssessmentMeasurement' AND {s}))"
_SURE = "(c1 = '{0}' AND k1 > 80)"
_SURE2 = "(c1 = '{0}' AND k1 > 80 OR NOT g2 AND c2 = '{0}' AND k2 > 80)"


@query(
    "secondary_suppress",
    f"""WITH x AS (SELECT event_id, {_list(_KINDS)}[event_id % 7 + 1] AS c1, {_list(_KINDS)}[event_id // 7 % 7 + 1] AS c2, {_list(_KINDS)}[event_id // 49 % 7 + 1] AS c3, 60 + event_id % 41 AS k1, 60 + event_id // 3 % 41 AS k2 FROM events),
    y AS (SELECT *, {_GONE.format(c='c2', a=_SURE.format(':AttributeAndCharacteristic'), s=_SURE.format(':CommunicationAndSpeechAct'))} AS g2 FROM x),
    z AS (SELECT *, {_GONE.format(c='c3', a=_SURE2.format(':AttributeAndCharacteristic'), s=_SURE2.format(':CommunicationAndSpeechAct'))} AS g3 FROM y)
    SELECT event_id, c1 || CASE WHEN g2 THEN '' ELSE '|' || c2 END || CASE WHEN g3 THEN '' ELSE '|' || c3 END AS kept FROM z""",
)
def secondary_suppress(t):
    """Three classes an event, with confidences on both sides of the bound."""
    key = F.col("event_id")
    pick = lambda k: F.get(F.array(*[F.lit(v) for v in _KINDS]), (k % 7).cast("int"))
    one = lambda c, k: F.struct(c.alias("class"), k.cast("int").alias("confidence"))
    classes = F.array(one(pick(key), 60 + key % 41), one(pick(F.floor(key / 7)), 60 + F.floor(key / 3) % 41), one(pick(F.floor(key / 49)), F.lit(90)))
    return t("events").select("event_id", F.array_join(F.transform(S.kept_classes(classes), lambda x: x["class"]), "|").alias("kept"))


@query("conf_gate", "SELECT event_type, count(*) FILTER (value > 20) AS above, count(*) FILTER (value >= 20) AS at_least FROM events GROUP BY 1")
def conf_gate(t):
    return t("events").groupBy("event_type").agg(F.count_if(F.col("value") > 20).alias("above"), F.count_if(F.col("value") >= 20).alias("at_least"))


_CUT = "CASE WHEN length(x) < 91 THEN x ELSE left(x, 90) || ' ...' END"


@query(
    "details_concat",
    f"SELECT conv_id, list_reduce(list_prepend('', list(text ORDER BY turn)), lambda a, x: CASE WHEN contains(a, x) THEN a WHEN a = '' THEN {_CUT} ELSE a || '; ' || {_CUT} END) AS details FROM conversations WHERE text IS NOT NULL GROUP BY 1",
)
def details_concat(t):
    """A conversation's texts in turn, each cut, without those that are part of what came before."""
    c = t("conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return c.select("conv_id", S.details_concatenated(F.transform("x", lambda y: y["text"])).alias("details"))


@query("enum_ordinals", "SELECT CAST(user_id % 15 AS INTEGER) AS ordinal, CASE WHEN user_id % 15 BETWEEN 1 AND 11 THEN ['" + "', '".join(V.SUBJECTS) + "'][user_id % 15] END AS label, count(*) AS n FROM events GROUP BY ALL")
def enum_ordinals(t):
    from loomgraph.functions.text import first_ordinal_text

    k = (F.col("user_id") % 15).cast("int")
    label = F.when(k > 0, first_ordinal_text(V.SUBJECTS, F.greatest(k, F.lit(1))))
    return t("events").groupBy(k.alias("ordinal"), label.alias("label")).agg(F.count("*").alias("n"))


@query("source_rollup", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def source_rollup(t):
    """Extension: totals by source and language."""
    return t("documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(t):
    li = t("lineitem").filter("l_shipdate <= timestamp'2000-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query(
    "topic_align",
    "WITH q AS (SELECT vec_id AS l, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT l, vec_id AS r, list_cosine_similarity(x, embedding::DOUBLE[]) AS score FROM q JOIN embeddings ON vec_id <> l) SELECT l AS \"left\", arg_max(r, round(score, 9) - r * 1e-15) AS \"right\", round(max(score), 6) AS score FROM s GROUP BY 1",
)
def topic_align(t):
    """Each topic of the stated query set (ids divisible by 20) with its nearest other topic by cosine."""
    v = t("embeddings")
    got = A.nearest(v.filter("vec_id % 20 = 0"), v, "vec_id", "embedding")
    return got.select("left", "right", F.round("score", 6).alias("score"))


_TOKENS = "list_sort(list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')))"


@query(
    "topic_compare",
    f"""WITH a AS (SELECT DISTINCT p_name || ' ' || p_type AS l FROM part WHERE p_partkey % 3 = 0), b AS (SELECT DISTINCT p_type || ' blue ' || string_split(p_name, ' ')[2] AS r FROM part WHERE p_partkey % 3 = 1),
    s AS (SELECT l, r, len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) AS score FROM (SELECT l, {_TOKENS.format('l')} AS x FROM a) JOIN (SELECT r, {_TOKENS.format('r')} AS y FROM b) ON list_has_any(x, y)),
    k AS (SELECT * FROM s WHERE score >= 0.5), bl AS (SELECT l, (list(r ORDER BY score DESC, r))[1] AS r FROM k GROUP BY 1), br AS (SELECT r, (list(l ORDER BY score DESC, l))[1] AS l FROM k GROUP BY 1),
    m AS (SELECT k.* FROM k JOIN bl ON k.l = bl.l AND k.r = bl.r JOIN br ON k.l = br.l AND k.r = br.r)
    SELECT a.l AS "left", b.r AS "right", round(score, 6) AS score FROM a LEFT JOIN m ON a.l = m.l FULL JOIN b ON m.r = b.r""",
)
def topic_compare(t):
    """Topics of two lists that are each other's best match by their words, and those of either list alone."""
    p = t("part")
    left = p.filter("p_partkey % 3 = 0").select(F.concat_ws(" ", "p_name", "p_type").alias("topic"))
    right = p.filter("p_partkey % 3 = 1").select(F.concat("p_type", F.lit(" blue "), F.element_at(F.split("p_name", " "), 2)).alias("topic"))
    return A.compared(left, right).select("left", "right", F.round("score", 6).alias("score"))


@query("stream_ingest_equiv", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_ingest_equiv(t):
    """All events through a file stream, in batches of some files, each file once; then their totals."""
    from loomgraph.operators.stored import shared_folder
    from loomgraph.streaming.ingest import ingest, totals

    events = t("events")
    place = f"{shared_folder(events.sparkSession)}/{uuid.uuid4().hex}"
    events.repartition(8, "event_id").write.parquet(f"{place}/in")
    stream = ingest(events.sparkSession, f"{place}/in", events.schema, lambda batch, number: batch.write.parquet(f"{place}/out/batch={number}"), f"{place}/checkpoint", files_per_trigger=4)
    stream.awaitTermination()
    return totals(events.sparkSession.read.schema(events.schema).parquet(f"{place}/out/*"))

"""Queries over what is known of entities: places, descriptions, labels, synonyms, corrections, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import vocab as V
from loomgraph.operators import classes as C
from loomgraph.operators import entities as E
from loomgraph.operators import narrative as N
from loomgraph.operators import providers as P
from loomgraph.operators import resolve as R
from loomgraph.operators import semantics as S
from loomgraph.operators.stored import large, stored
from loomgraph.plans.base import query
from loomgraph.sources import files

_GAZ = """g AS (SELECT 'Port ' || n_name AS toponym, 'Harbour ' || n_nationkey AS ascii, CASE n_nationkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'P' WHEN 2 THEN 'H' ELSE 'L' END AS feature,
 CASE n_nationkey % 5 WHEN 0 THEN 'ADM1' WHEN 1 THEN 'PPLA2' WHEN 2 THEN 'PCLI' WHEN 3 THEN 'PPL' ELSE 'ADM1' END AS code FROM nation UNION ALL SELECT r_name, r_name, 'A', 'PCLI' FROM region)"""
_ASKED = "q AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'port nation_' || (p_partkey % 30) WHEN 1 THEN 'Asia minor ' || (p_partkey % 3) WHEN 2 THEN 'ATION_' || (p_partkey % 9) WHEN 3 THEN 'Harbour ' || (p_partkey % 40) WHEN 4 THEN 'Europe' ELSE p_name END AS text FROM part)"


def gazetteer(t):
    k, n = F.col("n_nationkey"), t("nation")
    feature = F.when(k % 4 == 0, "A").when(k % 4 == 1, "P").when(k % 4 == 2, "H").otherwise("L")
    code = F.when(k % 5 == 0, "ADM1").when(k % 5 == 1, "PPLA2").when(k % 5 == 2, "PCLI").when(k % 5 == 3, "PPL").otherwise("ADM1")
    g = n.select(F.concat(F.lit("Port "), "n_name").alias("toponym"), F.concat(F.lit("Harbour "), k.cast("string")).alias("ascii"), feature.alias("feature"), code.alias("code"))
    return g.unionByName(t("region").select(F.col("r_name").alias("toponym"), F.col("r_name").alias("ascii"), F.lit("A").alias("feature"), F.lit("PCLI").alias("code")))


@query(
    "place_lookup",
    f"""WITH {_GAZ}, {_ASKED}, c AS (SELECT text, toponym, ascii, feature, code, lower(text) AS lt, lower(toponym) AS tt, CASE WHEN lower(text) = lower(toponym) THEN 1 WHEN starts_with(lower(text), lower(toponym)) THEN 2 WHEN contains(lower(toponym), lower(text)) OR contains(lower(ascii), lower(text)) THEN CASE WHEN code = 'ADM1' THEN 3 ELSE 4 END END AS rank FROM q, g),
    r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, CASE WHEN rank < 3 THEN -length(tt) ELSE 0 END, toponym, code) AS k FROM c WHERE rank IS NOT NULL)
    SELECT q.text, toponym, CASE WHEN toponym IS NULL THEN NULL WHEN feature = 'A' AND code LIKE 'ADM%' OR feature = 'P' AND code LIKE 'PPLA%' THEN ':PopulatedPlace, :AdministrativeDivision' WHEN feature = 'A' AND code LIKE 'PCL%' THEN ':Country' WHEN feature = 'H' THEN ':WaterFeature' WHEN feature = 'L' THEN ':DesignatedArea' ELSE ':PopulatedPlace' END AS "class",
     CASE WHEN toponym IS NULL THEN NULL WHEN feature = 'A' AND code LIKE 'ADM%' OR feature = 'P' AND code LIKE 'PPLA%' THEN CAST(regexp_extract(code, '[0-9]') AS INTEGER) ELSE 0 END AS admin_level FROM q LEFT JOIN r ON q.text = r.text AND k = 1""",
)
def place_lookup(t):
    """Names against a gazetteer: the same, its longest beginning, a first-order division that contains it, any place that does."""
    k = F.col("p_partkey")
    n = lambda m: (k % m).cast("string")
    said = F.when(k % 6 == 0, F.concat(F.lit("port nation_"), n(30))).when(k % 6 == 1, F.concat(F.lit("Asia minor "), n(3))).when(k % 6 == 2, F.concat(F.lit("ATION_"), n(9))).when(k % 6 == 3, F.concat(F.lit("Harbour "), n(40))).when(k % 6 == 4, "Europe").otherwise(F.col("p_name"))
    got = P.places(t("part").select(said.alias("text")).distinct(), gazetteer(t))
    there = F.col("toponym").isNotNull()
    return got.select("text", "toponym", F.when(there, P.feature_class(F.col("feature"), F.col("code"))).alias("class"), F.when(there, P.admin_division(F.col("feature"), F.col("code"))).alias("admin_level"))


_PAGES = """pages_ AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'United_States_' || n_name WHEN 1 THEN n_name ELSE 'Link_' || n_nationkey END AS title, CASE WHEN n_nationkey % 7 = 6 THEN 'disambiguation' ELSE 'standard' END AS type, 'About "' || n_name || '"' || chr(10) || 'é' AS extract, 'Q' || n_nationkey AS item FROM nation),
 inst AS (SELECT 'Q' || n_nationkey AS item, CASE n_nationkey % 4 WHEN 0 THEN 'Q5' WHEN 1 THEN 'Q43229' WHEN 2 THEN 'Q214339' ELSE 'Q1' END AS cls FROM nation)"""


@query(
    "description_lookup",
    f"""WITH {_PAGES}, q AS (SELECT DISTINCT 'NATION_' || (c_custkey % 30) AS noun, CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS ner_type, CASE WHEN c_custkey % 5 = 0 THEN 'https://en.wikipedia.org/wiki/Link_' || (c_custkey % 30) ELSE '' END AS link FROM customer),
    tries AS (SELECT *, unnest([0, 1, 2]) AS rank, unnest([string_split(link, '/')[-1], 'United_States_' || noun, noun]) AS title FROM q),
    hit AS (SELECT noun, ner_type, link, arg_min(item, rank) AS item, arg_min(type, rank) AS type, arg_min(extract, rank) AS extract FROM tries JOIN pages_ USING (title) WHERE title <> '' GROUP BY ALL),
    ok AS (SELECT hit.*, 'From Wikipedia (wikibase_item: ' || hit.item || '): ''' || replace(replace(replace(extract, '"', ''''), chr(10), ' '), 'é', '?') || '''' AS text FROM hit JOIN inst ON hit.item = inst.item WHERE type <> 'disambiguation' AND (ner_type = 'PERSON' AND cls IN ('Q5', 'Q214339') OR ner_type = 'ORG' AND cls = 'Q43229'))
    SELECT q.noun, q.ner_type, q.link, ok.item, ok.text FROM q LEFT JOIN ok ON q.noun = ok.noun AND q.ner_type = ok.ner_type AND q.link = ok.link""",
)
def description_lookup(t):
    """Pages by a link, by the name in the country or by the name, whose item must be of a class that fits the type."""
    n, key = t("nation"), F.col("n_nationkey")
    item = F.concat(F.lit("Q"), key.cast("string"))
    title = F.when(key % 3 == 0, F.concat(F.lit("United_States_"), "n_name")).when(key % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("Link_"), key.cast("string")))
    pages = n.select(title.alias("title"), F.when(key % 7 == 6, "disambiguation").otherwise("standard").alias("type"), F.concat(F.lit('About "'), "n_name", F.lit('"\né')).alias("extract"), F.lit("").alias("url"), item.alias("item"))
    instances = n.select(item.alias("item"), F.when(key % 4 == 0, "Q5").when(key % 4 == 1, "Q43229").when(key % 4 == 2, "Q214339").otherwise("Q1").alias("class"))
    labels = n.select(item.alias("item"), F.lit("en").alias("lang"), F.lit("label").alias("kind"), F.lit(0).alias("seq"), F.col("n_name").alias("value"))
    c = F.col("c_custkey")
    number = (c % 30).cast("string")
    asked = t("customer").select(F.concat(F.lit("NATION_"), number).alias("noun"), F.when(c % 2 == 0, "PERSON").otherwise("ORG").alias("ner_type"), F.when(c % 5 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/Link_"), number)).otherwise("").alias("link")).distinct()
    return E.described(asked, pages, instances, labels).select("noun", "ner_type", "link", F.col("description.item").alias("item"), F.col("description.text").alias("text"))


@query("label_sets", "SELECT item, list_filter(l, lambda x, i: list_position(l, x) = i) AS labels FROM (SELECT p_brand AS item, list_concat(list(p_name ORDER BY p_partkey) FILTER (p_size % 2 = 0), list(p_name ORDER BY p_partkey) FILTER (p_size % 2 = 1)) AS l FROM part GROUP BY 1)")
def label_sets(t):
    """Labels and aliases of items, in the order of languages, each once."""
    p = t("part").select(F.col("p_brand").alias("item"), F.when(F.col("p_size") % 2 == 0, "mul").otherwise("en").alias("lang"), F.lit("alias").alias("kind"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("value"))
    return E.labels_of(p)


@query("event_times", "SELECT user_id AS item, min(value) FILTER (event_type = 'click') AS begins, min(value) FILTER (event_type = 'view') AS ends FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def event_times(t):
    """Begin and end of items from their statements."""
    kind = F.when(F.col("event_type") == "click", "P580").when(F.col("event_type") == "view", "P582").otherwise("P31")
    return E.event_times(t("events").select(F.col("user_id").alias("item"), kind.alias("property"), "value"))


_KNOWN = "SELECT p_name AS term, 'label' AS kind, ':' || p_type AS cls FROM part UNION SELECT split_part(p_name, ' ', 2), 'noun', ':' || p_brand FROM part UNION SELECT lower(p_type), 'verb', ':' || p_brand FROM part"


@query("synonym_lookup", f"SELECT DISTINCT term, kind, cls AS \"class\" FROM ({_KNOWN}) WHERE term IN (SELECT unnest(string_split(lower(text), ' ')) FROM documents UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT lower(p_type) FROM part WHERE p_size > 20)")
def synonym_lookup(t):
    """Terms against the union of classes' labels, nouns and verbs."""
    p = t("part")
    col = lambda x: F.concat(F.lit(":"), x)
    known = p.select(F.col("p_name").alias("term"), F.lit("label").alias("kind"), col("p_type").alias("class")).unionByName(p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"), F.lit("noun").alias("kind"), col("p_brand").alias("class"))).unionByName(p.select(F.lower("p_type").alias("term"), F.lit("verb").alias("kind"), col("p_brand").alias("class")))
    words = t("documents").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    terms = words.unionByName(p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"))).unionByName(p.filter("p_size > 20").select(F.lower("p_type").alias("term")))
    return files.lookups(terms, known)


_SAID = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' of ' || p_type WHEN 2 THEN 'é' || p_name WHEN 3 THEN left(p_name, 3) WHEN 4 THEN p_name || ' people' ELSE 'a ' || p_name || ' in use' END"


def _said():
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    return F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" of "), "p_type")).when(k == 2, F.concat(F.lit("é"), n)).when(k == 3, F.left(n, F.lit(3))).when(k == 4, F.concat(n, F.lit(" people"))).otherwise(F.concat(F.lit("a "), n, F.lit(" in use")))


@query("label_hygiene", f"SELECT p_partkey, label FROM (SELECT p_partkey, {_SAID} AS label, CASE WHEN p_size % 3 = 0 THEN 'fr' ELSE 'en' END AS lang FROM part) WHERE lang = 'en' AND length(label) > 3 AND regexp_full_match(label, '[ -~]*') AND NOT contains(label, ' of ') AND NOT contains(label, ' in ') AND NOT contains(label, ' people') AND NOT contains(label, ' culture')")
def label_hygiene(t):
    rows = t("part").select("p_partkey", _said().alias("label"), F.when(F.col("p_size") % 3 == 0, "fr").otherwise("en").alias("lang"))
    return files.clean_labels(rows).select("p_partkey", "label")


@query("phrase_terms", f"SELECT DISTINCT term FROM (SELECT {_SAID} AS term, p_type FROM part) WHERE length(term) - length(replace(term, ' ', '')) > 1 AND regexp_matches(term, '^[a-zé]') AND NOT contains(term, '(') AND NOT contains(term, 'blue')")
def phrase_terms(t):
    """Terms of more than two words, without a part."""
    return files.without_part(files.phrases(t("part").select(_said().alias("term")).distinct()), "term", "blue")


@query("names_by_type", "SELECT n_name AS ner_type, list_sort(list_distinct(list(c_mktsegment))) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def names_by_type(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return E.by_type(c.select(F.col("n_name").alias("ner_type"), F.col("c_mktsegment").alias("text")))


@query("values_by_key", "SELECT o_custkey AS key, list(o_orderpriority ORDER BY o_orderkey) AS \"values\" FROM orders GROUP BY 1")
def values_by_key(t):
    """A multimap: every key with its values in order."""
    return E.multimap(t("orders").select(F.col("o_custkey").alias("key"), "o_orderpriority", "o_orderkey"), "key", "o_orderpriority", "o_orderkey")


@query("last_value_wins", "SELECT o_custkey AS key, arg_max(o_orderkey, o_orderkey) FILTER (o_orderpriority LIKE '1%') AS urgent, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def last_value_wins(t):
    """Dictionaries built from pairs: of equal keys the last one counts."""
    o = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    m = T.last_wins(F.transform("x", lambda x: F.struct(x["o_orderpriority"].alias("key"), x["o_orderkey"].alias("value"))))
    first = F.map_filter(m, lambda k, v: k.startswith("1"))
    return o.select("key", F.try_element_at(F.map_values(first), F.lit(1)).alias("urgent"), F.size(m).cast("long").alias("n"))


_TYPES = ["PERSON", "TIME", "GPE", "CARDINAL", "WORK_OF_ART", "DATE"]


@query("ner_whitelist", "SELECT o_orderkey, string_agg(k, '|' ORDER BY i) AS kinds FROM (SELECT o_orderkey, unnest([['PERSON', 'TIME', 'GPE', 'CARDINAL', 'WORK_OF_ART', 'DATE'][o_orderkey % 6 + 1], ['PERSON', 'TIME', 'GPE', 'CARDINAL', 'WORK_OF_ART', 'DATE'][o_custkey % 6 + 1]]) AS k, unnest([1, 2]) AS i FROM orders) WHERE k NOT IN ('TIME', 'CARDINAL') GROUP BY 1")
def ner_whitelist(t):
    pick = lambda k: F.struct(F.lit("x").alias("text"), F.get(F.array(*[F.lit(x) for x in _TYPES]), (k % 6).cast("int")).alias("ner_type"))
    kept = S.whitelisted(F.array(pick(F.col("o_orderkey")), pick(F.col("o_custkey"))))
    return t("orders").select("o_orderkey", F.array_join(F.transform(kept, lambda e: e["ner_type"]), "|").alias("kinds")).filter("kinds <> ''")


@query(
    "preload_corrections",
    """WITH a AS (SELECT 0 AS rank, ':m' || n_nationkey AS s, CASE n_nationkey % 3 WHEN 0 THEN ':Person' WHEN 1 THEN ':Nothing' ELSE ':PoliticalGroup' END AS type, n_name AS label FROM nation UNION ALL SELECT 1, ':c' || r_regionkey, ':GeopoliticalEntity', 'NATION_' || r_regionkey FROM region UNION ALL SELECT 1, ':x' || r_regionkey, ':Law', 'NATION_' || (r_regionkey + 7) FROM region)
    SELECT label, arg_max(s, rank) AS iri, arg_max(type, rank) AS "class", arg_max(CASE type WHEN ':Person' THEN 'PERSON' WHEN ':GeopoliticalEntity' THEN 'GPE' ELSE type END, rank) AS ner_type FROM a WHERE type NOT IN (':Nothing', ':Law') GROUP BY 1""",
)
def preload_corrections(t):
    """Known names: a repository's entry hides the server's; types without an entity type are left out."""
    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    manual = t("nation").select(F.concat(F.lit(":m"), k.cast("string")).alias("s"), F.when(k % 3 == 0, ":Person").when(k % 3 == 1, ":Nothing").otherwise(":PoliticalGroup").alias("type"), F.col("n_name").alias("label"))
    name = lambda x: F.concat(F.lit("NATION_"), x.cast("string"))
    own = t("region").select(F.concat(F.lit(":c"), r.cast("string")).alias("s"), F.lit(":GeopoliticalEntity").alias("type"), name(r).alias("label"))
    own = own.unionByName(t("region").select(F.concat(F.lit(":x"), r.cast("string")).alias("s"), F.lit(":Law").alias("type"), name(r + 7).alias("label")))
    return N.preloaded(manual, own).select("label", "iri", "class", "ner_type")


@query(
    "kg_entities",
    """WITH p AS (SELECT ':c' || c_custkey AS s, c_name, c_mktsegment, c_custkey FROM customer), g AS (SELECT ':n' || n_nationkey AS s, n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), o AS (SELECT ':s' || s_suppkey AS s, s_name, s_suppkey FROM supplier), all_ AS (
     SELECT s, unnest([':text', 'rdf:type', 'rdf:type', 'rdfs:label', 'rdfs:label']) AS p, unnest([c_name, ':Person', ':Correction', c_name, c_mktsegment]) AS o FROM p
     UNION ALL SELECT s, ':gender', CASE c_custkey % 3 WHEN 0 THEN 'female' ELSE 'male' END FROM p WHERE c_custkey % 3 < 2
     UNION ALL SELECT s, unnest(['rdfs:comment', ':external_link', ':external_identifier']), unnest(['about ' || c_name, 'u/' || c_custkey, 'Q' || c_custkey]) FROM p WHERE c_custkey % 4 = 0
     UNION ALL SELECT s, unnest([':text', 'rdf:type', 'rdf:type', 'rdf:type', 'rdf:type', 'rdfs:label', 'rdfs:label', ':country_name']), unnest([n_name, ':PopulatedPlace', ':AdministrativeDivision', ':GeopoliticalEntity', ':Correction', n_name, 'Old ' || n_name, r_name]) FROM g
     UNION ALL SELECT s, ':admin_level', CAST(n_nationkey % 3 AS VARCHAR) FROM g WHERE n_nationkey % 3 > 0
     UNION ALL SELECT 'geo:' || r_name, ':has_component', s FROM g WHERE r_name <> 'ASIA'
     UNION ALL SELECT s, ':text', s_name FROM o
     UNION ALL SELECT s, unnest(['rdf:type', 'rdfs:label', ':has_beginning']), unnest([':EventAndState', s_name, ':PiT_19' || (10 + s_suppkey % 90)]) FROM o WHERE s_suppkey % 2 = 0)
    SELECT DISTINCT s, p, o FROM all_""",
)
def kg_entities(t):
    """Entities as triples: persons with genders and descriptions, places with levels and countries, events with times;
    an owl:Thing has its text only."""
    no = lambda kind: F.lit(None).cast(kind)
    place, about = "struct<class: string, country: string, admin_level: int, names: array<string>, link: string>", "struct<text: string, url: string, item: string, labels: array<string>>"

    def rows(df, iri, name, ner, kind, labels, gender=None, begins=None, location=None, description=None):
        none = no("string")
        return df.select(iri.alias("iri"), name.alias("name"), F.lit(ner).alias("ner_type"), F.lit(ner).alias("base"), kind.alias("class"), labels.alias("labels"), (gender if gender is not None else none).alias("gender"), (begins if begins is not None else none).alias("begins"), none.alias("ends"), (location if location is not None else no(place)).cast(place).alias("location"), (description if description is not None else no(about)).cast(about).alias("description"))

    c, k = F.col("c_custkey"), F.col("n_nationkey")
    told = F.when(c % 4 == 0, F.struct(F.concat(F.lit("about "), "c_name").alias("text"), F.concat(F.lit("u/"), c.cast("string")).alias("url"), F.concat(F.lit("Q"), c.cast("string")).alias("item"), E.no_names().alias("labels")))
    people = rows(t("customer"), F.concat(F.lit(":c"), c.cast("string")), F.col("c_name"), "PERSON", F.lit(":Person, :Correction"), F.array("c_name", F.concat(F.lit("the "), "c_mktsegment")), F.when(c % 3 == 0, "FEMALE").when(c % 3 == 1, "MALE").otherwise(""), description=told)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spot = F.struct(F.lit(":PopulatedPlace, :AdministrativeDivision").alias("class"), F.col("r_name").alias("country"), (k % 3).cast("int").alias("admin_level"), F.array("n_name").alias("names"), F.lit("").alias("link"))
    places = rows(n, F.concat(F.lit(":n"), k.cast("string")), F.col("n_name"), "GPE", F.lit(":GeopoliticalEntity, :Correction"), F.array("n_name", F.concat(F.lit("Old "), "n_name")), location=spot)
    s = F.col("s_suppkey")
    kind = F.when(s % 2 == 0, ":EventAndState").otherwise("owl:Thing")
    happened = rows(t("supplier"), F.concat(F.lit(":s"), s.cast("string")), F.col("s_name"), "EVENT", kind, F.array("s_name"), begins=F.concat(F.lit("19"), (10 + s % 90).cast("string")))
    geo = t("region").filter("r_name <> 'ASIA'").select(F.col("r_name").alias("name"), F.concat(F.lit("geo:"), "r_name").alias("iri"))
    return E.entity_quads(people.unionByName(places).unionByName(happened), F.lit("w"), F.lit("w_default"), geo).select("s", "p", "o")


_TAG = "SELECT s, '{p}' AS p, {labels}[{k}] AS o FROM n WHERE {k} BETWEEN 1 AND {n}"


def _tags():
    parts = []
    for p, k, labels in ((":subject_area", "doc_id % 14", V.SUBJECTS), (":narrative_goal", "doc_id % 11", V.GOALS), (":information_flow", "doc_id % 17", V.FLOWS), (":narrative_plotline", "doc_id % 10", V.PLOTLINES)):
        parts.append(_TAG.format(p=p, k=f"({k})", n=len(labels), labels="['" + "', '".join(labels) + "']"))
    return " UNION ALL ".join(parts)


@query(
    "narrative_metadata",
    f"""WITH n AS (SELECT *, ':Narrative_' || doc_id AS s FROM documents) SELECT * FROM (SELECT s, unnest(['rdf:type', 'dc:title', ':source', ':text', ':number_sentences', ':external_link', ':summary']) AS p, unnest([':Narrative', lang || ' text', source, text, CAST(n_chars AS VARCHAR), 'not defined', 'sum ' || doc_id]) AS o FROM n
    UNION ALL {_tags()} UNION ALL SELECT s, unnest([':topic', ':topic']), unnest(['t' || doc_id % 5, 'u']) FROM n UNION ALL SELECT s, ':interpretation_liberal', 'r' FROM n WHERE doc_id % 2 = 0 UNION ALL SELECT s, unnest([':sentiment', ':sentiment_explanation']), unnest(['negative', 'e']) FROM n WHERE doc_id % 3 = 0) WHERE o IS NOT NULL""",
)
def narrative_metadata(t):
    """Metadata of narratives with an answer each: ordinals outside of the vocabularies are left out."""
    d, k = t("documents"), F.col("doc_id")
    one = lambda m: F.array((k % m).cast("int"))
    react = F.when(k % 2 == 0, F.array(F.struct(F.lit("liberal").alias("perspective"), F.lit("r").alias("reaction"))))
    answer = F.struct(
        one(14).alias("subject_areas"), one(11).alias("goal_numbers"), one(17).alias("information_flows"), one(10).alias("plotlines"), F.array(F.concat(F.lit("t"), (k % 5).cast("string")), F.lit("u")).alias("topics"), F.concat(F.lit("sum "), k.cast("string")).alias("summary"),
        react.alias("reader_reactions"), F.when(k % 3 == 0, "negative").alias("sentiment"), F.lit("e").alias("sentiment_explanation"),
    )
    n = d.select(k.cast("string").alias("narrative_id"), F.concat("lang", F.lit(" text")).alias("title"), "source", F.lit(None).cast("string").alias("published"), F.lit("not defined").alias("url"), "text", F.col("n_chars").alias("sentences"), answer.alias("answer"))
    return N.metadata_quads(n, "w").select("s", "p", "o")


@query(
    "name_places",
    r"""WITH w AS (SELECT regexp_extract_all(text, '[\pL\pN_#]+') AS w FROM benchmark),
    n AS (SELECT DISTINCT array_to_string(w[a:b], ' ') AS name FROM w, (VALUES (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4)) AS x(a, b) WHERE len(w) >= b),
    p AS (SELECT string_agg(regexp_replace(name, '([\pL\pN_#]+)', chr(1) || '\1' || chr(1), 'g'), '|' ORDER BY length(name) DESC, name) AS pattern FROM n),
    l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    f AS (SELECT unnest(regexp_extract_all(regexp_replace(line, '([\pL\pN_#]+)', chr(1) || '\1' || chr(1), 'g'), pattern)) AS found FROM l, p)
    SELECT replace(found, chr(1), '') AS name, count(*) AS n FROM f GROUP BY 1""",
)
def name_places(t):
    """How often the lines of all documents hold each name, of names inside of others the longest: words 1 to 3 and 2 to 4 of
    the benchmark's items, and their beginnings."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_#]+"), F.lit(0))
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4))])
    names = t("benchmark").select(words.alias("w")).select("w", F.explode(spans).alias("x")).filter(F.size("w") >= F.col("x.b"))
    names = names.select(F.array_join(F.slice("w", F.col("x.a"), F.col("x.b") - F.col("x.a") + 1), " ").alias("name"), F.lit("THING").alias("ner_type")).distinct()
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).select(F.struct("doc_id", "line").alias("key"), "text")
    return P.Lexicon(names).entities(lines).groupBy("name").agg(F.count("*").alias("n"))


@query(
    "names_known_then",
    """WITH b AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS best FROM orders GROUP BY 1, 2),
    k AS (SELECT o_custkey, o_orderdate, max(best) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM b)
    SELECT o_orderkey, ':' || lpad(CAST(best AS VARCHAR), 12, '0') AS iri, CAST(CASE WHEN best IS NULL THEN 5 ELSE 2 END AS INTEGER) AS priority FROM orders JOIN k USING (o_custkey, o_orderdate)""",
)
def names_known_then(t):
    """A customer's name means the greatest of the customer's orders of earlier days: names that are defined while narratives
    come, each mention resolved by what was known at its day."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 12, "0"))
    o = t("orders").select("o_orderkey", F.concat(F.lit(":"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("s"), name.alias("mention"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    said = F.array(*[F.struct(F.lit(p).alias("p"), c.alias("o")) for p, c in (("rdf:type", F.lit(":Person")), ("rdf:type", F.lit(":Correction")), ("rdfs:label", F.col("mention")))])
    none = o.sparkSession.createDataFrame([], "s string, type string, label string, p string, o string")
    known = N.Known(none.select("s", "type", "label"), none.select("s", "p", "o"))
    versions = stored(known.versions(o.select("s", F.explode(said).alias("f"), "at").select("s", "f.p", "f.o", "at")))  # several joins read it
    return o.join(large(R.resolved(o.select("mention", "at"), versions)), ["mention", "at"]).select("o_orderkey", "iri", "priority")


_WORD = "string_split(p_name, ' ')[2]"


@query(
    "term_votes",
    f"""WITH k AS (SELECT p_name AS term, p_type AS "class" FROM part WHERE p_size < 5 UNION SELECT {_WORD}, p_brand FROM part),
    w AS (SELECT term, "class", (5040 * len(string_split(term, ' '))) // count(*) OVER (PARTITION BY term) AS weight FROM k),
    f AS (SELECT p_partkey, CASE WHEN p_name IN (SELECT term FROM k) THEN p_name ELSE {_WORD} END AS term FROM part UNION ALL SELECT p_partkey, {_WORD} FROM part),
    v AS (SELECT p_partkey, "class", sum(weight) AS votes FROM f JOIN w USING (term) GROUP BY ALL)
    SELECT p_partkey, "class", CAST(votes AS BIGINT) AS votes, CAST((100 * votes) // sum(votes) OVER (PARTITION BY p_partkey) AS INTEGER) AS confidence, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY votes DESC, "class") AS INTEGER) AS rank FROM v""",
)
def term_votes(t):
    """Classes of a text by the terms in it: the longest ones, in the plural and in other case too."""
    p, word = t("part"), F.element_at(F.split("p_name", " "), 2)
    known = p.filter("p_size < 5").select(F.col("p_name").alias("term"), F.col("p_type").alias("class")).unionByName(p.select(word.alias("term"), F.col("p_brand").alias("class")))
    text = F.concat(F.lit("Two "), "p_name", F.lit("s beside a "), F.upper(word))
    return C.voted(p.select(F.col("p_partkey").alias("key"), text.alias("text")), known.withColumn("kind", F.lit("noun"))).withColumnRenamed("key", "p_partkey")

"""Queries over the quad store, made of the relational tables, and over hierarchies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as H
from loomgraph.operators import quads as Q
from loomgraph.operators.stored import shared_folder
from loomgraph.plans.base import query

KG = """kg AS (
 SELECT 'world' AS repo, 'world_default' AS graph, 'region:' || r_regionkey AS s, p, o, k AS o_kind FROM (SELECT r_regionkey, unnest(['rdf:type', 'rdfs:label']) AS p, unnest([':Location', r_name]) AS o, unnest(['iri', 'lit']) AS k FROM region)
 UNION ALL
 SELECT 'world', 'world_' || r_name, 'nation:' || n_nationkey, p, o, k FROM (SELECT n_nationkey, r_name, unnest(['rdf:type', 'rdfs:label', ':in_region']) AS p, unnest([':GeopoliticalEntity', n_name, 'region:' || n_regionkey]) AS o, unnest(['iri', 'lit', 'iri']) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
 UNION ALL
 SELECT 'world', 'world_' || c_mktsegment, 'customer:' || c_custkey, p, o, k FROM (SELECT c_custkey, c_mktsegment, unnest(['rdf:type', 'rdfs:label', ':lives_in']) AS p, unnest([':Person', c_name, 'nation:' || c_nationkey]) AS o, unnest(['iri', 'lit', 'iri']) AS k FROM customer))"""
EDGES = """edges AS (
 SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation
 UNION ALL SELECT 'region:' || r_regionkey, 'world' FROM region
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""
CLOSED = f"""WITH RECURSIVE {EDGES}, walk AS (
 SELECT child, parent AS ancestor, 1 AS depth FROM edges
 UNION ALL SELECT w.child, e.parent, w.depth + 1 FROM walk w JOIN edges e ON w.ancestor = e.child),
 closed AS (SELECT child, ancestor, min(depth) AS depth FROM (SELECT * FROM walk UNION ALL SELECT c, c, 0 FROM (SELECT child AS c FROM edges UNION SELECT parent FROM edges)) GROUP BY ALL)"""
_ALL = "repo, graph, s, p, o, o_kind"


def key(name, column):
    return F.concat(F.lit(f"{name}:"), F.col(column).cast("string"))


def world(t):
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda c: F.concat(F.lit("world_"), c)
    w = F.lit("world")
    return (
        Q.triplify(t("region"), key("region", "r_regionkey"), w, F.lit("world_default"), **{"rdf:type": (F.lit(":Location"), "iri"), "rdfs:label": (F.col("r_name"), "lit")})
        .unionByName(Q.triplify(nation, key("nation", "n_nationkey"), w, one(F.col("r_name")), **{"rdf:type": (F.lit(":GeopoliticalEntity"), "iri"), "rdfs:label": (F.col("n_name"), "lit"), ":in_region": (key("region", "n_regionkey"), "iri")}))
        .unionByName(Q.triplify(t("customer"), key("customer", "c_custkey"), w, one(F.col("c_mktsegment")), **{"rdf:type": (F.lit(":Person"), "iri"), "rdfs:label": (F.col("c_name"), "lit"), ":lives_in": (key("nation", "c_nationkey"), "iri")}))
    )


def shown(q):
    return q.select("repo", "graph", "s", "p", "o", "o_kind")


def edges(t):
    a = t("nation").select(key("nation", "n_nationkey").alias("child"), key("region", "n_regionkey").alias("parent"))
    b = t("region").select(key("region", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    c = t("supplier").select(key("supplier", "s_suppkey").alias("child"), key("nation", "s_nationkey").alias("parent"))
    return a.unionByName(b).unionByName(c)


@query("kg_triplify", f"WITH {KG} SELECT {_ALL} FROM kg")
def kg_triplify(t):
    return shown(world(t))


@query("kg_count_triples", f"WITH {KG} SELECT count(*) AS cnt FROM kg WHERE graph = 'world_default'")
def kg_count_triples(t):
    return world(t).filter("graph = 'world_default'").agg(F.count("*").alias("cnt"))


@query("kg_count_by_graph", f"WITH {KG} SELECT graph, count(*) AS cnt FROM kg GROUP BY 1")
def kg_count_by_graph(t):
    return Q.triple_counts(world(t))


@query("kg_repo_graphs", f"WITH {KG} SELECT DISTINCT graph FROM kg WHERE repo = 'world'")
def kg_repo_graphs(t):
    """Graphs of one repository; one whose name begins alike has its own."""
    w = world(t)
    return Q.repo_graphs(w.unionByName(w.withColumn("repo", F.lit("world_b")).withColumn("graph", F.replace("graph", F.lit("world_"), F.lit("world_b_")))), "world")


@query("kg_construct_sorted", f"WITH {KG} SELECT s || ' ' || p || ' ' || CASE WHEN o_kind = 'iri' THEN o ELSE '\"' || o || '\"' END || ' .' AS line FROM kg WHERE graph = 'world_ASIA' ORDER BY line")
def kg_construct_sorted(t):
    return Q.serialised(world(t).filter("graph = 'world_ASIA'"))


_ESC = "text"
for _old, _new in (("chr(92)", "chr(92) || chr(92)"), ("'\"'", "chr(92) || '\"'"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'")):
    _ESC = f"replace({_ESC}, {_old}, {_new})"


@query("kg_export_escaped", f"SELECT ':d' || doc_id || ' :text \"' || {_ESC} || '\"' || CASE doc_id % 3 WHEN 0 THEN '@' || lang WHEN 1 THEN '^^xsd:string' ELSE '' END || ' .' AS line FROM documents WHERE text IS NOT NULL")
def kg_export_escaped(t):
    """Texts with quotes, backslashes and line ends as literals, with a language, a type or neither."""
    d = t("documents").filter("text is not null")
    lang, kind = F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 1, "xsd:string")
    q = d.select(F.lit("w").alias("repo"), F.lit("w_g").alias("graph"), F.concat(F.lit(":d"), F.col("doc_id").cast("string")).alias("s"), F.lit(":text").alias("p"), F.col("text").alias("o"), F.lit("lit").alias("o_kind"), kind.alias("o_type"), lang.alias("o_lang"))
    return Q.serialised(Q.quads(q))


@query("kg_add_dedupe", f"WITH {KG} SELECT {_ALL} FROM kg WHERE graph LIKE 'world_A%' UNION SELECT {_ALL} FROM kg WHERE graph IN ('world_ASIA', 'world_EUROPE')")
def kg_add_dedupe(t):
    g = world(t)
    return shown(Q.added(g.filter("graph like 'world_A%'"), g.filter("graph in ('world_ASIA', 'world_EUROPE')")))


@query("kg_remove", f"WITH {KG} SELECT {_ALL} FROM kg WHERE NOT (p = 'rdfs:label' AND graph = 'world_ASIA')")
def kg_remove(t):
    g = world(t)
    return shown(Q.removed(g, g.filter("p = 'rdfs:label' and graph = 'world_ASIA'")))


@query("kg_clear", f"WITH {KG} SELECT {_ALL} FROM kg WHERE graph <> 'world_EUROPE'")
def kg_clear(t):
    return shown(Q.cleared(world(t), "world", "world_EUROPE"))


@query("kg_replace", f"WITH {KG} SELECT {_ALL} FROM kg WHERE graph <> 'world_EUROPE' UNION SELECT repo, 'world_EUROPE', s, p, o, o_kind FROM kg WHERE graph = 'world_ASIA'")
def kg_replace(t):
    g = world(t)
    return shown(Q.replaced(g, "world", "world_EUROPE", g.filter("graph = 'world_ASIA'")))


@query("kg_delete_entity", f"WITH {KG}, gone AS (SELECT graph, s FROM kg GROUP BY ALL HAVING bool_or(p = 'rdf:type' AND o = ':GeopoliticalEntity') AND bool_or(p = 'rdfs:label' AND o = 'NATION_3')) SELECT {_ALL} FROM kg WHERE (graph, s) NOT IN (SELECT graph, s FROM gone)")
def kg_delete_entity(t):
    g = world(t)
    return shown(Q.without_subjects(g, Q.subjects(g, **{"rdf:type": ":GeopoliticalEntity", "rdfs:label": "NATION_3"})))


_META = "meta AS (SELECT 'world' AS repo, 'world_default' AS graph, unnest([':' || doc_id, ':' || doc_id, ':Narrative_' || doc_id]) AS s, unnest(['rdf:type', ':encodes', ':source']) AS p, unnest([':InformationGraph', ':Narrative_' || doc_id, source]) AS o, unnest(['iri', 'iri', 'lit']) AS o_kind FROM documents)"


def metadata(t):
    d, w, g = t("documents"), F.lit("world"), F.lit("world_default")
    n = F.concat(F.lit(":Narrative_"), F.col("doc_id").cast("string"))
    a = Q.triplify(d, F.concat(F.lit(":"), F.col("doc_id").cast("string")), w, g, **{"rdf:type": (F.lit(":InformationGraph"), "iri"), ":encodes": (n, "iri")})
    return a.unionByName(Q.triplify(d, n, w, g, **{":source": (F.col("source"), "lit")}))


@query("kg_delete_narrative", f"WITH {_META} SELECT {_ALL} FROM meta WHERE s NOT IN (':7', ':Narrative_7')")
def kg_delete_narrative(t):
    return shown(Q.without_narrative(metadata(t), "7"))


@query("kg_star", f"WITH {KG} SELECT graph, s, max(o) FILTER (p = 'rdfs:label') AS label, max(o) FILTER (p = ':lives_in') AS nation FROM kg GROUP BY ALL HAVING bool_or(p = 'rdfs:label') AND bool_or(p = ':lives_in')")
def kg_star(t):
    return Q.star(world(t), label="rdfs:label", nation=":lives_in").select("graph", "s", "label", "nation")


@query("kg_existence", f"WITH {KG} SELECT EXISTS (SELECT 1 FROM kg WHERE graph = 'world_ASIA') AS graph_exists, EXISTS (SELECT 1 FROM kg WHERE graph = 'world_MARS') AS other_exists")
def kg_existence(t):
    return world(t).agg(F.coalesce(F.bool_or(F.col("graph") == "world_ASIA"), F.lit(False)).alias("graph_exists"), F.coalesce(F.bool_or(F.col("graph") == "world_MARS"), F.lit(False)).alias("other_exists"))


@query("bg_types_union", "SELECT c_name AS name, 'person' AS type, true AS plural FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_name, 'person', NULL FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT p_name, 'thing', NULL FROM part UNION ALL SELECT s_name, 'organization', NULL FROM supplier UNION ALL SELECT n_name, 'place', NULL FROM nation")
def bg_types_union(t):
    no = F.lit(None).cast("boolean").alias("plural")
    c = t("customer").select(F.col("c_name").alias("name"), F.lit("person").alias("type"), F.when(F.col("c_custkey") % 5 == 0, True).alias("plural"))
    for table, name, kind in (("part", "p_name", "thing"), ("supplier", "s_name", "organization"), ("nation", "n_name", "place")):
        c = c.unionByName(t(table).select(F.col(name).alias("name"), F.lit(kind).alias("type"), no))
    return c


@query("class_closure", f"{CLOSED} SELECT child, ancestor, CAST(depth AS INTEGER) AS depth FROM closed")
def class_closure(t):
    return H.closure(edges(t))


@query("class_roots", f'WITH {EDGES} SELECT DISTINCT parent AS "class" FROM edges WHERE parent NOT IN (SELECT child FROM edges)')
def class_roots(t):
    return H.roots(edges(t))


@query("class_nearest_mapped", f"{CLOSED}, m AS (SELECT 'region:' || r_regionkey AS c, r_name AS mapping FROM region UNION ALL SELECT 'world', 'WORLD') SELECT child, min_by(mapping, depth) AS mapping FROM closed JOIN m ON ancestor = c GROUP BY 1")
def class_nearest_mapped(t):
    m = t("region").select(key("region", "r_regionkey").alias("class"), F.col("r_name").alias("mapping"))
    m = m.unionByName(m.sparkSession.createDataFrame([("world", "WORLD")], "class string, mapping string"))
    return H.nearest_mapped(H.closure(edges(t)), m)


@query(
    "agent_closure_counts",
    f"{CLOSED} SELECT n_name AS agent, count(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE 'nation:' || n_nationkey IN (SELECT child FROM closed WHERE ancestor = 'region:2') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < -900) GROUP BY 1 ORDER BY cnt DESC, agent",
)
def agent_closure_counts(t):
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("class", key("nation", "n_nationkey"))
    people = H.in_class(people, "class", H.closure(edges(t)), "region:2")
    people = people.join(t("supplier").filter("s_acctbal < -900"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti")
    got = t("orders").select("o_custkey").join(people.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    return got.groupBy(F.col("n_name").alias("agent")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "agent")


@query("instance_of", f"{CLOSED} SELECT DISTINCT c_custkey AS item FROM customer JOIN closed ON child = 'nation:' || c_nationkey WHERE ancestor IN ('region:1', 'region:3')")
def instance_of(t):
    facts = t("customer").select(F.col("c_custkey").alias("item"), key("nation", "c_nationkey").alias("class"))
    return H.is_instance(facts, H.closure(edges(t)), ["region:1", "region:3"])


_STORY = r"""WITH s AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS k, unnest(x) AS text FROM (SELECT doc_id, {0} AS x FROM documents WHERE text IS NOT NULL)),
 r AS (SELECT doc_id, k, {1} AS text FROM s), n AS (SELECT *, len(string_split(text, ' ')) AS w FROM r)
 SELECT p, count(*) AS cnt FROM (SELECT unnest([':has_component', 'rdf:type', ':offset', ':text', ':grade_level']) AS p FROM n
  UNION ALL SELECT unnest([':rhetorical_device', ':rhetorical_device_' || replace({2}[w % 16], ' ', '_')]) FROM n WHERE w % 16 BETWEEN 1 AND 13) GROUP BY 1"""


def _story_sql():
    from loomgraph.functions.vocab import DEVICES
    from loomgraph.plans.texts import _HY, _REP, NORM, SENTS

    return _STORY.format(SENTS.format(NORM), _HY.format(_HY.format(_REP.format("text"))), "['" + "', '".join(DEVICES) + "']")


@query("narrative_graph", _story_sql())
def narrative_graph(t):
    """Triples of the graphs of all documents by predicate, from recorded annotations of their sentences: a grade
    and a rhetorical device by the number of words, of which some are no device."""
    from loomgraph.functions import text as T
    from loomgraph.operators import narrative as N
    from loomgraph.operators.entities import Knowledge
    from loomgraph.operators.providers import Recorded
    from loomgraph.operators.stored import stored

    n = t("documents").select(F.col("doc_id").cast("string").alias("narrative_id"), "text")
    said = n.select(F.explode(T.sentences(T.normalised(F.col("text")))).alias("text")).select(T.repaired(F.col("text")).alias("text"))
    words = F.size(F.split("text", " "))
    reply = F.to_json(F.struct(words.alias("grade_level"), F.array(F.struct((words % 16).alias("device_number"), F.lit("by its words").alias("explanation"))).alias("rhetorical_devices")))
    recorded = Recorded(stored(said.select(F.lit("sentence").alias("kind"), F.sha2("text", 256).alias("digest"), reply.alias("reply"))))
    none = n.sparkSession.createDataFrame([], "label string, iri string, ner_type string, seq long")
    made = N.create_graphs(n, "stories", recorded, none, Knowledge(n.sparkSession))
    return made.graphs.groupBy("p").agg(F.count("*").alias("cnt"))


@query("chain_first_next", "SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS is_first, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def chain_first_next(t):
    from loomgraph.operators.semantics import chained

    return chained(t("conversations").select("conv_id", "turn"), "conv_id", "turn", "turn").select("conv_id", "turn", "is_first", "next")


@query("chain_walk", "SELECT conv_id AS owner, conv_id || '/' || turn AS node, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS seq FROM conversations")
def chain_walk(t):
    from loomgraph.operators.semantics import chained

    c = chained(t("conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")
    name = lambda x: F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col(x).cast("string"))
    first = c.filter("is_first").select(F.col("conv_id").alias("owner"), name("turn").alias("node"))
    return H.linked_list(first, c.filter("next is not null").select(name("turn").alias("node"), name("next").alias("next"))).select("owner", "node", "seq")


@query(
    "kg_store_log",
    f"""WITH {KG}, x AS (SELECT {_ALL} FROM kg WHERE graph <> 'world_EUROPE' AND NOT (p = 'rdfs:label' AND graph = 'world_ASIA') UNION SELECT repo, 'world_EUROPE', s, p, o, o_kind FROM kg WHERE graph = 'world_AFRICA'
     UNION SELECT {_ALL} FROM kg WHERE graph = 'world_ASIA' AND s = 'nation:8')
    SELECT * FROM x""",
)
def kg_store_log(t):
    """A stored table after commits: all added, twice some of it, a graph replaced, quads deleted and some added again."""
    g = world(t)
    spark = g.sparkSession
    store = Q.QuadTable(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    store.add("world", g)
    store.add("world", g.filter("graph in ('world_ASIA', 'world_default')"))
    store.replace("world", "world_EUROPE", g.filter("graph = 'world_AFRICA'"))
    store.commit("world", delete=lambda q: q.filter("p = 'rdfs:label' and graph = 'world_ASIA'"), graphs=["world_ASIA"])
    store.commit("world", add=g.filter("s = 'nation:8' and graph = 'world_ASIA'"), graphs=["world_ASIA"])
    return shown(store.read("world"))

"""The engine's verbs, as a facade: repositories, background names, narratives and their graphs.

Errors are exceptions with the status that a web layer would send. Order of checks: missing repository
(400), unknown repository (404), existing one (409), missing narrative or name (400), unknown one (404)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomgraph
from loomgraph.functions import text as T
from loomgraph.functions.ids import digest_id
from loomgraph.operators import narrative as N
from loomgraph.operators import news
from loomgraph.operators import quads as Q
from loomgraph.operators import reading
from loomgraph.operators.entities import Knowledge, entity_quads
from loomgraph.operators.providers import Absent, Provider, annotated
from loomgraph.operators.stored import stored
from loomgraph.sources import files, turtle

DEFAULT_SENTENCES, LEAST_SENTENCES = 10, 2
#: What a narrative comes with.
BODY = ("title", "source", "text", "published", "url")


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def sentence_count(value: str | int | None) -> int:
    """The 'sentences' parameter: digits, at least 2, default 10."""
    if value is None:
        return DEFAULT_SENTENCES
    if not re.fullmatch(r"\d+", str(value)) or int(value) < LEAST_SENTENCES:
        raise ApiError(400, "sentences must be a number of at least 2")
    return int(value)


class Engine:
    """provider answers what a model would; knowledge and the lists hold what is known of names: countries (name,
    iri), female and male first names (name)."""

    def __init__(self, spark: SparkSession, path: str, provider: Provider | None = None, knowledge: Knowledge | None = None, countries: DataFrame | None = None, female: DataFrame | None = None, male: DataFrame | None = None):
        self.spark, self.store = spark, Q.QuadTable(spark, path)
        self.provider, self.knowledge = provider or Absent(), knowledge or Knowledge(spark)
        self.countries, self.female, self.male = countries, female, male

    def version(self) -> str:
        return loomgraph.__version__

    # repositories

    def _server(self) -> DataFrame:
        return self.store.read(Q.DEFAULT)

    def _default(self, repo: str) -> DataFrame:
        return self.store.read(repo, [Q.graph_name(repo)])

    def _labels(self, repo: str) -> DataFrame:
        """What the server and the repository know by name."""
        return N.preloaded(N.corrections(self._server()), N.corrections(self._default(repo)))

    def list_repositories(self) -> DataFrame:
        s = Q.star(self._server(), type="rdf:type", created="dc:created").filter("type = ':Database'")
        return s.select(F.substring("s", 2, 1000).alias("repo"), F.col("created").try_cast("timestamp_ntz").alias("created"))

    def _repo(self, repo: str | None, exists: bool = True) -> str:
        if not repo:
            raise ApiError(400, "repository is missing")
        there = not self.list_repositories().filter(F.col("repo") == repo).isEmpty()
        if exists and not there:
            raise ApiError(404, f"{repo} not found")
        if not exists and there:
            raise ApiError(409, f"{repo} exists")
        return repo

    def _facts(self, repo: str, graph: str, facts: list[tuple]) -> DataFrame:
        rows = [(repo, graph, s, p, o, k, t) for s, p, o, k, t in facts if o is not None]
        return Q.quads(self.spark.createDataFrame(rows, "repo string, graph string, s string, p string, o string, o_kind string, o_type string"))

    def _now(self) -> str:
        return self.spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]

    def create_repository(self, repo: str) -> None:
        self._repo(repo, exists=False)
        self.store.add(Q.DEFAULT, self._facts(Q.DEFAULT, Q.DEFAULT, [(f":{repo}", "rdf:type", ":Database", "iri", None), (f":{repo}", "dc:created", self._now(), "lit", "xsd:dateTime")]))

    def drop_repository(self, repo: str) -> None:
        """The repository's graphs (and of no other whose name starts alike), then its entry."""
        self._repo(repo)
        self.store.drop(repo)
        self.store.commit(Q.DEFAULT, delete=lambda q: q.filter(F.col("s") == f":{repo}"), graphs=[Q.DEFAULT])

    # background names

    def add_background(self, repo: str, names: list[dict]) -> dict:
        """Names are read like the entities of a sentence; what is new is a background entity and a correction."""
        self._repo(repo)
        rows = self.spark.createDataFrame([(k, n.get("name"), n.get("type"), n.get("alsoKnownAs"), n.get("isCollection")) for k, n in enumerate(names)], "k int, name string, type string, alsoKnownAs array<string>, isCollection boolean")
        good, skipped = files.background_names(rows)
        one = good.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", F.col("name").alias("text"), F.col("ner").alias("ner_type"), "also"))).alias("e"))
        listed = F.transform("e", lambda x: F.struct(x["text"].alias("text"), x["ner_type"].alias("ner_type"), x["also"].alias("also")))
        kinds = self.spark.createDataFrame([], reading.UNIT).schema
        value = {"narrative_id": F.lit("background"), "phase": F.lit(0), "a": F.lit(0), "b": F.lit(0), "owner": F.lit(":background"), "entities": listed}
        unit = one.select(*[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
        facts = reading.read(unit, self._labels(repo), self.provider, self.knowledge, self.countries).filter("kind = 'entity'")
        new = N.entity_rows(stored(facts), self.knowledge, self.female, self.male)
        new = new.withColumn("class", F.replace("class", F.lit(":Correction"), F.lit(":Background, :Correction")))
        self.store.add(repo, entity_quads(new, F.lit(repo), F.lit(Q.graph_name(repo)), self.countries))
        order = lambda d: [r["name"] for r in d.orderBy("k").collect()]
        return {"repository": repo, "processedNames": order(good), "skippedNames": order(skipped)}

    def list_background(self, repo: str) -> DataFrame:
        """name, type, plural of the background names; groups of people are not listed."""
        self._repo(repo)
        q = self._default(repo)
        is_ = lambda c: F.max(((F.col("p") == "rdf:type") & F.col("o").isin(c)).cast("int")) == 1
        got = q.groupBy("s").agg(F.min(F.when(F.col("p") == ":text", F.col("o"))).alias("name"), is_([":Background"]).alias("b"), is_([":Collection"]).alias("plural"), *[is_(v).alias(k) for k, v in (("person", [":Person"]), ("thing", [":Resource"]), ("organization", [":OrganizationalEntity"]), ("place", [":Location", ":GeopoliticalEntity"]), ("law", [":LawAndPolicy"]))])
        kinds = F.array(*[F.when(F.col(k), k) for k in ("person", "thing", "organization", "place", "law")])
        return got.filter("b and name is not null").select("name", F.explode(F.array_compact(kinds)).alias("type"), F.when(F.col("plural"), True).alias("plural"))

    def remove_background(self, repo: str, name: str | None) -> None:
        self._repo(repo)
        if not name:
            raise ApiError(400, "name is missing")
        known = lambda q: q.join(Q.subjects(q, **{"rdf:type": ":Background", ":text": name}), ["repo", "graph", "s"], "left_semi")
        if known(self._default(repo)).isEmpty():
            raise ApiError(404, f"{name} not found")
        self.store.commit(repo, delete=known, graphs=[Q.graph_name(repo)])

    # narratives

    def ingest_narrative(self, repo: str, body: dict, sentences: str | int | None = None) -> dict:
        """A narrative's graph, what it defines, and its metadata. All sentences are ingested, whatever the number
        asked for, as yet; a narrative that is there is made anew."""
        self._repo(repo)
        sentence_count(sentences)
        for field in ("title", "source", "text"):
            if not body.get(field):
                raise ApiError(400, f"{field} is missing")
        one = self.spark.createDataFrame([tuple(body.get(c) for c in BODY)], ", ".join(f"{c} string" for c in BODY))
        r = self.ingest_narratives(repo, one).first()
        return {
            "narrativeId": r["narrativeId"], "processed": r["processed"], "numberOfTriples": r["numberOfTriples"], "numberOfSentences": r["numberOfSentences"], "numberIngested": r["numberOfSentences"],
            "narrativeMetadata": {"title": r["title"], "published": r["published"], "source": r["source"], "url": r["url"]},
        }

    def ingest_narratives(self, repo: str, bodies: DataFrame, more: DataFrame | None = None, stream: tuple[str, int] | None = None) -> DataFrame:
        """Any number of narratives (title, source, text, published, url) in one commit, as if they had come one after the
        other by published and id: each sees the names that those before it define.

        Rows without a title, source or text are left out; rows that are alike in these three are one narrative,
        and one that is there already is made anew. more: other quads of the repository for the same commit. stream: see QuadTable.commit().
        Returns narrativeId, processed, numberOfTriples, numberOfSentences, title, published, source, url."""
        self._repo(repo)
        told = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(files.NOT_DEFINED)).alias(c)
        rows = bodies.filter("title <> '' and source <> '' and text <> ''").select("title", "source", "text", told("published"), told("url"))
        rows = rows.withColumn("narrative_id", digest_id(F.lit(repo), "title", "source", "text", length=8))
        rows = rows.groupBy("narrative_id").agg(F.min(F.struct("published", "url", "title", "source", "text")).alias("n")).select("narrative_id", "n.*")
        rows = stored(rows.withColumn("at", F.concat_ws(" ", F.lit("at"), "published", "narrative_id")))
        created, default = self._now(), Q.graph_name(repo)
        known = N.Known(N.corrections(self._server()), stored(self._default(repo).filter(F.col("p").isin("rdf:type", "rdfs:label"))))
        made = N.create_graphs(rows.select("narrative_id", "text", "at"), repo, self.provider, known, self.knowledge, self.countries, self.female, self.male)
        quads = stored(made.graphs)
        triples = quads.groupBy(F.substring_index("graph", "_", -1).alias("narrative_id")).agg(F.count("*").alias("triples"))
        counts = rows.join(made.tables.sentences.groupBy("narrative_id").agg(F.count("*").alias("sentences")), "narrative_id", "left").join(triples, "narrative_id", "left")
        counts = stored(counts.fillna(0, ["sentences", "triples"]))
        about = N.metadata_quads(annotated(counts, self.provider, "classification", F.col("text"), N.CLASSIFICATION, "answer"), repo)
        nid, n = F.concat(F.lit(":"), "narrative_id"), F.concat(F.lit(":Narrative_"), "narrative_id")
        at = F.lit(repo), F.lit(default)
        entry = Q.triplify(counts, nid, *at, **{"rdf:type": (F.lit(":InformationGraph"), "iri"), "dc:created": (F.lit(created), "xsd:dateTime"), ":number_triples": (F.col("triples"), "xsd:integer"), ":encodes": (n, "iri")})
        entry = entry.unionByName(Q.triplify(counts, n, *at, **{":number_ingested": (F.col("sentences"), "xsd:integer")}))
        new = quads.unionByName(made.entities).unionByName(about).unionByName(entry)
        new = new if more is None else new.unionByName(Q.quads(more))
        ids = counts.select(F.explode(F.array(nid, n)).alias("gone"))
        graphs = counts.select(F.concat(F.lit(f"{repo}_"), "narrative_id").alias("gone"))
        old = lambda q: q.filter(F.col("graph") == default).join(ids, F.col("s") == F.col("gone"), "left_semi").unionByName(q.join(graphs, F.col("graph") == F.col("gone"), "left_semi"))
        some = [r["gone"] for r in graphs.limit(Q.QuadTable.NAMED).collect()] if more is None else []
        about_all = [default, *some] if more is None and len(some) < Q.QuadTable.NAMED else None
        self.store.commit(repo, add=new, delete=old, graphs=about_all, stream=stream)
        return counts.select(F.col("narrative_id").alias("narrativeId"), F.lit(created).alias("processed"), F.col("triples").cast("int").alias("numberOfTriples"), F.col("sentences").cast("int").alias("numberOfSentences"), "title", "published", "source", "url")

    def list_narratives(self, repo: str) -> DataFrame:
        """One row a narrative that has all of its metadata."""
        self._repo(repo)
        q = self._default(repo)
        g = Q.star(q, created="dc:created", triples=":number_triples", narrative=":encodes").select(F.substring("s", 2, 100).alias("narrativeId"), "created", F.col("triples").cast("int").alias("numberOfTriples"), "narrative")
        n = Q.star(q, source=":source", title="dc:title", sentences=":number_sentences", ingested=":number_ingested", published="dc:created", url=":external_link")
        n = n.select(F.col("s").alias("narrative"), "source", "title", F.col("sentences").cast("int").alias("numberOfSentences"), F.col("ingested").cast("int").alias("numberIngested"), "published", "url")
        return g.join(n, "narrative").drop("narrative")

    @staticmethod
    def _metadata(nid: str):
        """A narrative's two metadata subjects among quads."""
        return lambda q: q.filter(F.col("s").isin(f":{nid}", f":Narrative_{nid}") & F.col("graph").endswith(f"_{Q.DEFAULT}"))

    def _narrative(self, repo: str, nid: str | None) -> str:
        self._repo(repo)
        if not nid:
            raise ApiError(400, "narrativeId is missing")
        if self.list_narratives(repo).filter(F.col("narrativeId") == nid).isEmpty():
            raise ApiError(404, f"{nid} not found")
        return Q.graph_name(repo, nid)

    def delete_narrative(self, repo: str, nid: str) -> None:
        graph = self._narrative(repo, nid)
        self.store.commit(repo, delete=self._metadata(nid), drop=[graph], graphs=[Q.graph_name(repo), graph])

    def get_graph(self, repo: str, nid: str) -> list[str]:
        graph = self._narrative(repo, nid)
        return Q.exported(self.store.read(repo, [graph]), repo, graph)

    def replace_graph(self, repo: str, nid: str, body: str) -> int:
        """A narrative's graph from Turtle text, checked before anything is written, and its new count."""
        graph = self._narrative(repo, nid)
        try:
            new = turtle.from_text(self.spark, body, repo, graph)
        except turtle.TurtleError as e:
            raise ApiError(500, "Invalid triples") from e
        n = new.count()
        count = self._facts(repo, Q.graph_name(repo), [(f":{nid}", ":number_triples", str(n), "lit", "xsd:integer"), (f":{nid}", "dc:modified", self._now(), "lit", "xsd:dateTime")])
        old = (F.col("graph") == Q.graph_name(repo)) & (F.col("s") == f":{nid}") & F.col("p").isin(":number_triples", "dc:modified")
        self.store.commit(repo, add=Q.checked(repo, graph, new).unionByName(count), delete=lambda q: q.filter(old), drop=[graph], graphs=[Q.graph_name(repo), graph])
        return n

    def narrative_details(self, repo: str) -> DataFrame:
        """list_narratives() in the nested form of a response."""
        n = self.list_narratives(repo)
        meta = F.struct("title", "published", "source", "url").alias("narrativeMetadata")
        return n.select("narrativeId", F.col("created").alias("processed"), "numberOfTriples", "numberOfSentences", "numberIngested", meta)

    # news

    def search_articles(self, topic: str | None, from_date: str | None, to_date: str | None, replies: DataFrame) -> DataFrame:
        """title, published, source, url of recorded search replies (id, title, published, source, url) that name the
        topic and are of these days, without excluded and duplicate ones."""
        if not topic or not from_date or not to_date:
            raise ApiError(400, "topic, fromDate and toDate are required")
        dates = self.spark.createDataFrame([(from_date,), (to_date,)], "d string").select(T.date_valid(F.col("d")).alias("ok"))
        if not all(r["ok"] for r in dates.collect()):
            raise ApiError(400, "fromDate and toDate must be valid dates, yyyy-mm-dd")
        day = F.left("published", F.lit(10))
        hit = replies.filter(F.contains(F.lower("title"), F.lit(topic.lower())) & day.between(from_date, to_date))
        return news.matching_articles([hit]).select("title", "published", "source", "url")

    def drop_orphans(self) -> None:
        """Graphs of repositories that the server doesn't list."""
        listed = {r["repo"] for r in self.list_repositories().collect()} | {Q.DEFAULT}
        for repo in self.store.repositories():
            if repo not in listed:
                self.store.drop(repo)

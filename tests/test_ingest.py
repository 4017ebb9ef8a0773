"""Narratives in bulk and as streams: any batching gives the graphs that one after the other gives, once."""

import hashlib
import json

import pytest
from loomgraph.api import Engine
from loomgraph.operators import narrative as N
from loomgraph.operators import quads as Q
from loomgraph.operators.providers import Recorded
from loomgraph.streaming import ingest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

#: What is said, and the entities in it: later ones mean what earlier ones define, by parts of names and other names.
SAID = [
    ("Harriet Hageman spoke.", [("Harriet Hageman", "PERSON")]),
    ("Hageman met Acme Holdings.", [("Hageman", "PERSON"), ("Acme Holdings", "ORG")]),
    ("The Acme Holdings Board and Harriet left.", [("the Acme Holdings Board", "ORG"), ("Harriet", "PERSON")]),
    ("Holdings fell in Wyoming.", [("Holdings", "ORG"), ("Wyoming", "GPE")]),
]


@pytest.fixture(scope="module")
def provider(spark):
    rows = [("entities", hashlib.sha256(t.encode()).hexdigest(), json.dumps({"entities": [{"text": x, "ner_type": k} for x, k in found]})) for t, found in SAID]
    return Recorded(spark.createDataFrame(rows, "kind string, digest string, reply string"))


def bodies(spark, *numbers):
    rows = [(f"T{k}", "S", SAID[k][0], f"2024-01-0{k + 1}T00:00:00", None) for k in numbers]
    return spark.createDataFrame(rows, "title string, source string, text string, published string, url string")


def engine(spark, provider, path):
    e = Engine(spark, f"file://{path}", provider)
    e.create_repository("r")
    return e


def graph(e):
    """All quads but times of creation."""
    rows = [tuple(r) for r in e.store.read("r").collect() if not (r["p"] == "dc:created" and not r["s"].startswith(":Narrative_")) and r["graph"] != "r_arrivals"]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_versions_of_labels(spark):
    """A label's entry changes with what is defined after it, and only for those who come later."""
    prior = spark.createDataFrame([(":A", "rdf:type", ":Correction"), (":A", "rdf:type", ":Person"), (":A", "rdfs:label", "Jo")], "s string, p string, o string")
    defined = [(":B", "rdf:type", ":Person", "2"), (":B", "rdf:type", ":Correction", "2"), (":B", "rdfs:label", "Jo", "2"), (":B", "rdfs:label", "Flo", "4"), (":B", "rdfs:label", "Jo", "5"), (":C", "rdf:type", ":Person", "1"), (":C", "rdfs:label", "Moe", "1")]
    manual = spark.createDataFrame([], "s string, type string, label string")
    got = N.Known(manual, prior).versions(spark.createDataFrame(defined, "s string, p string, o string, at string"))
    assert {(r["label"], r["iri"], r["since"], r["until"]) for r in got.collect()} == {("Jo", ":A", "", "2"), ("Jo", ":B", "2", None), ("Flo", ":B", "4", None)}


def write(folder, k, **more):
    folder.mkdir(exist_ok=True)
    row = {"title": f"T{k}", "source": "S", "text": SAID[k][0], "published": f"2024-01-0{k + 1}T00:00:00"} | more
    (folder / f"{k}{len(more)}.json").write_text(json.dumps(row))


def test_a_batch_is_as_one_after_the_other(spark, provider, tmp_path):
    """Two narratives one by one, and as one batch of a stream in another order of files, with a row that is none."""
    one = engine(spark, provider, tmp_path / "one")
    for k in (0, 1):
        one.ingest_narrative("r", bodies(spark, k).first().asDict())
    want = graph(one)
    assert {x[4] for x in want if x[3] == ":mentions"} == {":Harriet_Hageman", ":Acme_Holdings"}  # nothing is defined twice
    e = engine(spark, provider, tmp_path / "s")
    for k in (1, 0):
        write(tmp_path / "in", k)
    write(tmp_path / "in", 2, text=None)
    ingest.articles(e, "r", f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
    assert graph(e) == want
    assert {(r["title"], r["numberOfSentences"]) for r in e.list_narratives("r").collect()} == {("T0", 1), ("T1", 1)}


class Arrivals:
    """An engine that keeps a batch's arrivals only."""

    def __init__(self, spark, path):
        self.spark, self.store = spark, Q.QuadTable(spark, path)

    def ingest_narratives(self, repo, batch, more, stream):
        self.store.commit(repo, add=more, stream=stream)


def test_a_stream_killed_and_started_again(spark, tmp_path, monkeypatch):
    """The first batch fails after its commit, the second before it: nothing is lost, nothing is there twice."""
    e = Arrivals(spark, f"file://{tmp_path}/q")
    run = lambda: ingest.articles(e, "r", f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
    counted = lambda: {r["begins"].day: (r["articles"], r["late"]) for r in ingest.arrived(e.store, "r").collect()}
    real, failing = e.store.commit, ["after", "before"]

    def commit(*args, **more):
        when = failing.pop(0) if failing else None
        if when != "before":
            real(*args, **more)
        if when:
            raise RuntimeError("killed")

    monkeypatch.setattr(e.store, "commit", commit)
    for k in (0, 1):
        write(tmp_path / "in", k)
    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert counted() == {1: (1, 0), 2: (1, 0)} and failing == ["before"]
    write(tmp_path / "in", 2)
    with pytest.raises(StreamingQueryException):
        run()
    assert counted() == {1: (1, 0), 2: (1, 0)}
    run()
    run()  # nothing new
    assert counted() == {1: (1, 0), 2: (1, 0), 3: (1, 0)}


def test_late_articles_are_counted(spark, tmp_path):
    """By their window, against the latest of the batches before; articles without a time are in none."""
    table = Q.QuadTable(spark, f"file://{tmp_path}/q")
    batches = [["2024-01-01T00:00:00", "2024-01-05T00:00:00", None], ["2024-01-01T05:00:00", "2024-01-04T12:00:00", "soon"], ["2024-01-01T06:00:00"]]
    for k, times in enumerate(batches):
        batch = spark.createDataFrame([(t,) for t in times], "published string")
        table.commit("r", add=ingest.arrivals(batch, table, "r", "s", k, "1 day", "1 day"), stream=("s", k))
    got = {r["begins"].day: (r["articles"], r["late"]) for r in ingest.arrived(table, "r").collect()}
    assert got == {1: (3, 2), 4: (1, 0), 5: (1, 0)}

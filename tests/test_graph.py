from concurrent.futures import ThreadPoolExecutor

import pytest
from loomgraph import api
from loomgraph.operators import commits
from loomgraph.operators import hierarchy as H
from loomgraph.operators import quads as Q
from loomgraph.sources import turtle
from pyspark.sql import functions as F

TTL = """@prefix : <urn:loomgraph:> . # a comment
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:testS :testP :testO ; rdfs:label "text" .
:a a :B , :C ; :n 5 ; :d -1.5e3 ; :ok true ; :t "x\\"y"@en , '''long
"one"'''^^<http://www.w3.org/2001/XMLSchema#string> ; :list ( :x "y" ) ; :node [ a :Blank ; :p [] ] .
"""


def test_turtle():
    got = turtle.parsed(TTL)
    b = Q.BASE
    assert (b + "testS", b + "testP", b + "testO", "iri", None, None) in got
    assert (b + "a", b + "t", 'x"y', "lit", None, "en") in got
    assert (b + "a", b + "n", "5", "lit", Q.PREFIXES["xsd"] + "integer", None) in got
    assert sum(p == turtle.RDF + "type" for _, p, *_ in got) == 3 and len(got) == 2 + 2 + 3 + 2 + 5 + 3
    for bad in ("subject rdfs:label \"bar\" .", ":a :b", ":a :b :c", ":a \"b\" :c .", "nope:a :b :c ."):
        with pytest.raises(turtle.TurtleError):
            turtle.parsed(bad)


def test_store(spark, tmp_path):
    s = Q.QuadTable(spark, f"file://{tmp_path}/quads")
    new = turtle.from_text(spark, ':testS :testP :testO ; rdfs:label "text" .', "foo", "foo_g")
    assert s.add("foo", new) == 2 and s.add("foo", new) == 0
    other = turtle.from_text(spark, ":x :y :z .", "foobar", "foobar_g")
    assert s.add("foobar", other) == 1
    lines = Q.exported(s.read(), "foo", "foo_g")
    assert len(lines) == 8 and lines[6] == ':testS :testP :testO .' and lines[7] == ':testS rdfs:label "text" .'
    count = "SELECT count(*) AS cnt FROM {quads} WHERE graph = :graph AND o = :o"
    assert s.query(count, "foo", graph="foo_g", o="text").first()["cnt"] == 1 and s.query(count, graph="x' OR '1' = '1", o="text").first()["cnt"] == 0
    s.remove("foo", new.limit(1))
    assert s.read("foo").count() == 1 and s.read().filter("repo = 'foo'").count() == 1
    s.clear("foo", "foo_g")
    assert s.read().count() == 1
    assert [r[0] for r in Q.repo_graphs(s.read(), "foo").collect()] == []
    under = turtle.from_text(spark, ":x :y :z .", "foo_bar", "foo_bar_default")
    s.add("foo_bar", under)
    assert [r[0] for r in Q.repo_graphs(s.read(), "foo").collect()] == [] and [r[0] for r in Q.repo_graphs(s.read(), "foo_bar").collect()] == ["foo_bar_default"]
    assert {r[0] for r in Q.repo_graphs(s.read(), "foo", exact=False).collect()} == {"foobar_g", "foo_bar_default"}
    s.drop("foo_bar")
    with pytest.raises(ValueError):
        Q.replaced(other, "foobar", "foobar_g", other.withColumn("o", other["o"].try_cast("int").cast("string")))
    turtle.write(other, f"file://{tmp_path}/ttl")
    assert {tuple(r) for r in turtle.read(spark, f"file://{tmp_path}/ttl/part*", "foobar", "foobar_g").collect()} == {tuple(r) for r in Q.quads(other).collect()}


def test_store_versions(spark, tmp_path):
    """Repositories by any name; a write that didn't end is not seen; readers of the version before go on."""
    s = Q.QuadTable(spark, f"file://{tmp_path}/quads")
    for repo in ("007", "7", "a/b c=d", "ö"):
        q = turtle.from_text(spark, f':s :p "{repo}" .', repo, f"{repo}_g")
        assert s.add(repo, q) == 1 and s.add(repo, q) == 0 and s.read(repo).count() == 1
        assert s.read(repo).first()["repo"] == repo and s.read(repo).first()["o"] == repo
    assert s.read().count() == 4
    old = s.read("007")
    s.replace("007", "007_g", turtle.from_text(spark, ":a :b :c , :d .", "007", "007_g"))
    assert old.count() == 1 and s.read("007").count() == 2
    s.read("007").limit(1).write.parquet(f"{s.path}/{s._folder('007')}/data/w=broken")  # in no commit
    assert s.read("007").count() == 2
    s.apply("007", lambda q: q.filter("o = ':c'"))
    assert s.read("007").count() == 1
    s.MANY = 2
    for k in range(5):
        assert s.add("007", turtle.from_text(spark, f":n{k} :b :c .", "007", "007_g")) == 1
    state = s.state("007")
    assert s.read("007").count() == 6 and state.base and len(state.added) + len(state.deleted) < 5


def test_commits_cost_what_they_change(spark, tmp_path):
    """A replaced graph leaves every file of the others as it is; deletions are merged on reading."""
    s = Q.QuadTable(spark, f"file://{tmp_path}/quads")
    body = " ".join(f":s{k} :p :o{k} ." for k in range(50))
    for g in ("a", "b", "c"):
        s.add("r", turtle.from_text(spark, body, "r", f"r_{g}"))
    files = lambda: {str(x): x.stat().st_mtime_ns for x in tmp_path.rglob("*.parquet")}
    before = files()
    s.replace("r", "r_b", turtle.from_text(spark, ":new :p :o .", "r", "r_b"))
    after = files()
    assert all(after[x] == t for x, t in before.items())
    rows = [Q.SCHEMA, *(spark.read.parquet(x).count() for x in set(after) - set(before))]
    assert sum(rows[1:]) == 2  # the new quad and the word that the graph is gone
    assert {r["graph"]: r["n"] for r in s.read("r").groupBy("graph").agg(F.count("*").alias("n")).collect()} == {"r_a": 50, "r_b": 1, "r_c": 50}
    s.commit("r", delete=lambda q: q.filter("s = ':s7'"), graphs=["r_a"])
    assert s.read("r", ["r_a"]).count() == 49 and s.read("r", ["r_c"]).count() == 50
    assert s.add("r", turtle.from_text(spark, ":s7 :p :o7 . :s8 :p :o8 .", "r", "r_a")) == 1  # comes again after it was deleted
    whole = {tuple(r) for r in s.read("r").collect()}
    assert s.compact("r") and {tuple(r) for r in s.read("r").collect()} == whole and len(s.state("r").added) == 1
    with pytest.raises(ValueError):
        s.commit("r", add=turtle.from_text(spark, ":s :p :o .", "r", "r_z"), graphs=["r_a"])
    for g in ("a", "b", "c"):
        s.clear("r", f"r_{g}")
    assert s.read("r").count() == 0 and s.compact("r") and s.read("r").count() == 0 and s.add("r", turtle.from_text(spark, body, "r", "r_a")) == 50


def test_writers_do_not_lose_each_others_quads(spark, tmp_path):
    """Four writers at once, of one graph and of others: all is there, nothing twice; a batch is applied once."""
    s = Q.QuadTable(spark, f"file://{tmp_path}/quads")
    s.MANY = 5
    rows = lambda g, n: spark.createDataFrame([("r", g, f":s{k}", ":p", f":o{k}", "iri", None, None) for k in n], Q.SCHEMA)
    jobs = [lambda k=k: s.add("r", rows("r_one", range(k, k + 4))) for k in range(4)] + [lambda k=k: s.add("r", rows(f"r_{k}", range(3))) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        counts = [f.result() for f in [pool.submit(j) for j in jobs]]
    assert sum(counts[:4]) == 7 and counts[4:] == [3] * 4
    got = s.read("r").groupBy("graph").agg(F.count("*").alias("n"), F.countDistinct("s").alias("d")).collect()
    assert {r["graph"]: (r["n"], r["d"]) for r in got} == {"r_one": (7, 7), **{f"r_{k}": (3, 3) for k in range(4)}}
    assert s.commit("r", add=rows("r_s", range(2)), stream=("in", 0)) == 2 and s.commit("r", add=rows("r_s", range(9)), stream=("in", 0)) == 0
    s.compact("r")
    assert s.commit("r", add=rows("r_s", range(9)), stream=("in", 0)) == 0 and s.commit("r", add=rows("r_s", range(3)), stream=("in", 1)) == 1


def test_a_commit_that_meets_another_is_made_again(spark, tmp_path, monkeypatch):
    s = Q.QuadTable(spark, f"file://{tmp_path}/quads")
    rows = lambda *n: spark.createDataFrame([("r", "r_g", f":s{k}", ":p", ":o", "iri", None, None) for k in n], Q.SCHEMA)
    s.add("r", rows(1, 2))
    done, real = [], s._written

    def meanwhile(repo, df):
        out = real(repo, df)
        if not done:
            done.append(1)
            s.add("r", rows(3))
        return out

    monkeypatch.setattr(s, "_written", meanwhile)
    assert s.commit("r", add=lambda q: q.withColumn("p", F.lit(":q"))) == 3  # reads what the other has added
    assert s.read("r").count() == 6
    monkeypatch.setattr(s, "_meet", lambda a, b: True)
    monkeypatch.setattr(s, "ATTEMPTS", 2)
    done.clear()
    real_get = commits.Log.get
    monkeypatch.setattr(commits.Log, "put", lambda log, n, c: False)  # others are always first
    monkeypatch.setattr(commits.Log, "get", lambda log, n: real_get(log, n) if n in log.numbers() else {})
    monkeypatch.setattr(s, "_written", real)
    before = set(tmp_path.rglob("w=*"))
    with pytest.raises(Q.Conflict):
        s.commit("r", delete=rows(1))
    assert set(tmp_path.rglob("w=*")) == before


def test_exports_parse(spark, tmp_path):
    """What is exported is read back: quotes, line ends, backslashes, languages, types, colons and blank nodes."""
    text = 'He said "no",\n\tthen C:\\\\dir \\r and é'
    rows = [("r", "r_g", ":a:b", ":p", text, "lit", None, None), ("r", "r_g", ":a", "rdfs:label", text, "lit", "xsd:string", None), ("r", "r_g", ":a", "dc:title", 'x"', "lit", None, "en"), ("r", "r_g", ":a", "rdf:type", "geo:12", "iri", None, None), ("r", "r_g", ":a", ":q", "_:b1", "bnode", None, None)]
    q = spark.createDataFrame(rows, Q.SCHEMA)
    lines = Q.exported(q, "r", "r_g")
    back = turtle.from_text(spark, "\n".join(lines), "r", "r_g")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in q.collect()}
    assert [x.split()[1] for x in lines[: lines.index("")]] == [":", "geo:", "dc:", "owl:", "rdf:", "rdfs:", "xsd:"]
    turtle.write(q, f"file://{tmp_path}/ttl")
    assert {tuple(r) for r in turtle.read(spark, f"file://{tmp_path}/ttl/part*", "r", "r_g").collect()} == {tuple(r) for r in q.collect()}


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_hierarchy(spark, monkeypatch, broadcast):
    monkeypatch.setattr(H, "BROADCAST_EDGES", broadcast)
    assert H.closure(spark.createDataFrame([], "child string, parent string")).count() == 0
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r[0], r[1]): r[2] for r in H.closure(e).collect()}
    assert got[("a", "d")] == 2 and got[("a", "a")] == 0 and got[("x", "y")] == 1 and ("d", "a") not in got and len(got) == 6 + 6 + 2
    assert [r[0] for r in H.roots(e).collect()] == ["d"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "node int, next int")
    heads = spark.createDataFrame([("o", 1)], "owner string, node int")
    deep = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(150)], "child string, parent string")
    far = H.closure(deep, reflexive=False)
    assert far.count() == 150 * 151 // 2 and far.agg({"depth": "max"}).first()[0] == 150
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, next int")
    assert {r["node"]: r["seq"] for r in H.linked_list(heads, ring).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r["node"]: r["seq"] for r in H.linked_list(heads, chain).collect()} == {i: i for i in range(1, 21)}


def status(call, *a):
    with pytest.raises(api.ApiError) as e:
        call(*a)
    return e.value.status


def test_api(spark, tmp_path):
    e = api.Engine(spark, f"file://{tmp_path}/kb")
    assert e.list_repositories().count() == 0
    e.create_repository("foo")
    e.create_repository("foobar")
    assert status(e.create_repository, "foo") == 409 and status(e.create_repository, None) == 400 and status(e.drop_repository, "nope") == 404
    names = [{"name": n, "type": t, "isCollection": c} for n, t, c in (("Mary", "person", False), ("Smiths", "Person", True), ("ACME", "organization", None), ("Act", "law", None), ("Nowhere", "location", None))]
    names[0]["alsoKnownAs"] = ["Mary Smith", "the Boss"]
    done = e.add_background("foo", names)
    assert done["processedNames"] == ["Mary", "Smiths", "ACME", "Act"] and done["skippedNames"] == ["Nowhere"]
    listed = {r["name"]: (r["type"], r["plural"]) for r in e.list_background("foo").collect()}
    assert listed == {"Mary": ("person", None), "Smiths": ("person", True), "ACME": ("organization", None), "Act": ("law", None)}
    own = {(r["s"], r["p"], r["o"]) for r in e.store.read("foo").collect()}
    assert {(":Mary", "rdf:type", x) for x in (":Person", ":Background", ":Correction")} <= own and {(":Mary", "rdfs:label", x) for x in ("Mary", "Mary Smith", "Boss")} <= own
    assert status(e.remove_background, "foo", "Bob") == 404 and status(e.remove_background, "foo", None) == 400
    e.remove_background("foo", "Act")
    assert "Act" not in {r["name"] for r in e.list_background("foo").collect()}
    assert status(e.ingest_narrative, "foo", {"title": "t", "source": "s"}) == 400
    assert status(e.ingest_narrative, "foo", {"title": "t", "source": "s", "text": "x y."}, "1") == 400
    body = {"title": "T", "source": "S", "text": 'Jane won. Bob lost! ? Who "really" knows.'}
    done = e.ingest_narrative("foo", body)
    assert done["numberOfSentences"] == done["numberIngested"] == 4 and done["numberOfTriples"] == 16
    nid = done["narrativeId"]
    row = e.list_narratives("foo").first()
    assert row["narrativeId"] == nid and row["numberOfTriples"] == 16 and row["numberIngested"] == 4 and row["url"] == "not defined"
    nested = e.narrative_details("foo").first()
    assert nested["narrativeMetadata"]["title"] == "T" and nested["processed"] == done["processed"]
    assert e.ingest_narrative("foo", body)["narrativeId"] == nid and e.list_narratives("foo").count() == 1
    before = e.get_graph("foo", nid)
    assert len(before) == 6 + 16 and status(e.get_graph, "foo", "zz") == 404 and status(e.get_graph, "foo", None) == 400
    assert status(e.replace_graph, "foo", nid, 'subject rdfs:label "bar" .') == 500 and e.get_graph("foo", nid) == before
    assert e.replace_graph("foo", nid, "\n".join(before)) == 16 and e.get_graph("foo", nid) == before
    assert e.replace_graph("foo", nid, ':a rdfs:label "b" .') == 1 and e.list_narratives("foo").first()["numberOfTriples"] == 1
    e.delete_narrative("foo", nid)
    assert e.list_narratives("foo").count() == 0 and e.list_background("foo").count() == 3
    e.drop_repository("foo")
    assert [r["repo"] for r in e.list_repositories().collect()] == ["foobar"] and e.store.read("foo").count() == 0


def test_api_with_annotations(spark, tmp_path):
    """A quotation, an entity that background names know and one that is new go through the API to the graph and back."""
    import hashlib
    import json

    from loomgraph.operators.providers import Recorded

    text = 'Jane Doe met the ACME Corp. “I lost,” Doe said.'
    say = lambda kind, t, **r: (kind, hashlib.sha256(t.encode()).hexdigest(), json.dumps(r))
    rows = [
        say("entities", "Jane Doe met the ACME Corp.", entities=[{"text": "Jane Doe", "ner_type": "PERSON"}, {"text": "the ACME Corp.", "ner_type": "ORG"}]),
        say("classification", text, subject_areas=[2], summary="A loss.", topics=["loss"], sentiment="negative", sentiment_explanation="She lost."),
        say("sentence", "I lost,", grade_level=2, rhetorical_devices=[]),
    ]
    e = api.Engine(spark, f"file://{tmp_path}/kb", Recorded(spark.createDataFrame(rows, "kind string, digest string, reply string")))
    e.create_repository("foo")
    e.add_background("foo", [{"name": "ACME", "type": "organization", "alsoKnownAs": ["ACME Corp"]}])
    nid = e.ingest_narrative("foo", {"title": 'A "T"', "source": "S", "text": text, "published": "2024-03-25T00:00:00"})["narrativeId"]
    got = {(r["s"], r["p"], r["o"]) for r in e.store.read("foo").filter(f"graph = 'foo_{nid}'").collect()}
    assert {o for _, p, o in got if p == ":mentions"} == {":Jane_Doe", ":ACME"} and {o for _, p, o in got if p == ":attributed_to"} == {":Jane_Doe"}
    assert (":Jane_Doe", "rdf:type", ":Person") in got and not any(s == ":ACME" for s, _, _ in got)
    kept = {(r["s"], r["p"], r["o"]) for r in e.store.read("foo").filter("graph = 'foo_default'").collect()}
    assert {(":Jane_Doe", "rdfs:label", "Doe"), (f":Narrative_{nid}", ":subject_area", "economy and business"), (f":Narrative_{nid}", "dc:title", 'A "T"'), (f":Narrative_{nid}", ":text", text)} <= kept
    lines = e.get_graph("foo", nid)
    assert e.replace_graph("foo", nid, "\n".join(lines)) == len(got) and e.get_graph("foo", nid) == lines
    again = e.ingest_narrative("foo", {"title": "U", "source": "S", "text": "Doe won."})
    assert again["numberOfSentences"] == 1


def test_search(spark, tmp_path):
    e = api.Engine(spark, f"file://{tmp_path}/kb")
    rows = [(1, "Election night in the city of dreams and more", "2024-03-02T10:00", "Google News", "https://x/a"), (2, "Election night in the city of dreams and others", "2024-03-03", "S", "https://x/b"), (3, "The election", "2024-03-04", "S", "https://x/video/1"), (4, "An election", "2023-01-01", "S", "https://x/d"), (5, "Weather", "2024-03-03", "S", "https://x/e")]
    r = spark.createDataFrame(rows, "id int, title string, published string, source string, url string")
    assert [x["url"] for x in e.search_articles("election", "2024-03-01", "2024-03-31", r).collect()] == ["https://x/b"]
    assert status(e.search_articles, None, "2024-03-01", "2024-03-31", r) == 400 and status(e.search_articles, "x", "2024-13-01", "2024-03-31", r) == 400

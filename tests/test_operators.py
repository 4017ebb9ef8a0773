import itertools

import numpy as np
import pytest
from loomgraph.operators import network as W
from loomgraph.operators import news as N
from loomgraph.operators import providers as P
from loomgraph.operators import resolve as R
from loomgraph.sources import files

EDGES = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (7, 8), (6, 9), (9, 5)]


@pytest.fixture(scope="module")
def net(spark):
    return W.edges(spark.createDataFrame(EDGES + [(2, 1), (3, 3)], "a long, b long"), "a", "b")


def test_network(net):
    r = W.size(net).first()
    assert (r["nodes"], r["edges"]) == (9, 9) and abs(r["density"] - 18 / 72) < 1e-12
    assert {r[0] for r in W.pendants(net).collect()} == {7, 8}
    comp = {r["node"]: r["component"] for r in W.components(net).collect()}
    assert comp == {**dict.fromkeys((1, 2, 3, 4, 5, 6, 9), 1), 7: 7, 8: 7}
    a = np.zeros((10, 10))
    for u, v in EDGES:
        a[u, v] = a[v, u] = 1
    values, vectors = np.linalg.eigh(a[1:, 1:])
    want = np.abs(vectors[:, -1])
    got = {r["node"]: r["centrality"] for r in W.eigenvector(net).collect()}
    assert all(abs(got[k + 1] - want[k]) < 1e-4 for k in range(9))


def test_containing_makes_needed_substrings_only(spark):
    """Wholes give substrings of the width, and of fewer characters only where a part has as few."""
    from loomgraph.operators.substring import containing

    wholes = spark.createDataFrame([("Customer#000000012345",), ("xaby",)], "w string")
    rows = {}
    for name in ("#00000001", "ab"):
        got = containing(spark.createDataFrame([(name,)], "p string"), "p", wholes, "w")
        rows[name] = got._jdf.queryExecution().optimizedPlan().toString().count("sequence(1,")
        assert [r["p"] for r in got.collect()] == [name]
    assert rows["ab"] > rows["#00000001"]


def test_names_are_not_collected_for_joins(spark):
    """However small a table of names looks, no join of the resolution and of the versions of names broadcasts it."""
    from loomgraph.operators import narrative as N
    from loomgraph.operators import resolve as R

    facts = [(s, p, o, at) for s, label, at in ((":A", "Jo", "1"), (":B", "Jo Flo", "3")) for p, o in (("rdf:type", ":Person"), ("rdf:type", ":Correction"), ("rdfs:label", label))]
    none = spark.createDataFrame([], "s string, type string, label string, p string, o string")
    versions = N.Known(none.select("s", "type", "label"), none.select("s", "p", "o")).versions(spark.createDataFrame(facts, "s string, p string, o string, at string"))
    got = R.resolved(spark.createDataFrame([("Jo", "2"), ("Flo", "2"), ("Flo", "4"), ("Jo", "1")], "mention string, at string"), versions)
    assert {(r["mention"], r["at"], r["iri"], r["priority"]) for r in got.collect()} == {("Jo", "2", ":A", 2), ("Flo", "2", None, 5), ("Flo", "4", ":B", 4), ("Jo", "1", None, 5)}
    for df in (versions, got):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_betweenness(net):
    near = {}
    for u, v in EDGES:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)

    def shortest(s, t):
        paths, found = [[s]], []
        while paths and not found:
            found = [p for p in paths if p[-1] == t]
            paths = [p + [n] for p in paths for n in near[p[-1]] if n not in p]
        return found

    want = dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        ways = shortest(s, t)
        for p in ways:
            for n in p[1:-1]:
                want[n] += 1 / len(ways)
    got = {r["node"]: r["centrality"] for r in W.betweenness(net).collect()}
    assert all(abs(got[n] - want[n] / (8 * 7)) < 1e-12 for n in near)


def test_resolution(spark):
    labels = spark.createDataFrame([("Trump", ":T", 1), ("Donald Trump Jr", ":TJ", 2), ("Cheney", ":C", 3)], "label string, iri string, seq int")
    countries = spark.createDataFrame([("Peru", "geo:1")], "name string, iri string")
    m = spark.createDataFrame([(x,) for x in ("Peru", "Cheney", "former President Trump", "Donald", "nobody", "Peru")], "mention string")
    got = {r["mention"]: (r["iri"], r["priority"]) for r in R.resolved(m, labels, countries).collect()}
    assert got == {"Peru": ("geo:1", 1), "Cheney": (":C", 2), "former President Trump": (":T", 3), "Donald": (":TJ", 4), "nobody": (None, 5)}
    rally = spark.createDataFrame([("Harris campaign rally",), ("Harris campaign",), ("",)], "mention string")
    known = spark.createDataFrame([("Biden-Harris campaign rally", ":R", 1), ("campaign", ":c", 2)], "label string, iri string, seq int")
    assert {r["mention"]: (r["iri"], r["priority"]) for r in R.resolved(rally, known).collect()} == {"Harris campaign rally": (":c", 3), "Harris campaign": (":c", 3), "": (None, 5)}
    assert {r["mention"]: (r["iri"], r["priority"]) for r in R.resolved(rally, known.filter("seq = 1")).collect()} == {"Harris campaign rally": (":R", 4), "Harris campaign": (":R", 4), "": (None, 5)}
    assert R.merged_places([("Paris", "GPE"), ("Texas", "GPE"), ("Jane", "PERSON")], "in Paris, Texas, Jane") == [("Paris,Texas", "GPE"), ("Jane", "PERSON")]


def test_containing(spark):
    from loomgraph.operators.substring import containing

    parts = spark.createDataFrame([("a",), ("ab",), ("the long part",), ("",), (None,), ("zz",)], "p string")
    wholes = spark.createDataFrame([("xaby",), ("in the long parts",), ("",), (None,), ("a",)], "w string")
    got = {(r["p"], r["w"]) for r in containing(parts, "p", wholes, "w").collect()}
    assert got == {("a", "xaby"), ("ab", "xaby"), ("a", "a"), ("the long part", "in the long parts"), ("a", "in the long parts")}


def test_pages_as_trees():
    from loomgraph.operators import html as H

    page = H.page('<html><body><p>no</p><div class="a story"><p>One <b>two</b></p><script>var a="<p>";</script><p class="x">three<br>four &amp; <p>five</div><p>out</p></body></html>')
    assert H.read(page, ["div&class&story", "p"]) == "One two threefour & five " and H.read(page, ["div&class&a story", "p&class&x"]) == "threefour & five "
    assert H.read(page, ["", "p"]) == "no One two threefour & five out " and H.read(page, ["article", "p"]) == "" and H.read(page, []) == ""
    assert H.read(H.page("<p><span>" + "x" * 80 + "</span></p><p><span>short</span></p><p>" + "y" * 90 + "</p>"), ["", "<p><span>"]) == "x" * 80 + " "
    ld = lambda x: H.body_of_json(H.page(f'<script type="application/ld+json">{{"a": 1}}</script><script type="application/ld+json">{x}</script>'))
    assert ld('{"articleBody": "the <b> body"}') == "the <b> body" and ld('{"hasPart": {"cssSelector": ".article-body", "value": "v"}}') == "v"
    assert ld('{"x": "\n", "articleBody": "over\ntwo lines, of twenty", "y": 1}') == "over\ntwo lines, of twenty" and ld('{"hasPart": {"cssSelector": "z"}}') == "" and ld("[1]") == "" and ld("{") == ""
    deep = H.page("<div>" * 5000 + "x" + "</div>" * 5000)
    assert deep.text() == "x" and len(deep.find_all("div")) == 5000 and H.page(None).text() == ""


def test_news(spark):
    html = '<html><head><meta property="og:url" content="http://x/1"></head><body></body></html>'
    assert spark.createDataFrame([(html,)], "h string").select(N.redirect("h")).first()[0] == "http://x/1"
    body = "<article>" + "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(3)) + "</article>"
    rows = [
        (1, "https://abcnews.go.com/a", body), (2, "https://abcnews.go.com/video/a", body), (3, "https://unknown.site/a", body), (4, "https://news.google.com/1", '<meta property="og:url" content="https://thehill.com/x">'),
        (5, "https://thehill.com/x", body), (6, "https://www.cnn.com/b", f'<script type="application/ld+json">{{"articleBody": "{"text " * 200}"}}</script>'), (7, "https://www.ft.com/c", body), (8, "https://www.usatoday.com/s", "<article><p>short</p></article>"),
        (9, "https://news.google.com/2", "<p>no address</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], len(r["text"]) > 500) for r in N.article_texts(pages).collect()}
    assert got == {1: ("https://abcnews.go.com/a", True), 4: ("https://thehill.com/x", True), 5: ("https://thehill.com/x", True), 6: ("https://www.cnn.com/b", True)}
    assert {r["page_id"]: r["text"][:5] for r in N.article_body(pages).collect() if r["text"]} == {6: "text "}
    titles = spark.createDataFrame([(1, "A" * 30 + "x"), (2, "A" * 30 + "y"), (3, "B" * 40), (4, "short"), (5, "shorter one"), (6, "unique"), (7, None), (8, "")], "id int, title string")
    assert {r["id"] for r in N.without_prefix_titles(titles).collect()} == {3, 5, 6, 7}
    assert {r["id"] for r in N.without_prefix_titles(titles.filter("id > 6")).collect()} == {7, 8}


def test_places_and_knowledge(spark):
    from loomgraph.operators.entities import Knowledge, by_type, known_types, labels_of

    rows = [("Paris", "Paris", "P", "PPLC", "France", ["Paname"], "u/Paris"), ("Los Angeles", "Los Angeles", "P", "PPLA2", "United States", None, None), ("New York City", "New York City", "P", "PPL", "United States", None, None), ("New York", "New York", "A", "ADM1", "United States", None, None),
            ("France", "France", "A", "PCLI", "France", None, None), ("Île", "Ile", "T", "ISL", "France", None, None), ("Oz", "Oz", "L", "RGN", None, None, None), ("Nirgends", "Nirgends", None, None, None, None, None)]
    g = spark.createDataFrame(rows, "toponym string, ascii string, feature string, code string, country string, names array<string>, link string")
    asked = ["paris", "Angeles", "York", "Paris, Texas", "Oz", "ILE", "none", "", "France", "Nirgends"]
    got = {r["text"]: r["toponym"] for r in P.places(spark.createDataFrame([(x,) for x in asked], "text string"), g).collect()}
    assert got == {"paris": "Paris", "Angeles": "Los Angeles", "York": "New York", "Paris, Texas": "Paris", "Oz": "Oz", "ILE": "Île", "none": None, "": None, "France": "France", "Nirgends": "Nirgends"}
    know = Knowledge(spark, gazetteer=g)
    about = {r["name"]: r["location"] for r in know.about(spark.createDataFrame([(x, "GPE") for x in asked if x] + [("Paris", "PERSON")], "name string, base string")).collect()}
    assert about["Angeles"]["class"] == ":PopulatedPlace, :AdministrativeDivision" and about["Angeles"]["admin_level"] == 2 and about["paris"]["names"] == ["Paname", "paris", "Paris"]
    assert about["France"]["class"] == ":Country" and about["France"]["country"] == "" and about["Oz"]["class"] == ":DesignatedArea" and about["none"] is None and about["Nirgends"] is None and about["Paris"] is None
    labels = spark.createDataFrame([("Q1", "en", "alias", 1, "b"), ("Q1", "mul", "label", 0, "a"), ("Q1", "en", "label", 0, "a"), ("Q1", "en", "alias", 0, "c"), ("Q2", "fr", "label", 0, "x")], "item string, lang string, kind string, seq int, value string")
    assert {r["item"]: r["labels"] for r in labels_of(labels).collect()} == {"Q1": ["a", "c", "b"]}
    e = spark.createDataFrame([("PERSON", "Jo"), ("GPE", "Oz"), ("PERSON", "Al"), ("PERSON", "Jo")], "ner_type string, text string")
    assert {r["ner_type"]: r["names"] for r in by_type(e).collect()} == {"PERSON": ["Al", "Jo"], "GPE": ["Oz"]}
    items, of = spark.createDataFrame([("Jo", "Q9")], "label string, item string"), spark.createDataFrame([("Q9", "Q5"), ("Q9", "Q1")], "item string, class string")
    assert {r["text"]: r["classes"] for r in known_types(e, items, of).collect()} == {"Jo": ["Q1", "Q5"], "Oz": None, "Al": None}


def test_syntax(spark):
    from loomgraph.operators import syntax as X

    def parse(*tokens):
        return [dict(zip(("text", "lemma", "pos", "dep", "head", "ent"), t)) for t in tokens]

    born = parse(("Narrator", "narrator", "PROPN", "nsubjpass", 2, ""), ("was", "be", "AUX", "auxpass", 2, ""), ("born", "bear", "VERB", "ROOT", 2, ""), ("on", "on", "ADP", "prep", 2, ""), ("1928", "1928", "NUM", "pobj", 3, "DATE"), ("in", "in", "ADP", "prep", 2, ""), ("Znojmo", "Znojmo", "PROPN", "pobj", 5, "GPE"), (".", ".", "PUNCT", "punct", 2, ""))
    kin = parse(("Bob", "Bob", "PROPN", "compound", 1, ""), ("Jones", "Jones", "PROPN", "nsubj", 4, ""), ("and", "and", "CCONJ", "cc", 1, ""), ("Paul", "Paul", "PROPN", "conj", 1, ""), ("are", "be", "AUX", "ROOT", 4, ""), ("her", "her", "PRON", "poss", 6, ""), ("brothers", "brother", "NOUN", "attr", 4, ""))
    sister = parse(("with", "with", "ADP", "ROOT", 0, ""), ("sister", "sister", "NOUN", "pobj", 0, ""), (",", ",", "PUNCT", "punct", 1, ""), ("Beatrice", "Beatrice", "PROPN", "appos", 1, ""))
    df = spark.createDataFrame([(1, born), (2, kin), (3, sister), (4, []), (5, None)], f"key long, tokens {X.TOKENS}")
    assert {tuple(r) for r in X.lives(df).collect()} == {(1, "born_on", "I", "1928"), (1, "born_in", "I", "Znojmo"), (2, "family", "brother", "Bob Jones"), (2, "family", "brother", "Paul"), (3, "family", "sister", "Beatrice")}
    assert [tuple(r) for r in X.subject_verbs(df).collect()] == [(1, "Narrator", "born")]
    assert {r["key"]: r[1] for r in df.select("key", X.has_subject_verb("tokens")).collect()} == {1: True, 2: True, 3: False, 4: False, 5: None}
    assert {(r["part"], r["under"]) for r in X.root_parts(df.filter("key = 1")).collect()} == {("Narrator", None), ("on", None), ("in", None), ("1928", "on"), ("Znojmo", "in")}
    t = spark.createDataFrame([("I was born on June 12, 1928, in Znojmo Nova, a town.",), ("She was born in Rome on 3 May 1900.",), ("none",)], "t string")
    assert [tuple(r) for r in t.select(*X.born("t")).collect()] == [("June 12, 1928", "Znojmo Nova"), ("3 May 1900", "Rome"), ("", "")]
    import hashlib
    import json

    said = ["Jane won.", "She smiled."]
    replies = spark.createDataFrame([("coref", hashlib.sha256(" ".join(said).encode()).hexdigest(), json.dumps({"updated_sentences": ["Jane won.", "Jane smiled."]}))], "kind string, digest string, reply string")
    n = spark.createDataFrame([("n1", said), ("n2", ["He left."])], "narrative_id string, sentences array<string>")
    assert {r["narrative_id"]: r["sentences"] for r in X.coreferences(n, P.Recorded(replies)).collect()} == {"n1": ["Jane won.", "Jane smiled."], "n2": ["He left."]}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Source: S\nTitle: T one\nURL: http://x\nPublished: 2024-01-01T00:00:00\nText: First.\nSecond.")
    (tmp_path / "b.txt").write_text("only a body")
    got = {r["path"][-5:]: r for r in files.articles(spark, f"file://{tmp_path}/*.txt").collect()}
    assert got["a.txt"]["title"] == "T one" and got["a.txt"]["text"] == "First.\nSecond." and got["b.txt"]["text"] == "only a body" and got["b.txt"]["title"] is None
    (tmp_path / "n.json").write_text('{"title":"t","source":"s","text":"x"}\n{"title":"t"}\n')
    rows = files.narratives(spark, f"file://{tmp_path}/n.json").collect()
    assert sorted((r["error"] or "", r["url"]) for r in rows) == [("", "not defined"), ("missing source, text", "not defined")]
    (tmp_path / "c.tsv").write_text("# x\n" + "\t".join(["AD", "AND", "", "", "Andorra", "", "", "", "EU", "", "EUR", "", "", "", "", "", "3041565", "ES,FR"]) + "\nshort\trow\n")
    info = files.country_info(spark, f"file://{tmp_path}/c.tsv")
    assert info.first()["geo_id"] == "3041565" and {tuple(r) for r in files.adjacency(info).collect()} == {("AD", "ES"), ("AD", "FR")}
    (tmp_path / "d.noun").write_text("  1 licence\n00001740 03 n 01 entity 0 003 ~ 00001930 n 0000 @ 00002137 n 0000 @i 00004475 n 0000 | that\n")
    syn = files.synsets(spark, f"file://{tmp_path}/d.noun").first()
    assert syn["synset"] == "00001740" and syn["words"] == ["entity"] and syn["hypernyms"] == ["00002137"]
    (tmp_path / "v.xml").write_text('<VNCLASS ID="a-1"><MEMBERS><MEMBER name="go"/></MEMBERS><SUBCLASSES><VNSUBCLASS ID="a-1-1"><MEMBERS><MEMBER name="run"/></MEMBERS><SUBCLASSES><VNSUBCLASS ID="a-1-1-1"><MEMBERS><MEMBER name="jog"/></MEMBERS></VNSUBCLASS></SUBCLASSES></VNSUBCLASS></SUBCLASSES></VNCLASS>')
    assert {tuple(r) for r in files.verb_classes(spark, f"file://{tmp_path}/v.xml").collect()} == {("a-1", "go"), ("a-1-1", "run"), ("a-1-1-1", "jog")}


def test_providers(spark):
    import hashlib

    replies = spark.createDataFrame([("speaker", hashlib.sha256(b"I lost").hexdigest(), '{"speaker":\n"she"}')], "kind string, digest string, reply string")
    asked = spark.createDataFrame([(1, "I lost"), (2, "never asked")], "key int, input string")
    got = {r["key"]: r["answer"] for r in P.Recorded(replies).answers(asked, "speaker", "speaker string").collect()}
    assert got[1]["speaker"] == "she" and got[2] is None or got[2]["speaker"] is None
    lex = P.Lexicon(spark.createDataFrame([("Jane Doe", "PERSON"), ("Wyoming", "GPE")], "name string, ner_type string"))
    ents = lex.entities(spark.createDataFrame([(1, "In Wyoming, Jane Doe won."), (2, "Jane lost.")], "key int, text string")).collect()
    assert {(r["key"], r["name"], r["place"]) for r in ents} == {(1, "Wyoming", 4), (1, "Jane Doe", 13)}
    both = P.Either(P.Recorded(replies), lex)
    asked = spark.createDataFrame([("1", "In Wyoming, Jane Doe won."), ("2", "I lost")], "key string, input string")
    got = {r["key"]: r["answer"] for r in both.answers(asked, "entities", "entities array<struct<text: string, ner_type: string>>").collect()}
    assert [tuple(x) for x in got["1"]["entities"]] == [("Wyoming", "GPE"), ("Jane Doe", "PERSON")] and got["2"] is None
    assert {r["key"]: r["answer"] and r["answer"]["speaker"] for r in both.answers(asked, "speaker", "speaker string").collect()} == {"1": None, "2": "she"}


def test_longest_names(spark):
    """Against trying every name at every place of every text; names in one block and in many."""
    import random
    import re

    r = random.Random(6)
    word = lambda: r.choice(["New", "York", "Times", "Square", "the", "U.S", "U.S.", "é", "a", "A"])
    names = {" ".join(word() for _ in range(r.randrange(1, 4))): r.choice(["GPE", "ORG"]) for _ in range(40)}
    names |= {"New York": "GPE", "New York Times": "ORG", "York": "GPE"}
    texts = ["the New York Times of New York, York", "", None, "Yorkshire NewYork New  York", "U.S.A in the U.S. York.York"] + [r.choice(["", " ", "x"]).join(word() + r.choice([" ", ", ", " - "]) for _ in range(r.randrange(1, 30))) for _ in range(120)]

    def plain(text):
        out, at = [], 0
        inside = lambda a, b: a < b and re.match(r"[\w#]", text[a]) and b and re.match(r"[\w#]", text[b])
        while at < len(text):
            fits = [n for n in names if text.startswith(n, at) and not (at and inside(at - 1, at)) and not (at + len(n) < len(text) and inside(at + len(n) - 1, at + len(n)))]
            best = max(fits, key=len, default=None)
            if best:
                out.append((best, names[best], at + 1))
            at += len(best) if best else 1
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string").repartition(3)
    want = {(k, *x) for k, t in enumerate(texts) if t for x in plain(t)}
    assert any(n == "New York Times" for _, n, *_ in want)
    kinds = spark.createDataFrame([*names.items(), ("York", "ZZZ"), ("", "ORG")], "name string, ner_type string")
    for block in (5, 1000):
        got = P.Lexicon(kinds, block).entities(df).collect()
        assert len(got) == len(want) and {(x["key"], x["name"], x["ner_type"], x["place"]) for x in got} == want
    assert P.Lexicon(kinds.limit(0)).entities(df).count() == 0


def test_containment_meets_few(spark):
    """Parts and wholes that begin alike: the join makes about as many rows as it keeps."""
    from loomgraph.operators.substring import containing

    parts = spark.createDataFrame([(f"University of Town {k}",) for k in range(1500)] + [("City 77",), ("of",), ("", ), (None,)], "part string")
    wholes = spark.createDataFrame([(f"University of City {k}",) for k in range(1500)] + [("The University of Town 1499",), (None,), ("",)], "whole string")
    pairs = containing(parts, "part", wholes, "whole")
    got = {(r["part"], r["whole"]) for r in pairs.collect()}
    want = {(p, w) for (p,) in parts.collect() for (w,) in wholes.collect() if p and w and p in w}
    assert got == want and len(want) > 1500
    made = _join_rows(pairs)
    assert max(made) <= 25 * len(wholes.collect()), made  # substrings of the wholes, none of the 2,250,000 pairs


def _join_rows(df):
    """Rows that each join of a finished plan made."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        if "Join" in p.nodeName():
            out.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return out


def test_nearest_topics(spark, monkeypatch):
    from loomgraph.operators import align as A

    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8))
    x[7] = x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)]
    v = spark.createDataFrame(rows, "k long, v array<float>").repartition(5)
    u = np.array([np.array(r[1], np.float32) for r in rows[:60]], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    np.fill_diagonal(c, -2)
    for block in (20_000, 7):
        monkeypatch.setattr(A, "BLOCK", block)
        got = {r["left"]: r["right"] for r in A.nearest(v.filter("k % 3 = 0"), v, "k", "v").collect()}
        assert got == {k: int(c[k].argmax()) for k in range(0, 60, 3)}


def test_topics_compared(spark):
    from loomgraph.operators import align as A

    t = lambda *x: spark.createDataFrame([(v,) for v in x], "topic string")
    got = {(r["left"], r["right"]) for r in A.compared(t("Gaza war", "Iran", "peace process", None), t("the war in Gaza", "Process of peace", "Gaza war today")).collect()}
    assert got == {("Gaza war", "Gaza war today"), ("Iran", None), ("peace process", "Process of peace"), (None, "the war in Gaza")}


def test_betweenness_by_joins(net):
    want = {r["node"]: r["centrality"] for r in W.betweenness(net).collect()}
    for block in (2_000, 4):
        got = {r["node"]: r["centrality"] for r in W.betweenness(net, max_edges=1, block=block).collect()}
        assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_links_come_as_packed_arrays(spark, monkeypatch):
    """Walks by arrays: links are sorted and packed by tasks, the driver collects no table of them; sides as by one step."""
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(7)
    links = np.unique(np.stack((rng.integers(0, 500, 9_000), rng.integers(500, 520, 9_000)), axis=1), axis=0)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    start, near = W._arrays(spark.createDataFrame(links.tolist(), "u int, v int"), 520, len(links))
    u, v = np.concatenate((links, links[:, ::-1])).T
    want = W._csr(u, v, 520)
    assert (start == want[0]).all() and all(sorted(near[a:b]) == sorted(want[1][a:b]) for a, b in zip(start, start[1:]))
    side = W._sides(start, near)
    assert len(set(side[:500])) == len(set(side[500:])) == 1 and side[0] != side[519]
    assert W.betweenness(spark.createDataFrame(links.tolist(), "u int, v int"), hubs=0).count() == len(np.unique(links))


def test_betweenness_by_hubs(spark, net, monkeypatch):
    """Ways between hubs, by blocks of classes, give what walks by arrays and by joins give: with twins, links between hubs,
    several components, long ways; and no row of a link or of another node comes to the driver."""
    rng = np.random.default_rng(5)
    sided = {(int(a), 1000 + int(b)) for a, b in zip(rng.integers(0, 200, 300), rng.integers(0, 12, 300))} | {(2000, 3000), (2001, 3000)}
    twins = sided | {(a + 5000, b) for a, b in sided if a < 1000} | {(1001, 1002), (1003, 1009)}
    for links in (sided, twins, {(k, k + 1) for k in range(1, 30)} | {(3, 40), (3, 41)}):
        e = spark.createDataFrame(sorted(links), "u long, v long")
        want = {r["node"]: r["centrality"] for r in W.betweenness(e, hubs=0).collect()}
        with monkeypatch.context() as m:
            m.setattr(W, "CLASSES", 40)
            m.setattr(W, "TILE", (8, 16))
            m.setattr(W, "_by_arrays", None)
            got = {r["node"]: r["centrality"] for r in W.betweenness(e).collect()}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    want = {r["node"]: r["centrality"] for r in W.betweenness(net).collect()}
    for most in (10, 1):
        got = {r["node"]: r["centrality"] for r in W.betweenness(net, max_edges=most, block=4, hubs=0).collect()}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_betweenness_of_many_sources(spark):
    """Blocks of sources over networks with and without sides, with hubs and several components, against one walk at a time."""
    from collections import deque

    rng = np.random.default_rng(3)
    sided = {(int(a), 1000 + int(b)) for a, b in zip(rng.integers(0, 300, 700), rng.integers(0, 7, 700))} | {(2000, 3000)}
    for links in (sided, sided | {(1, 2), (1000, 1001)}):
        near = {}
        for u, v in links:
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        want = dict.fromkeys(near, 0.0)
        for s in near:
            depth, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
            while queue:
                x = queue.popleft()
                order.append(x)
                for y in near[x]:
                    if y not in depth:
                        depth[y], paths[y] = depth[x] + 1, 0
                        queue.append(y)
                    if depth[y] == depth[x] + 1:
                        paths[y] += paths[x]
            share = dict.fromkeys(order, 0.0)
            for y in reversed(order[1:]):
                for x in near[y]:
                    if depth[x] == depth[y] - 1:
                        share[x] += paths[x] / paths[y] * (1 + share[y])
                want[y] += share[y]
        got = {r["node"]: r["centrality"] for r in W.betweenness(spark.createDataFrame(sorted(links), "u long, v long")).collect()}
        n = len(near)
        assert set(got) == set(want) and all(abs(got[x] - want[x] / ((n - 1) * (n - 2))) < 1e-12 for x in near)
    u, v = np.array(sorted(sided)).T
    u, v = np.unique(np.concatenate((u, v)), return_inverse=True)[1].reshape(2, -1)
    side = W._sides(*W._csr(np.concatenate((u, v)), np.concatenate((v, u)), u.max() + v.max() + 2))
    assert side is not None and (side[u] != side[v]).all()


def test_networks_of_the_queries(spark, sf):
    """Components and eigenvectors of the orders' network by plain Python."""
    from loomgraph.plans import catalogue

    links = {(f"c{r['o_custkey']}", f"{r['o_orderpriority']}{r['o_orderkey'] % 50}") for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    names = sorted({x for p in links for x in p})
    at, name = {n: k for k, n in enumerate(names)}, {n: n for n in names}
    near = {n: [] for n in names}
    for u, v in links:
        near[u].append(v)
        near[v].append(u)
    seen = set()
    for n in names:
        if n not in seen:
            front = [n]
            while front:
                x = front.pop()
                if x not in seen:
                    seen.add(x)
                    name[x] = n
                    front += near[x]
    assert {r["node"]: r["component"] for r in catalogue.QUERIES["net_components"](spark, sf).collect()} == name
    a = np.zeros((len(names), len(names)))
    for u, v in links:
        a[at[u], at[v]] = a[at[v], at[u]] = 1
    vector = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r["node"]: r["centrality"] for r in catalogue.QUERIES["net_eigenvector"](spark, sf).collect()}
    assert all(abs(got[n] - vector[at[n]]) < 1e-4 for n in names)


def test_merged_places_of_the_query(spark, sf):
    import json
    import re

    from loomgraph.plans import catalogue

    got = {r["sentence_id"]: json.loads(r["entities"]) for r in catalogue.QUERIES["adjacent_merge"](spark, sf).collect()}
    merged = 0
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        names = [(n, "LOC" if len(n) % 3 == 0 else "GPE") for n in re.findall(r"[^\W\d_]+", r["text"] or "")]
        want, k = [], 0
        while k < len(names):
            (n, c), after = names[k], names[k + 1] if k + 1 < len(names) else ("", "")
            both = c == after[1] and f"{n}, {after[0]}" in r["text"]
            want.append({"text": f"{n},{after[0]}" if both else n, "kind": c})
            merged += both
            k += 1 + both
        assert got.get(r["conv_id"] * 1000 + r["turn"], []) == want
    assert merged > 5


def test_merge_neighbours_runs(spark):
    """Runs of places, two at a time, in no Python worker, against merged_places()."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        es = [(str(rng.choice(["A", "B", "Bé"])), str(rng.choice(["GPE", "SINGGPE", "LOC", "PERSON"], p=[0.7, 0.1, 0.1, 0.1]))) for _ in range(k % 9)]
        rows.append((k, str(rng.choice(["", "A, A, B", "A, A, A, A; B, Bé, B, A"])), es))
    df = spark.createDataFrame(rows, "sentence_id long, sentence string, entities array<struct<text:string,kind:string>>")
    got = R.merge_neighbours(df)
    assert {r["sentence_id"]: [tuple(e) for e in r["entities"]] for r in got.collect()} == {k: R.merged_places(es, s) for k, s, es in rows}
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()

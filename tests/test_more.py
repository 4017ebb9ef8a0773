from loomgraph.functions import text as T
from loomgraph.operators import news as N
from loomgraph.operators import resolve as R
from loomgraph.sources import files
from pyspark.sql import functions as F


def test_ordered_definitions(spark):
    rows = [("n1", 1, 0, "the U.S. Rep. Liz Cheney's", "PERSON"), ("n1", 2, 0, "Cheney", "PERSON"), ("n1", 2, 1, "Trump", "PERSON"), ("n1", 3, 0, "nothing here", "X"), ("n2", 1, 0, "Cheney", "PERSON")]
    m = spark.createDataFrame(rows, "narrative_id string, offset long, k long, text string, kind string")
    labels = spark.createDataFrame([("Donald Trump", ":DT", 1)], "label string, iri string, seq int")
    got = {(r["narrative_id"], r["offset"], r["k"]): (r["iri"], r["is_new"]) for r in R.defined_in_order(m, labels).collect()}
    assert got == {("n1", 1, 0): (":US_Rep_Liz_Cheney", True), ("n1", 2, 0): (":US_Rep_Liz_Cheney", False), ("n1", 2, 1): (":DT", False), ("n2", 1, 0): (":Cheney", True)}


def test_small_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(T.restored(F.lit("a [Quotation1] b [Quotation2]"), "Quotation", F.array(F.lit("x"), F.lit("y")))) == "a x b y"
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert [pick(T.retry_seconds(F.lit(h), now)) for h in ("7", "Mon, 01 Jan 2024 00:01:00 GMT", "soon")] == [7, 60, 0]
    assert pick(T.reflowed(F.lit("Page 1\na\nb\n\nc"), "^Page \\d+$")) == "a b\n\nc" and pick(T.reflowed(F.lit("title\n a\nECHOES 2\nb \n\n\nc"), "ECHOES", 1)) == "a b\n\nc"
    told = "Erika (Neuman) Eckstut's town was near. Erika Eckstut left, and she took her sister; the Neumans stayed with Erika's dog."
    assert pick(T.first_person(F.lit(told), F.lit("Erika"), F.lit("Neuman"), F.lit("Eckstut"), F.lit(True))) == "my town was near. I left, and I took my sister; my family stayed with my dog."
    xml = "<g><alternateName lang='en'>Rome</alternateName><alternateName lang='it'>Roma</alternateName><alternateName lang='link'>https://en.wikipedia.org/wiki/Rome</alternateName></g>"
    names, link = T.alternate_names(F.lit(xml))
    assert pick(names) == ["Rome"] and pick(link) == "https://en.wikipedia.org/wiki/Rome"
    assert [pick(T.whole_number(F.lit(x))) for x in ("12", "1.5", "x", "")] == [12, None, None, None]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    assert pick(T.last_wins(pairs)) == {"a": 3, "b": 2} and pick(T.without_comma(F.lit("x,,"))) == "x,"
    assert pick(T.plain_extract(F.lit('a "b"\u00a0c\nd é'))) == "a 'b' c d ?"


def test_sinks_and_rows(spark, tmp_path):
    from loomgraph.sources import turtle

    g = turtle.from_text(spark, ":a :b :c .", "r", "r_g")
    files.dumped(g, spark.createDataFrame([("n", 1)], "id string, triples int"), f"file://{tmp_path}/dump")
    assert turtle.read(spark, f"file://{tmp_path}/dump/graph/part*", "r", "r_g").count() == 1
    assert spark.read.json(f"file://{tmp_path}/dump/details").first()["id"] == "n"
    (tmp_path / "m.csv").write_text("a,b\n1,x\n")
    assert tuple(files.csv_rows(spark, f"file://{tmp_path}/m.csv").first()) == ("1", "x")
    assert files.as_json(files.csv_rows(spark, f"file://{tmp_path}/m.csv", "a int, b string")).first()[0] == '{"a":1,"b":"x"}'
    t = lambda *x: spark.createDataFrame(list(x), "id int, title string, published string, source string, url string")
    same = "same title of an article over thirty characters"
    found = N.matching_articles([t((1, same, "d", "Google News", "u")), t((2, same + " too", "d", "S", "u"), (3, "another", "d", None, "u"), (4, "more", "d", "S", "u/live/1"))])
    assert {r["id"] for r in found.collect()} == {2, 3}


def test_news_replies(spark, tmp_path):
    import json

    article = lambda t, c, u: {"title": t, "content": c, "url": u, "publishedAt": "2024-01-01", "source": {"name": "S"}}
    (tmp_path / "n.json").write_text(json.dumps({"totalResults": 3, "articles": [article("a", "x [+9 chars]", files.CONSENT + "https://x/a"), article("[Removed]", "x [+1", "u"), article("b", "whole", "u")]}, indent=1))
    assert [tuple(r)[:4] for r in files.news(spark, f"file://{tmp_path}/n.json").collect()] == [("a", "2024-01-01", "S", "https://x/a")]
    (tmp_path / "t.json").write_text(json.dumps({"response": {"meta": {"hits": 1}, "docs": [{"headline": {"main": "h"}, "pub_date": "2024-01-02", "web_url": "u"}]}}))
    assert [tuple(r) for r in files.nyt(spark, f"file://{tmp_path}/t.json").collect()] == [("h", "2024-01-02", "New York Times", "u")]
    assert spark.range(1).select(files.nyt_date(F.lit("2024-01-02"))).first()[0] == "20240102"


def test_synonyms(spark, tmp_path):
    (tmp_path / "s.ttl").write_text('@prefix : <urn:loomgraph:> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n:Army :noun_synonym "military force"@en , "army"@en ; rdfs:label "Army" .\n:Join :verb_synonym "join"@en ; :other "x" .\n')
    known = files.synonyms(spark, f"file://{tmp_path}/s.ttl")
    assert {tuple(r)[:3] for r in known.collect()} == {("military force", "noun", ":Army"), ("army", "noun", ":Army"), ("Army", "label", ":Army"), ("join", "verb", ":Join")}
    asked = spark.createDataFrame([("army",), ("navy",), ("army",)], "term string")
    assert [tuple(r) for r in files.lookups(asked, known).collect()] == [("army", "noun", ":Army")]
    labels = spark.createDataFrame([("Paris", "en"), ("Ort", "de"), ("Café", "en"), ("Oz", "en"), ("King of Oz", "en"), ("in town", "en"), ("Celtic people", "en")], "label string, lang string")
    assert {r["label"] for r in files.clean_labels(labels).collect()} == {"Paris", "in town"}
    terms = spark.createDataFrame([("as a matter of fact",), ("two words",), ("As a matter",), ("of a kind (x)",)], "term string")
    assert [r["term"] for r in files.phrases(terms).collect()] == ["as a matter of fact"]
    assert [r["term"] for r in files.without_part(terms, "term", "a ").collect()] == ["two words"]


def test_table_function(spark, sf):
    from loomgraph.functions import tables

    tables.register(spark)
    more = [(-1, "Mr. A met U.S. Rep. Doe.  Then\nhe left! ?"), (-2, None), (-3, ""), (-4, "x.  y. Z. end")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    docs.createOrReplaceTempView("told")
    got = {(r["doc_id"], r["offset"], r["text"]) for r in spark.sql("SELECT d.doc_id, s.* FROM told d, LATERAL parse_narrative(d.text) s").collect()}
    want = docs.select("doc_id", F.posexplode(T.sentences(T.normalised(F.col("text")))).alias("k", "text"))
    assert got == {(r["doc_id"], r["k"] + 1, r["text"]) for r in want.collect()} and len(got) > 300

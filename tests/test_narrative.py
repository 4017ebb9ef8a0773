"""Recorded annotations to graphs, without a model in the loop: the four sentences of an article, and their graph."""

import hashlib
import json

import pytest
from loomgraph.functions import vocab as V
from loomgraph.operators import narrative as N
from loomgraph.operators import reading as R
from loomgraph.operators.entities import Knowledge
from loomgraph.operators.providers import Absent, Recorded
from pyspark.sql import functions as F

NO = {c: k for k, c in enumerate(V.EVENT_CATEGORIES, 1)}
NOUN_NO = {c: k + len(V.EVENT_CATEGORIES) - 1 for k, c in enumerate(V.NOUN_CATEGORIES, 1)}

S1 = "U.S. Rep. Liz Cheney conceded defeat Tuesday in the Republican primary in Wyoming, an outcome that was a priority for former President Donald Trump."
S2 = "Harriet Hageman, a water and natural-resources attorney who was endorsed by the former president, won 66.3% of the vote to Ms. Cheney’s 28.9%, with 95% of all votes counted."
QUOTE = "No House seat, no office in this land is more important than the principles we swore to protect,"
S3 = f"“{QUOTE}” Ms. Cheney said in her concession speech."
S4 = "She also claimed that Trump is promoting an insidious lie about the recent FBI raid of his Mar-a-Lago residence."
TEXT = f"{S1} {S2} {S3} {S4}"


class Replies:
    def __init__(self):
        self.rows = []

    def say(self, kind, text, **reply):
        self.rows.append((kind, hashlib.sha256(text.encode()).hexdigest(), json.dumps(reply)))

    def provider(self, spark):
        return Recorded(spark.createDataFrame(self.rows, "kind string, digest string, reply string"))


def noun(text, category=0, special="", singular=True, context="", opposite=False, sure=90):
    return {"text": text, "clarifying_text": context, "singular": singular, "specific_representation": special, "category_number": category, "same_or_opposite": "opposite" if opposite else "same", "correctness": sure}


def event(text, classes, nouns, future=False, modal=""):
    return {"text": text, "future_tense": future, "modal": modal, "semantics": [{"category_number": NO.get(c, 999), "same_or_opposite": "opposite" if neg else "same", "correctness": k} for c, k, neg in classes], "nouns": [{"noun_text": t, "semantic_role": r} for t, r in nouns]}


@pytest.fixture(scope="module")
def made(spark):
    a = Replies()
    named = lambda t, *found: a.say("entities", t, entities=[{"text": x, "ner_type": k} for x, k in found])
    named(S1, ("U.S.", "GPE"), ("Liz Cheney", "PERSON"), ("Tuesday", "DATE"), ("Republican", "NORP"), ("Wyoming", "GPE"), ("Donald Trump", "PERSON"))
    named(S2, ("Harriet Hageman", "PERSON"), ("noon", "TIME"), ("Cheney’s", "PERSON"))
    named(S3, ("House", "ORG"), ("Ms. Cheney", "PERSON"))
    a.say("entities", S4, entities=[{"text": "Trump", "ner_type": "PERSON"}, {"text": "FBI", "ner_type": "ORG"}, {"text": "Mar-a-Lago", "ner_type": "FAC"}])
    a.say("sentence", S4, grade_level=10, rhetorical_devices=[{"device_number": 9, "explanation": "'insidious lie'"}, {"device_number": 99, "explanation": "none"}])
    a.say("sentence", QUOTE, grade_level=10, rhetorical_devices=[{"device_number": 5, "explanation": "unique"}])
    a.say("attribution", f"{QUOTE}\n{TEXT}", speaker="Ms. Liz Cheney")
    sits = ["U.S. Rep. Liz Cheney conceded defeat in the Republican primary in Wyoming.", "No answer.", "Liz Cheney claimed that Trump is promoting an insidious lie about the recent FBI raid."]
    a.say("chronology", TEXT, events_situations=sits)
    a.say("situation", sits[0], simpler_sentences=[
        event("Liz Cheney conceded defeat.", [(":Loss", 100, False), (":CommunicationAndSpeechAct", 90, False)], [("Liz Cheney", "agent")]),
        event("The defeat was in the Republican primary on Tuesday.", [(":PoliticsRelated", 95, False), (":Loss", 85, False), (":Avoidance", 99, False)], [("defeat", "theme"), ("Republican", "location"), ("Tuesday", "time")]),
        event("The Republican primary was in Wyoming.", [(":PoliticsRelated", 90, False), (":AssessmentMeasurement", 80, False)], [("Republican", "theme"), ("Wyoming", "location")]),
    ])
    a.say("situation", sits[2], simpler_sentences=[
        event("Liz Cheney may not claim something.", [(":CommunicationAndSpeechAct", 100, True), (":AssessmentMeasurement", 80, False), ("none", 70, False)], [("Liz Cheney", "agent")], True, "can"),
        event("The lie is about the raid of Trump's Mar-a-Lago.", [(":LawEnforcement", 90, False)], [("insidious lie", "theme"), ("FBI", "source"), ("Trump's Mar-a-Lago", "location"), ("voters", "patient"), ("no details", "theme")]),
        event("It was the lie again.", [(":Win", 90, False)], [("insidious lie", "experiencer"), ("we", "agent")]),
    ])
    a.say("nouns", "Liz Cheney", noun_phrases=[noun("Liz Cheney", special="person")])
    a.say("nouns", "defeat ** Republican ** Tuesday", noun_phrases=[noun("defeat", NO[":Loss"], sure=100), noun("the Republican", special="person"), noun("Tuesday")])
    a.say("nouns", "Republican ** Wyoming", noun_phrases=[noun("Republican"), noun("Wyoming"), noun("never asked")])
    a.say("nouns", "insidious lie ** FBI ** Trump's Mar-a-Lago ** voters ** no details", noun_phrases=[noun("insidious lie", NO[":DeceptionAndDishonesty"]), noun("FBI"), noun("Trump's Mar-a-Lago", context="Trump's"), noun("voters", NOUN_NO[":Person"], singular=False, opposite=True)])
    a.say("nouns", "insidious lie ** we", noun_phrases=[noun("insidious lie"), noun("we", singular=False)])
    know = Knowledge(
        spark,
        gazetteer=spark.createDataFrame([("Wyoming", "Wyoming", "A", "ADM1", "United States", ["State of Wyoming"], "https://en.wikipedia.org/wiki/Wyoming")], "toponym string, ascii string, feature string, code string, country string, names array<string>, link string"),
        pages=spark.createDataFrame([("Wyoming", "standard", 'A "state" –\nwest', "u/Wyoming", "Q1214"), ("Liz_Cheney", "standard", "A politician", "u/LC", "Q5362573"), ("FBI", "disambiguation", "x", "u/FBI", "Q1"), ("United_States_Republican", "standard", "A political party", "u/R", "Q29468"), ("Harriet_Hageman", "standard", "x", "u/H", "Q2")], "title string, type string, extract string, url string, item string"),
        instances=spark.createDataFrame([("Q1214", "Q16562419"), ("Q5362573", "Q5"), ("Q29468", "Q7210356"), ("Q2", "Q999")], "item string, class string"),
        labels=spark.createDataFrame([("Q5362573", "en", "alias", 1, "Elizabeth Cheney"), ("Q5362573", "en", "label", 0, "Liz Cheney"), ("Q5362573", "fr", "label", 0, "Madame")], "item string, lang string, kind string, seq int, value string"),
    )
    countries = spark.createDataFrame([("United States", "geo:6252001"), ("US", "geo:6252001")], "name string, iri string")
    names = lambda x: spark.createDataFrame([(x,)], "name string")
    labels = spark.createDataFrame([], "label string, iri string, ner_type string, seq long")
    n = spark.createDataFrame([("n1", TEXT)], "narrative_id string, text string")
    return N.create_graphs(n, "foo", a.provider(spark), labels, know, countries, names("Liz"), names("Donald"))


@pytest.fixture(scope="module")
def triples(made):
    return {(r["s"], r["p"], r["o"]) for r in made.graphs.collect()}


def test_sentences_and_mentions(made, triples):
    s = {r["offset"]: r["s"] for r in made.tables.sentences.collect()}
    mentioned = {k: sorted(o for x, p, o in triples if x == v and p == ":mentions") for k, v in s.items()}
    assert [mentioned[k] for k in (1, 2, 3, 4)] == [[":Donald_Trump", ":Liz_Cheney", ":Republican", ":Wyoming", "geo:6252001"], [":Harriet_Hageman", ":Liz_Cheney"], [":House", ":Liz_Cheney"], [":Donald_Trump", ":FBI", ":Mar_a_Lago"]]
    assert sum(p == ":has_component" and x == ":Narrative_n1" for x, p, _ in triples) == len(s) == 4
    last = s[max(s)]
    assert {(last, ":grade_level", "10"), (last, ":rhetorical_device", "loaded language"), (last, ":rhetorical_device_loaded_language", "'insidious lie'")} <= triples
    quote = next(x for x, p, o in triples if p == "rdf:type" and o == ":Quote")
    assert quote.startswith(":Quotation_") and {(quote, ":attributed_to", ":Liz_Cheney"), (quote, ":text", QUOTE), (quote, ":rhetorical_device", "exceptionalism")} <= triples


def test_entities(made, triples):
    e = {r["iri"]: r for r in made.tables.entities.collect()}
    assert set(e) == {":Liz_Cheney", ":Republican", ":Wyoming", ":Donald_Trump", ":Harriet_Hageman", ":House", ":FBI", ":Mar_a_Lago"}
    of = lambda s, p: sorted(o for x, q, o in triples if x == s and q == p)
    assert of(":Liz_Cheney", "rdf:type") == [":Correction", ":Person"] and of(":Liz_Cheney", "rdfs:label") == ["Cheney", "Elizabeth Cheney", "Liz", "Liz Cheney"]
    assert of(":Liz_Cheney", ":gender") == ["female"] and of(":Donald_Trump", ":gender") == ["male"] and of(":Harriet_Hageman", ":gender") == []
    assert of(":Liz_Cheney", ":external_identifier") == ["Q5362573"] and of(":Harriet_Hageman", "rdfs:comment") == [] and of(":FBI", "rdfs:comment") == []
    assert of(":Wyoming", "rdf:type") == [":AdministrativeDivision", ":Correction", ":GeopoliticalEntity", ":PopulatedPlace"]
    assert of(":Wyoming", ":admin_level") == ["1"] and of(":Wyoming", ":country_name") == ["United States"] and ("geo:6252001", ":has_component", ":Wyoming") in triples
    assert of(":Wyoming", "rdfs:comment") == ["From Wikipedia (wikibase_item: Q1214): 'A 'state' ? west'"]
    assert of(":Republican", "rdfs:comment") == ["From Wikipedia (wikibase_item: Q29468): 'A political party'"] and of(":Republican", "rdf:type") == [":Correction", ":GroupOfAgents"]
    assert of(":Mar_a_Lago", "rdf:type") == [":AnthropogenicFeature", ":Correction", ":Location"]
    own = {(r["s"], r["p"], r["o"]) for r in made.entities.collect()}
    assert own < triples and {r["graph"] for r in made.entities.collect()} == {"foo_default"} and {r["graph"] for r in made.graphs.select("graph").distinct().collect()} == {"foo_n1"}


def test_events(made, triples):
    e = {r["text"]: r for r in made.tables.events.collect()}
    assert len(e) == 6 and "Liz Cheney may not claim." in e and made.tables.situations.count() == 3
    told = {t: r["event"] for t, r in e.items()}
    first, second, third = (told[t] for t in ("Liz Cheney conceded defeat.", "The defeat was in the Republican primary on Tuesday.", "The Republican primary was in Wyoming."))
    claim, raid, again = (told[t] for t in ("Liz Cheney may not claim.", "The lie is about the raid of Trump's Mar-a-Lago.", "It was the lie again."))
    assert {(first, ":has_next", second), (second, ":has_next", third), (first, "rdf:type", ":Loss"), (first, ":confidence-Loss", "100"), (first, ":has_active_entity", ":Liz_Cheney")} <= triples
    assert {(e["Liz Cheney conceded defeat."]["situation"], ":has_first", first), (second, ":has_time", ":PiT_DayTuesday"), (":PiT_DayTuesday", "rdf:type", ":Time"), (second, ":has_context", ":Republican")} <= triples
    assert (second, "rdf:type", ":Avoidance") not in triples and (third, ":has_topic", ":Republican") in triples and (third, ":has_location", ":Wyoming") in triples
    assert {(claim, ":future", "true"), (claim, "rdf:type", ":OpportunityAndPossibility"), (claim, ":negated-CommunicationAndSpeechAct", "true")} <= triples
    assert (claim, "rdf:type", ":AssessmentMeasurement") not in triples and (claim, "rdf:type", ":EventAndState") not in triples
    nouns = {r["name"]: r for r in made.tables.facts.filter("kind = 'noun'").collect()}
    assert set(nouns) == {"defeat", "insidious lie", "voters", "we"}
    lie, voters, we = (nouns[x]["iri"] for x in ("insidious lie", "voters", "we"))
    assert {(raid, ":has_topic", lie), (raid, ":has_source", ":FBI"), (raid, ":has_context", ":Mar_a_Lago"), (raid, ":has_affected_entity", voters), (voters, "rdf:type", ":Collection"), (voters, ":negated", "true")} <= triples
    assert {(":Mar_a_Lago", ":clarifying_text", "Trump's"), (":Mar_a_Lago", ":clarifying_reference", ":Donald_Trump")} <= triples
    assert {(again, ":has_context", lie), (again, ":has_active_entity", we), (we, "rdf:type", ":Person"), (we, ":confidence", "95")} <= triples


def test_without_annotations(spark):
    n = spark.createDataFrame([("n1", "Jane won. ? Bob lost."), ("n2", None), ("n3", "")], "narrative_id string, text string")
    labels = spark.createDataFrame([("Jane", ":Jane", "PERSON", 1)], "label string, iri string, ner_type string, seq long")
    got = N.create_graphs(n, "foo", Absent(), labels, Knowledge(spark))
    assert got.tables.sentences.count() == 3 and got.entities.count() == 0 and got.graphs.count() == 12
    none = N.create_graphs(n.filter("false"), "foo", Absent(), labels, Knowledge(spark))
    assert none.graphs.count() == 0


def test_events_in_entities(spark):
    a = Replies()
    a.say("entities", "They met at the Big Storm and Big Storm II in Paris, Texas.", entities=[{"text": "the Big Storm", "ner_type": "EVENT"}, {"text": "Paris", "ner_type": "GPE"}, {"text": "Texas", "ner_type": "GPE"}])
    a.say("entities", "Biden-Harris won, Smith-Evans lost.", entities=[{"text": "Biden-Harris", "ner_type": "PERSON"}, {"text": "Smith-Evans", "ner_type": "PERSON"}])
    a.say("noun_event", "Big Storm\nThey met at the Big Storm and Big Storm II in Paris, Texas.", category_number=NO[":DamageAndDifficulty"])
    know = Knowledge(spark, pages=spark.createDataFrame([("Big_Storm", "standard", "s", "u", "Q7")], "title string, type string, extract string, url string, item string"), instances=spark.createDataFrame([("Q7", "Q1190554")], "item string, class string"), statements=spark.createDataFrame([("Q7", "P580", "2020-01-01"), ("Q7", "P582", "2020-01-02"), ("Q7", "P31", "x")], "item string, property string, value string"))
    labels = spark.createDataFrame([("Biden", ":Biden", "PERSON", 1), ("Harris", ":Harris", "PERSON", 2)], "label string, iri string, ner_type string, seq long")
    n = spark.createDataFrame([("n1", "They met at the Big Storm and Big Storm II in Paris, Texas. Biden-Harris won, Smith-Evans lost.")], "narrative_id string, text string")
    got = {(r["s"], r["p"], r["o"]) for r in N.create_graphs(n, "foo", a.provider(spark), labels, know).graphs.collect()}
    assert {(":Big_Storm", "rdf:type", ":DamageAndDifficulty"), (":Big_Storm", ":has_beginning", ":PiT_2020-01-01"), (":Big_Storm", ":has_end", ":PiT_2020-01-02")} <= got
    assert {o for _, p, o in got if p == ":mentions"} == {":Big_Storm", ":Paris_Texas", ":Biden", ":Harris", ":Smith_Evans"}
    assert {o for s, p, o in got if s == ":Smith_Evans" and p == "rdfs:label"} == {"Smith-Evans", "Smith", "Evans"}


def test_metadata(spark):
    a = ([9, 99], [2], [1], [1], ["a", "b"], "sum", [("liberal", "glad")], "neutral", None)
    m = spark.createDataFrame([("n1", "T", "S", "not defined", None, "words", 4, a)], f"narrative_id string, title string, source string, published string, url string, text string, sentences int, answer struct<{N.CLASSIFICATION}>")
    got = {(r["p"], r["o"]) for r in N.metadata_quads(m, "foo").collect()}
    assert {(":subject_area", "politics and international"), (":narrative_goal", "analyze"), (":information_flow", "narrative/episodic"), (":narrative_plotline", "conflict and resolution"), (":topic", "a"), (":topic", "b"), (":interpretation_liberal", "glad"), (":sentiment", "neutral"), (":text", "words")} <= got and len(got) == 15


def test_preload_and_quotations(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "s string, type string, label string")
    got = {r["label"]: (r["iri"], r["class"], r["ner_type"]) for r in N.preloaded(rows((":A", ":Person", "Jo"), (":X", ":Nothing", "Q")), rows((":B", ":Location", "Jo"), (":P", ":PoliticalGroup", "Greens"))).collect()}
    assert got == {"Jo": (":B", ":Location", "LOC"), "Greens": (":P", ":PoliticalGroup", ":PoliticalGroup")}
    n = spark.createDataFrame([("n", "“No House seat is more important,,” Ms. Cheney said. She spoke of “the principles” too. “I lost,” she said of “pure delight”.")], "narrative_id string, text string")
    assert sorted((r["k"], r["text"], r["speaker"]) for r in N.quotations(n, Absent()).collect()) == [(0, "No House seat is more important,,", "Ms. Cheney"), (2, "I lost,", "she")]
    long = "A" * 120
    m = spark.createDataFrame([("n", f"“I lost,” {long} said.")], "narrative_id string, text string")
    assert N.quotations(m, Absent()).first()["speaker"] == long


def test_reader_units():
    asked = R.asked_names({"sentence": "Paris, Texas-Town", "entities": [{"text": "Paris", "ner_type": "GPE"}, {"text": "Texas-Town", "ner_type": "GPE"}], "speaker": "Müller Jr."})
    assert {("Paris,Texas-Town", "GPE"), ("Paris,Texas", "GPE"), ("Muller Jr", "")} <= asked


def test_python_and_columns_agree(spark):
    from loomgraph.functions import text as T

    said = ["the U.S. House and", "former President Trump", "Ünal's", "An Øre or", "x", "", "it’s Mary’s", "a b C d", " _lead", "trail!", "A  B", "Biden-Harris campaign", "of the Peace", "le Monde 2000", "A and"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    rows = df.select("s", T.cleaned_name(F.col("s")).alias("c"), T.base_words(F.col("s")).alias("b"), T.iri(F.col("s")).alias("i"), T.ascii_folded(F.col("s")).alias("f")).collect()
    for r in rows:
        assert (r["c"], r["b"], r["i"], r["f"]) == (T.cleaned_name_of(r["s"]), T.base_words_of(r["s"]), T.iri_of(r["s"]), T.folded(r["s"])), r["s"]
    assert T.base_words_of("Biden-Harris campaign") == "campaign" and T.base_words_of("former President Trump") == "President Trump"


def test_quotations_carry_no_narratives(spark):
    """Kinds without recorded answers are not asked for, and quotations then leave their narrative's text behind."""
    from loomgraph.operators import narrative as N
    from loomgraph.operators.providers import Absent, Recorded, annotated
    from pyspark.sql import functions as F

    table = spark.createDataFrame([("sentence", "x", "{}")], "kind string, digest string, reply string")
    n = spark.createDataFrame([("1", 'Jane Roe came. "I am here," said Jane Roe to us. ' + "more words " * 50)], "narrative_id string, text string")
    for provider in (Recorded(table), Absent()):
        q = N.quotations(n, provider)
        assert [(r["text"], r["speaker"]) for r in q.collect()] == [("I am here,", "Jane Roe")]
        assert "whole" not in q._jdf.queryExecution().optimizedPlan().toString()
        plan = annotated(n, provider, "entities", F.col("text"), N.ENTITIES, "found")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan

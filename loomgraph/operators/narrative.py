"""Narratives to graphs: sentences, quotations, situations, events, nouns, entities, metadata.

What a model would say comes from a provider: answers by kind and text, see KINDS. Texts become units in the
order of the story, reading.read() makes facts of them, and projections turn these into typed tables and quads.
What has no usable answer gives what it has without one: a sentence its text, a situation its NarrativeEvent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import vocab as V
from loomgraph.functions.ids import digest_id
from loomgraph.operators import quads as Q
from loomgraph.operators import reading as R
from loomgraph.operators import semantics as S
from loomgraph.operators.entities import Knowledge, entity_quads
from loomgraph.operators.providers import Provider, annotated, silent
from loomgraph.operators.resolve import gender
from loomgraph.operators.stored import large, stored

SEMANTICS = "array<struct<category_number: int, same_or_opposite: string, correctness: int>>"
SITUATION = f"simpler_sentences array<struct<text: string, future_tense: boolean, modal: string, semantics: {SEMANTICS}, nouns: array<struct<noun_text: string, semantic_role: string>>>>"
NOUNS = "noun_phrases array<struct<text: string, clarifying_text: string, singular: boolean, specific_representation: string, category_number: int, same_or_opposite: string, correctness: int>>"
CLASSIFICATION = "subject_areas array<int>, goal_numbers array<int>, information_flows array<int>, plotlines array<int>, topics array<string>, summary string, reader_reactions array<struct<perspective: string, reaction: string>>, sentiment string, sentiment_explanation string"
SENTENCE = "grade_level int, rhetorical_devices array<struct<device_number: int, explanation: string>>"
ENTITIES = "entities array<struct<text: string, ner_type: string>>"
#: Answers that are asked for: kind -> schema. Inputs are a sentence (entities, sentence), a narrative's text
#: (chronology, classification), a situation, an event's noun phrases joined by ' ** ' (nouns), a quotation
#: (quotation), a quotation, a line end and its narrative's text (attribution), an event's name, a line end and
#: its sentence (noun_event).
KINDS = {
    "entities": ENTITIES, "sentence": SENTENCE, "chronology": "events_situations array<string>", "classification": CLASSIFICATION, "situation": SITUATION,
    "nouns": NOUNS, "quotation": "has_subject_verb boolean", "attribution": "speaker string", "noun_event": "category_number int",
}


def sentences(narratives: DataFrame, provider: Provider) -> DataFrame:
    """(narrative_id, text) -> narrative_id, offset (from 1), text, s, entities, answer (SENTENCE).

    Sentences that are no words have no entities."""
    cut = narratives.select("narrative_id", F.posexplode(T.sentences(T.normalised(F.col("text")))).alias("k", "text"))
    cut = cut.select("narrative_id", (F.col("k") + 1).alias("offset"), T.repaired(F.col("text")).alias("text"))
    cut = cut.withColumn("s", F.concat(F.lit(":Sentence_"), digest_id("narrative_id", F.col("offset").cast("string"), "text")))
    cut = cut if hasattr(provider, "replies") else stored(cut)  # texts are cut once: what is asked for is read again
    cut = annotated(cut, provider, "entities", F.when(T.guarded(F.col("text")), F.col("text")), ENTITIES, "found")
    cut = annotated(cut, provider, "sentence", F.col("text"), SENTENCE, "answer")
    return cut.select("narrative_id", "offset", "text", "s", F.col("found.entities").alias("entities"), "answer")


#: A subject pronoun, or a finite auxiliary: what tells a clause from a phrase where no parser does.
CLAUSE = r"(?i)(?<![\w'’])(?:I|we|you|he|she|they|it|am|is|are|was|were|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must)(?![\w])|\w(?:['’](?:m|re|ve|ll|d)|n['’]t)(?!\w)"


def quotations(narratives: DataFrame, provider: Provider) -> DataFrame:
    """(narrative_id, text) -> narrative_id, k, text, s, speaker: quotes of the dominant style that hold a verb
    with a subject, by the provider, else by CLAUSE, with their speaker, else that of a 'said' beside them."""
    n = narratives.select("narrative_id", T.normalised(F.col("text")).alias("whole")).withColumn("style", T.dominant_style(F.col("whole")))
    found = F.when(F.col("style") == "straight", T.quotes(F.col("whole"), "straight")).when(F.col("style") == "single", T.quotes(F.col("whole"), "single")).when(F.col("style") == "double", T.quotes(F.col("whole"), "double"))
    q = n.select("narrative_id", "whole", F.posexplode(found).alias("k", "text")).withColumn("near", _near(F.col("whole"), F.col("text")))
    q = stored(q.drop("whole") if silent(provider, "attribution") else q)  # else a text is there once a quotation
    q = annotated(q, provider, "quotation", F.col("text"), KINDS["quotation"], "verb")
    q = q.filter(F.coalesce("verb.has_subject_verb", F.col("text").rlike(CLAUSE)))
    q = annotated(q, provider, "attribution", F.concat_ws("\n", "text", *(["whole"] if "whole" in q.columns else [])), KINDS["attribution"], "by")
    told = F.when(F.col("by.speaker").isin("error", "string"), "").otherwise(F.col("by.speaker"))
    s = F.concat(F.lit(":Quotation_"), digest_id("narrative_id", F.col("k").cast("string"), "text"))
    return q.select("narrative_id", "k", "text", s.alias("s"), F.coalesce(told, "near").alias("speaker"))


def _near(whole: Column, text: Column) -> Column:
    """The speaker by a 'said' beside a quotation's first place; empty where there is none."""
    tail = T.after_text(whole, text)
    name = r"((?:M[rs]s?\. |Dr\. )?\p{Lu}[\p{L}.-]*(?: \p{Lu}[\p{L}.-]*)*|she|he|they)"
    return F.coalesce(F.nullif(F.regexp_extract(tail, rf"^[”’\", ]*{name} (?:said|says|added|told)", 1), F.lit("")), F.nullif(F.regexp_extract(tail, rf"^[”’\", ]*(?:said|says|added) {name}", 1), F.lit("")), F.lit(""))


@dataclass
class Tables:
    """The typed tables of some narratives."""

    sentences: DataFrame  # narrative_id, offset, text, s, answer
    quotations: DataFrame  # narrative_id, k, text, s, answer
    situations: DataFrame  # narrative_id, situation, offset, text
    events: DataFrame  # narrative_id, situation, event, seq, text, future, is_first, next
    event_types: DataFrame  # narrative_id, event, class, confidence, negated
    facts: DataFrame  # see reading.FACT
    event_args: DataFrame  # narrative_id, event, predicate, noun
    entities: DataFrame  # narrative_id and entities.ENTITY


def events(situations: DataFrame) -> DataFrame:
    """(narrative_id, offset, text, answer: SITUATION) -> one row an event: its place, text, tense, types, nouns.

    types: ordered (class, confidence, negated), the modal's class first; classes: the confident ones."""
    one = situations.withColumn("situation", F.concat(F.lit(":NarrativeEvent_"), digest_id("narrative_id", F.col("offset").cast("string"), "text")))
    ev = one.select("narrative_id", "situation", F.col("offset").alias("place"), F.posexplode("answer.simpler_sentences").alias("seq", "e"))
    ev = ev.withColumn("event", F.concat(F.lit(":Event_"), digest_id("situation", F.col("seq").cast("string"))))
    text = F.when(F.endswith("e.text", F.lit(" something.")), F.replace("e.text", F.lit(" something"), F.lit(""))).otherwise(F.col("e.text"))
    ev = S.chained(ev.select("narrative_id", "situation", "place", "event", "seq", text.alias("text"), F.coalesce("e.future_tense", F.lit(False)).alias("future"), "e"))
    modal = S.modal_class(F.col("e.modal"), F.col("e.future_tense"))
    typed = lambda x: F.struct(S.category(x["category_number"], V.EVENT_CATEGORIES, ":EventAndState").alias("class"), x["correctness"].alias("confidence"), F.coalesce(x["same_or_opposite"] == "opposite", F.lit(False)).alias("negated"))
    none = F.array().cast("array<struct<class:string,confidence:int,negated:boolean>>")
    ev = ev.withColumn("kept", S.kept_classes(F.coalesce(F.transform("e.semantics", typed), none)))
    extra = F.when(modal.isNotNull(), F.array(F.struct(modal.alias("class"), F.lit(R.SURE).alias("confidence"), F.lit(False).alias("negated"))))
    ev = ev.withColumn("types", F.concat(F.coalesce(extra, none), "kept"))
    confident = F.transform(F.filter("kept", lambda x: x["confidence"] > S.CONFIDENT), lambda x: x["class"])
    return ev.withColumn("classes", confident).withColumn("roles", F.col("e.nouns")).drop("e", "kept")


def tables(narratives: DataFrame, provider: Provider, labels: DataFrame | Known, knowledge: Knowledge, countries: DataFrame | None = None, female: DataFrame | None = None, male: DataFrame | None = None) -> Tables:
    """(narrative_id, text) x labels (label, iri, ner_type, seq) -> Tables. Names of the two lists give genders.

    With Known in place of labels, narratives have an order (at) and see what those before them define."""
    s, q = stored(sentences(narratives, provider)), quotations(narratives, provider)
    q = stored(annotated(q, provider, "sentence", F.col("text"), SENTENCE, "answer"))
    told = annotated(narratives.select("narrative_id", "text"), provider, "chronology", F.col("text"), KINDS["chronology"], "told")
    sit = told.select("narrative_id", F.posexplode("told.events_situations").alias("offset", "text"))
    sit = stored(annotated(sit, provider, "situation", F.col("text"), SITUATION, "answer"))
    ev = events(sit)
    asked = F.array_join(F.array_distinct(F.transform("roles", lambda r: r["noun_text"])), " ** ")
    ev = stored(annotated(ev, provider, "nouns", asked, NOUNS, "phrases"))
    no = lambda c: F.lit(None).cast(c)
    kinds = {f.name: f.dataType for f in narratives.sparkSession.createDataFrame([], R.UNIT).schema}
    unit = lambda df, **c: df.select(*[c.get(n, no(t)).cast(t).alias(n) for n, t in kinds.items()])
    found = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["ner_type"].alias("ner_type"), F.array().cast("array<string>").alias("also")))
    zero = F.lit(0)
    units = unit(s, narrative_id=F.col("narrative_id"), phase=F.lit(0), a=F.col("offset"), b=zero, owner=F.col("s"), sentence=F.col("text"), entities=found)
    units = units.unionByName(unit(ev, narrative_id=F.col("narrative_id"), phase=F.lit(1), a=F.col("place"), b=F.col("seq"), owner=F.col("event"), classes=F.col("classes"), roles=F.col("roles"), phrases=F.col("phrases.noun_phrases")))
    units = units.unionByName(unit(q, narrative_id=F.col("narrative_id"), phase=F.lit(2), a=F.col("k"), b=zero, owner=F.col("s"), speaker=F.col("speaker")))
    units = stored(units)
    if isinstance(labels, Known):
        facts = read_in_order(units, stored(narratives.select("narrative_id", "at")), labels, provider, knowledge, countries)
    else:
        facts = stored(R.read(units, labels, provider, knowledge, countries))
    by = S.predicate(F.col("role"), F.col("classes"), F.col("class"), F.col("name"), F.col("any_agent"))
    args = facts.filter("kind = 'argument'").select("narrative_id", F.col("owner").alias("event"), by.alias("predicate"), F.col("iri").alias("noun")).filter("predicate is not null")
    return Tables(
        s, q, ev_situations(sit), ev.select("narrative_id", "situation", "event", "seq", "text", "future", "is_first", "next"),
        ev.select("narrative_id", "event", F.explode("types").alias("t")).select("narrative_id", "event", "t.*"), facts, args.distinct(),
        stored(entity_rows(facts.filter("kind = 'entity'"), knowledge, female, male)),
    )


def ev_situations(sit: DataFrame) -> DataFrame:
    return sit.select("narrative_id", F.concat(F.lit(":NarrativeEvent_"), digest_id("narrative_id", F.col("offset").cast("string"), "text")).alias("situation"), "offset", "text")


def entity_rows(found: DataFrame, knowledge: Knowledge, female: DataFrame | None = None, male: DataFrame | None = None) -> DataFrame:
    """Facts of new entities with all that is known of them, and the gender of persons by the lists of names."""
    e = found.select("narrative_id", "iri", "name", "ner_type", "base", "class", "labels")
    about = knowledge.about(e.select("name", "base"))
    e = e.join(about, ["name", "base"], "left")
    if female is not None and male is not None:
        people = gender(e.filter("base = 'PERSON'").select("name").distinct(), female, male)
        return e.join(people.withColumn("base", F.lit("PERSON")), ["name", "base"], "left")
    return e.withColumn("gender", F.lit(None).cast("string"))


def device_quads(rows: DataFrame, s: Column, r: Column, g: Column) -> DataFrame:
    """Rhetorical devices of rows with an `answer` (SENTENCE), each in one pass: its name and, where there is one, its
    explanation. Ordinals outside of the devices are left out."""
    dev = rows.select("*", F.explode("answer.rhetorical_devices").alias("d"))
    label = F.when(F.col("d.device_number") > 0, T.first_ordinal_text(V.DEVICES, F.greatest(F.col("d.device_number"), F.lit(1))))
    dev = dev.withColumn("label", label).filter("label is not null")
    what = F.struct(F.lit(":rhetorical_device").alias("p"), F.col("label").alias("o"))
    why = F.struct(F.concat(F.lit(":rhetorical_device_"), F.translate("label", " ", "_")).alias("p"), F.col("d.explanation").alias("o"))
    both = dev.select(r.alias("repo"), g.alias("graph"), s.alias("s"), F.explode(F.array(what, why)).alias("x"))
    return Q.quads(both.select("repo", "graph", "s", "x.p", "x.o", F.lit("lit").alias("o_kind")).filter("o is not null"))


def graph_quads(t: Tables, repo: str, geo: DataFrame | None = None) -> DataFrame:
    """The tables as quads of their narratives' graphs; class names in the predicate names carry a class's
    confidence and negation."""
    r, g, n = F.lit(repo), F.concat(F.lit(f"{repo}_"), F.col("narrative_id")), F.concat(F.lit(":Narrative_"), F.col("narrative_id"))
    iri, lit, num = (lambda c, k=k: (c, k) for k in ("iri", "lit", "xsd:integer"))
    true = lambda c: (F.when(c, "true"), "xsd:boolean")
    s, event, situation = F.col("s"), F.col("event"), F.col("situation")
    named = lambda df, p, o, kind="lit", of="xsd:integer", s=event: Q.quads(df.select(r.alias("repo"), g.alias("graph"), s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(of).cast("string").alias("o_type")))
    plain = F.regexp_replace("class", "^:", "")
    fact = lambda kind: t.facts.filter(F.col("kind") == kind)
    time = fact("time").withColumn("when", T.time_iri(F.col("name")))
    once = [  # one row each by the way their IRIs are made
        Q.triplify(t.sentences, n, r, g, **{":has_component": iri(s)}),
        Q.triplify(t.sentences, s, r, g, **{"rdf:type": iri(F.lit(":Sentence")), ":offset": num(F.col("offset")), ":text": lit(F.col("text")), ":grade_level": num(F.col("answer.grade_level"))}),
        Q.triplify(t.quotations, s, r, g, **{"rdf:type": iri(F.lit(":Quote")), ":text": lit(F.col("text")), ":grade_level": num(F.col("answer.grade_level"))}),
        Q.triplify(t.situations, n, r, g, **{":describes": iri(situation)}),
        Q.triplify(t.situations, situation, r, g, **{"rdf:type": iri(F.lit(":NarrativeEvent")), ":offset": num(F.col("offset")), ":text": lit(F.col("text"))}),
        Q.triplify(t.events, situation, r, g, **{":has_semantic": iri(event), ":has_first": iri(F.when(F.col("is_first"), event))}),
        Q.triplify(t.events, event, r, g, **{":text": lit(F.col("text")), ":has_next": iri(F.col("next")), ":future": true(F.col("future"))}),
    ]
    often = [
        device_quads(t.sentences, s, r, g),
        device_quads(t.quotations, s, r, g),
        Q.triplify(fact("mention"), F.col("owner"), r, g, **{":mentions": iri(F.col("iri"))}),
        Q.triplify(fact("speaker"), F.col("owner"), r, g, **{":attributed_to": iri(F.col("iri"))}),
        entity_quads(t.entities, r, g, geo),
        Q.triplify(t.event_types, event, r, g, **{"rdf:type": iri(F.col("class"))}),
        named(t.event_types, F.concat(F.lit(":confidence-"), plain), F.col("confidence")).filter("o is not null"),
        named(t.event_types.filter("negated"), F.concat(F.lit(":negated-"), plain), F.lit("true"), of="xsd:boolean"),
        named(t.event_args, F.col("predicate"), F.col("noun"), "iri", None),
        Q.triplify(fact("noun").withColumn("one", F.explode(F.split("class", ", "))), F.col("iri"), r, g, **{"rdf:type": iri(F.col("one"))}),
        Q.triplify(fact("noun"), F.col("iri"), r, g, **{":text": lit(F.col("name")), ":confidence": num(F.col("confidence")), ":negated": true(F.col("negated"))}),
        Q.triplify(fact("clarified"), F.col("iri"), r, g, **{":clarifying_text": lit(F.col("name"))}),
        named(fact("clarified").filter("reference is not null"), F.col("role"), F.col("reference"), "iri", None, F.col("iri")),
        Q.triplify(time, F.col("when"), r, g, **{"rdf:type": iri(F.lit(":Time")), ":text": lit(F.col("name"))}),
        Q.triplify(time, F.col("owner"), r, g, **{":has_time": iri(F.col("when"))}),
    ]
    return _all(once).unionByName(_all(often).dropDuplicates(Q.KEY))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metadata_quads(narratives: DataFrame, repo: str) -> DataFrame:
    """(narrative_id, title, source, published, url, text, sentences, answer: struct of CLASSIFICATION) -> quads of
    the repository's default graph. Ordinals outside of a vocabulary are left out."""
    s, r, g = F.concat(F.lit(":Narrative_"), F.col("narrative_id")), F.lit(repo), F.lit(Q.graph_name(repo))
    a = F.col("answer")
    out = Q.triplify(narratives, s, r, g, **{"rdf:type": (F.lit(":Narrative"), "iri"), "dc:title": (F.col("title"), "lit"), ":source": (F.col("source"), "lit"), "dc:created": (F.col("published"), "xsd:dateTime"), ":external_link": (F.col("url"), "lit"), ":text": (F.col("text"), "lit"), ":number_sentences": (F.col("sentences"), "xsd:integer"), ":summary": (a["summary"], "lit"), ":sentiment": (a["sentiment"], "lit"), ":sentiment_explanation": (F.when(a["sentiment"].isNotNull(), a["sentiment_explanation"]), "lit")})
    for p, column, labels in ((":subject_area", "subject_areas", V.SUBJECTS), (":narrative_goal", "goal_numbers", V.GOALS), (":information_flow", "information_flows", V.FLOWS), (":narrative_plotline", "plotlines", V.PLOTLINES)):
        row = narratives.withColumn("k", F.explode(a[column])).withColumn("label", F.when(F.col("k") > 0, T.first_ordinal_text(labels, F.greatest(F.col("k"), F.lit(1)))))
        out = out.unionByName(Q.triplify(row, s, r, g, **{p: (F.col("label"), "lit")}))
    out = out.unionByName(Q.triplify(narratives.withColumn("topic", F.explode(a["topics"])), s, r, g, **{":topic": (F.col("topic"), "lit")}))
    react = narratives.select(s.alias("s"), F.explode(a["reader_reactions"]).alias("x"))
    react = react.select(r.alias("repo"), g.alias("graph"), "s", F.concat(F.lit(":interpretation_"), "x.perspective").alias("p"), F.col("x.reaction").alias("o"), F.lit("lit").alias("o_kind"))
    return out.unionByName(Q.quads(react).filter("p is not null and o is not null")).dropDuplicates(Q.KEY)


# Classes that groups of people by nationality, religion or politics have.
GROUP_CLASSES = [":Ethnicity", ":ReligiousGroup", ":PoliticalGroup", ":PoliticalIdeology", ":ReligiousBelief", ":GroupOfAgents"]


def _typed(manual: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections of the server (rank 0) and of a repository (1) with the entity type of their class; types that no
    entity type has are left out. A group's type is its class."""
    kind = F.create_map(*[F.lit(x) for k, v in V.NER_CLASS.items() if k != "NORP" for x in (v, k)])
    ner = F.when(F.col("type").isin(GROUP_CLASSES), F.col("type")).otherwise(F.try_element_at(kind, F.col("type")))
    return manual.withColumn("rank", F.lit(0)).unionByName(corrections.withColumn("rank", F.lit(1))).withColumn("ner", ner).filter("ner is not null")


def preloaded(manual: DataFrame, corrections: DataFrame) -> DataFrame:
    """(s, type, label) of the server's and of a repository's corrections -> (label, iri, class, ner_type, seq): a
    repository's entry hides the server's."""
    got = _typed(manual, corrections).groupBy("label").agg(F.max_by(F.struct(F.col("s").alias("iri"), F.col("type").alias("class"), F.col("ner").alias("ner_type")), F.struct("rank", "s", "type")).alias("k"), F.min("rank").alias("rank"))
    return got.select("label", "k.iri", "k.class", "k.ner_type", F.col("rank").cast("long").alias("seq"))


def corrections(store: DataFrame) -> DataFrame:
    """(s, type, label) of the subjects that are corrections."""
    s = store.filter(F.col("p").isin("rdf:type", "rdfs:label")).groupBy("s").agg(F.collect_set(F.when(F.col("p") == "rdf:type", F.col("o"))).alias("types"), F.collect_set(F.when(F.col("p") == "rdfs:label", F.col("o"))).alias("labels"))
    s = s.filter(F.array_contains("types", ":Correction")).select("s", F.explode("types").alias("type"), "labels")
    return s.filter("type <> ':Correction'").select("s", "type", F.explode("labels").alias("label"))


#: Before every place of an order of narratives.
FIRST = ""


@dataclass
class Known:
    """What is known of names before narratives that have an order: corrections of the server, and the types and labels of
    a repository's subjects. Places in the order are texts; what a narrative defines is known to those after it."""

    manual: DataFrame  # s, type, label
    store: DataFrame  # quads

    def facts(self, defined: DataFrame | None) -> DataFrame:
        """(s, p, o, at): types and labels, each with the first place that gave it."""
        first = self.store.select("s", "p", "o", F.lit(FIRST).alias("at"))
        rows = first if defined is None else first.unionByName(defined)
        return rows.filter(F.col("p").isin("rdf:type", "rdfs:label")).groupBy("s", "p", "o").agg(F.min("at").alias("at"))

    def versions(self, defined: DataFrame | None = None) -> DataFrame:
        """preloaded() at every place: label, iri, class, ner_type, seq, since, until. A type and a label of a subject hold
        from the later one of both on; a label's entry may change with each place that says something of it."""
        f = self.facts(defined)
        kinds, labels = f.filter("p = 'rdf:type'"), f.filter("p = 'rdfs:label'").select("s", F.col("o").alias("label"), F.col("at").alias("b"))
        subjects = kinds.filter("o = ':Correction'").select("s", F.col("at").alias("c"))
        own = kinds.filter("o <> ':Correction'").select("s", F.col("o").alias("type"), F.col("at").alias("a")).join(large(subjects), "s").join(large(labels), "s")
        own = own.select("s", "type", "label", F.greatest("a", "b", "c").alias("at"))
        both = _typed(self.manual.select("s", "type", "label", F.lit(FIRST).alias("at")), own)
        best = F.max(F.struct("rank", "s", "type", F.col("ner").alias("ner_type")))
        by_place = both.groupBy("label", "at").agg(best.alias("best"), F.min("rank").alias("seq"))
        ordered = Window.partitionBy("label").orderBy("at")
        run = by_place.select("label", "at", F.max("best").over(ordered).alias("best"), F.min("seq").over(ordered).alias("seq"))
        entry = F.struct("best", "seq")
        new = run.withColumn("before", F.lag(entry).over(ordered)).filter(F.col("before").isNull() | (F.col("before") != entry))
        new = new.withColumn("until", F.lead("at").over(ordered))
        return new.select("label", F.col("best.s").alias("iri"), F.col("best.type").alias("class"), "best.ner_type", F.col("seq").cast("long").alias("seq"), F.col("at").alias("since"), "until")


def definitions(facts: DataFrame, order: DataFrame, knowledge: Knowledge) -> DataFrame:
    """(s, p, o, at): types and labels of the entities that narratives define, with their places."""
    found = entity_rows(facts.filter("kind = 'entity'"), knowledge)
    named = entity_quads(found, F.lit(""), F.col("narrative_id")).filter(F.col("p").isin("rdf:type", "rdfs:label"))
    return named.join(order, F.col("graph") == F.col("narrative_id")).select("s", "p", "o", "at").distinct()


def read_in_order(units: DataFrame, order: DataFrame, known: Known, provider: Provider, knowledge: Knowledge, countries: DataFrame | None = None) -> DataFrame:
    """Facts of narratives that see what those before them define, as if they were read one after the other.

    All are read at once, with what the reading before has found defined, until that stays the same: after k
    readings the first k narratives are right, and mostly all are after two or three. No task holds the dictionary."""
    n = order.count()
    several, defined = n > 1, None
    for _ in range(n + 2):
        labels = stored(known.versions(defined))  # several joins read it
        facts = stored(R.read(units, labels, provider, knowledge, countries, order))
        if not several:
            return facts
        new = stored(definitions(facts, order, knowledge))
        if defined is None and new.isEmpty():
            return facts
        if defined is not None and new.count() == defined.count() and new.join(defined, ["s", "p", "o", "at"], "left_anti").isEmpty():
            return facts
        defined = new
    raise AssertionError("definitions of narratives in order have to settle")


@dataclass
class Created:
    """A batch's result: typed tables, quads of the narratives' graphs, entities for the repository's default graph."""

    tables: Tables
    graphs: DataFrame
    entities: DataFrame


def create_graphs(narratives: DataFrame, repo: str, provider: Provider, labels: DataFrame | Known, knowledge: Knowledge, countries: DataFrame | None = None, female: DataFrame | None = None, male: DataFrame | None = None) -> Created:
    """(narrative_id, text) -> the narratives' graphs. With labels narratives don't see what others of their batch define; with
    Known and a place each (at) they do, as if they came one after the other."""
    t = tables(narratives, provider, labels, knowledge, countries, female, male)
    return Created(t, graph_quads(t, repo, countries), entity_quads(t.entities, F.lit(repo), F.lit(Q.graph_name(repo)), countries))

"""Reading narratives in order: what a narrative's sentences, events and quotations mention, and what they define.

A mention can match what was known before and what the narrative defined up to there. The first part, and all
that is known of names, is joined before, distributed; only a narrative's own definitions are made in order, by
one task a narrative. The result is rows of facts, which are turned into tables and quads by projections."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vocab as V
from loomgraph.functions.text import cleaned_name_of, folded, iri_of
from loomgraph.operators.entities import Knowledge
from loomgraph.operators.providers import Provider, annotated
from loomgraph.operators.resolve import Dictionary, merged_places, resolved, split_known
from loomgraph.operators.stored import stored

#: One unit: a sentence (phase 0), an event (1) or a quotation (2); its place in its phase is (a, b).
UNIT = (
    "narrative_id string, phase int, a int, b int, owner string, sentence string, entities array<struct<text: string, ner_type: string, also: array<string>>>, "
    "classes array<string>, roles array<struct<noun_text: string, semantic_role: string>>, phrases array<struct<text: string, clarifying_text: string, singular: boolean, "
    "specific_representation: string, category_number: int, same_or_opposite: string, correctness: int>>, speaker string"
)
#: kind: mention, entity, noun, argument, time, clarified, speaker.
FACT = (
    "narrative_id string, kind string, owner string, iri string, name string, ner_type string, base string, class string, labels array<string>, classes array<string>, "
    "role string, any_agent boolean, confidence int, negated boolean, reference string, phase int"
)
_COLUMNS = [c.split()[0] for c in FACT.replace("array<string>", "array").split(", ")]

# What a specific representation stands for, its entity type, and the confidence of both.
SPECIFIC = {"person": ":Person", "geopolitical entity": ":GeopoliticalEntity", "location": ":Location", "occupation": ":LineOfBusiness"}
SPECIFIC_TYPE = {"person": "PERSON", "geopolitical entity": "LOC", "location": "LOC", "occupation": ""}
SPEAKERS = ["I", "We", "we", "me", "us", "You", "you"]
SURE = 95
NOUN_CLASSES = V.EVENT_CATEGORIES[:-1] + V.NOUN_CATEGORIES


def base_type(ner_type: str) -> str:
    for part in ("PLURAL", "SING", "FEMALE", "MALE"):
        ner_type = ner_type.replace(part, "")
    return ner_type


def class_of_type(ner_type: str) -> str:
    """Class string of a new entity; every one can be a correction later."""
    plural = ", :Collection" if "PLURAL" in ner_type else ""
    return f"{V.NER_CLASS[base_type(ner_type)]}, :Correction{plural}"


def _units(pdf: pd.DataFrame) -> Iterator[dict]:
    for x in pdf["unit"]:
        yield json.loads(x)


def _entities(unit: dict) -> list[tuple]:
    return [(e["text"], e["ner_type"], e.get("also") or []) for e in unit.get("entities") or [] if e.get("text") and base_type(e.get("ner_type") or "") in V.NER_CLASS]


def asked_names(unit: dict) -> set[tuple[str, str]]:
    """(name, base type or '') of all that reading a unit may look up."""
    out, sentence, entities = set(), unit.get("sentence") or "", _entities(unit)
    for text, kind, _ in entities:
        for part in {text, *text.split("-")}:
            out |= {(part, ""), (cleaned_name_of(part), base_type(kind))}
    pairs = []
    for text, kind, _ in entities:  # neighbours, however hyphens are split
        parts = text.split("-")
        pairs += [(t, u, kind) for t, u in zip(parts, parts[1:])] + [(text, parts[0], kind)]
    for (t, kind, _), (u, _, _) in zip(entities, entities[1:]):
        pairs += [(x, y, kind) for x in {t, t.split("-")[-1]} for y in {u, u.split("-")[0]}]
    out |= {(cleaned_name_of(f"{t},{u}"), base_type(kind)) for t, u, kind in pairs if f"{t}, {u}" in sentence}
    for p in unit.get("phrases") or []:
        text, context = p.get("text") or "", p.get("clarifying_text") or ""
        out |= {(text.replace(context, "").strip() if context else text, ""), (context, "")}
    if unit.get("speaker"):
        out.add((folded(unit["speaker"].replace(".", "")), ""))
    return {x for x in out if x[0]}


def _digest(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:13]


class Reader:
    """One narrative's pass. before: see Dictionary; about: (name, base) -> labels by its place and description
    and whether it has a place; event_class: (owner, name) -> class."""

    def __init__(self, narrative_id: str, before: dict, about: dict, event_class: dict):
        self.id, self.book, self.about, self.event_class, self.out = narrative_id, Dictionary(before), about, event_class, []

    def fact(self, kind: str, owner: str, iri: str, phase: int, **more) -> None:
        self.out.append({"narrative_id": self.id, "kind": kind, "owner": owner, "iri": iri, "phase": phase, **more})

    def entities(self, unit: dict) -> None:
        sentence = unit.get("sentence") or ""
        listed = split_known(_entities(unit), self.book.exact)
        for text, kind, also in merged_places(listed, sentence) if sentence else listed:
            name = cleaned_name_of(text)
            if not name:
                continue
            hit = self.book.find(name)
            iri = hit[0] if hit else self.defined(unit, name, kind, also)
            if iri:
                self.fact("mention", unit["owner"], iri, unit["phase"], name=name)

    def defined(self, unit: dict, name: str, kind: str, also: list[str]) -> str | None:
        """A new entity; dates define nothing."""
        base = base_type(kind)
        if base == "DATE":
            return None
        about = self.about.get((name, base), {})
        labels = [*also, *about.get("names", ()), *about.get("labels", ()), name] if about.get("placed") else [*about.get("labels", ()), name, *also]
        if base == "PERSON":
            labels += [p for word in name.split() for p in word.split("-")]
        labels, iri = list(dict.fromkeys(x for x in labels if x)), iri_of(name)
        kept = class_of_type(kind) if base != "EVENT" else self.event_class.get((unit["owner"], name), ":EventAndState")
        self.book.define(labels, iri, "LOC" if base == "ORG" and about.get("placed") else kind)
        self.fact("entity", unit["owner"], iri, unit["phase"], name=name, ner_type=kind, base=base, labels=labels, **{"class": kept})
        return iri

    def nouns(self, unit: dict) -> None:
        roles = {r["noun_text"]: r.get("semantic_role") or "" for r in unit.get("roles") or [] if r.get("noun_text")}
        classes, any_agent = unit.get("classes") or [], "agent" in roles.values()
        for p in unit.get("phrases") or []:
            text, context = p.get("text") or "", p.get("clarifying_text") or ""
            phrase = text if text in roles else text.partition(" ")[2]
            if phrase not in roles:
                continue
            if roles[phrase] == "time":
                self.fact("time", unit["owner"], "", 1, name=phrase)
                continue
            hit, kind = self.book.find(text.replace(context, "").strip() if context else text), "owl:Thing"
            if hit:
                iri = hit[0]
                kind = next((c for k, c in V.NER_CLASS.items() if k in (hit[1] or "")), kind)
            else:
                iri, kind = self.new_noun(unit, p)
            if context:
                known = self.book.find(context)
                by = ":affiliated_with" if any(":Affiliation" in c for c in classes) or ":Affiliation" in kind else ":clarifying_reference"
                self.fact("clarified", unit["owner"], iri, 1, name=context, role=by, reference=known[0] if known else None)
            self.fact("argument", unit["owner"], iri, 1, name=phrase, role=roles[phrase], any_agent=any_agent, classes=classes, **{"class": kind})

    def new_noun(self, unit: dict, p: dict) -> tuple[str, str]:
        """A phrase of its own: a specific representation, the one who tells, else its category."""
        text, special, number = p["text"], p.get("specific_representation"), p.get("category_number") or 0
        iri = f":Noun_{_digest(self.id, unit['owner'], text)}"
        sure, opposite = SURE, False
        if special in SPECIFIC and text.lower().startswith("narrator"):
            kind = ":Person" if text.lower() == "narrator" else ":Person, :Collection"
            self.book.define([text], iri, "PLURALPERSON")
        elif special in SPECIFIC:
            kind = SPECIFIC[special]
            self.book.define([text.replace(".", "")], iri, SPECIFIC_TYPE[special])
        elif text in SPEAKERS:
            kind = ":Person"
            self.book.define([text], iri, "PERSON")
        else:
            self.book.define([text.replace(".", "")], iri, "")
            kind = NOUN_CLASSES[number - 1] if 0 < number <= len(NOUN_CLASSES) else "owl:Thing"
            sure = 0 if kind == "owl:Thing" else p.get("correctness") or 0
            opposite = p.get("same_or_opposite") == "opposite"
        if p.get("singular") is False and ":Collection" not in kind:
            kind += ", :Collection"
        self.fact("noun", unit["owner"], iri, 1, name=text, confidence=sure, negated=opposite, **{"class": kind})
        return iri, kind

    def speaker(self, unit: dict) -> None:
        hit = self.book.find(folded(unit["speaker"].replace(".", "")))
        if hit:
            self.fact("speaker", unit["owner"], hit[0], 2)

    def read(self, units: list[dict]) -> list[dict]:
        for u in sorted(units, key=lambda u: (u["phase"], u["a"], u["b"])):
            self.entities(u)
            if u["phase"] == 1:
                self.nouns(u)
            if u.get("speaker"):
                self.speaker(u)
        return self.out


def read(units: DataFrame, labels: DataFrame, provider: Provider, knowledge: Knowledge, countries: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """UNIT rows x labels (label, iri, ner_type, seq) -> FACT rows. Countries: (name, iri).

    order (narrative_id, at): each narrative sees the labels that were known at its place, see resolved()."""
    # most sentences name nothing: they have no facts
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    told = size("entities") | size("phrases") | (F.coalesce("speaker", F.lit("")) != "")
    units = units.filter(F.coalesce(told, F.lit(False)))
    packed = units.select("narrative_id", F.to_json(F.struct(*units.columns)).alias("unit"))

    def names(batches):
        for b in batches:
            rows = [(i, u["owner"], u.get("sentence") or "", n, k) for i, u in zip(b["narrative_id"], _units(b)) for n, k in sorted(asked_names(u))]
            yield pd.DataFrame(rows, columns=["narrative_id", "owner", "sentence", "name", "base"])

    asked = stored(packed.mapInPandas(names, "narrative_id string, owner string, sentence string, name string, base string"))
    if order is None:
        typed = labels.groupBy("iri", "label").agg(F.min("ner_type").alias("ner_type")).withColumnRenamed("iri", "known_iri").withColumnRenamed("label", "known_label")
        key, of_type = ["name"], (F.col("iri") == F.col("known_iri")) & (F.col("label") == F.col("known_label"))
    else:
        asked = asked.join(order, "narrative_id")
        typed = labels.select(F.col("iri").alias("known_iri"), F.col("label").alias("known_label"), "ner_type", "since", "until")
        then = (F.col("since") < F.col("at")) & (F.col("until").isNull() | (F.col("at") <= F.col("until")))
        key, of_type = ["name", "at"], (F.col("iri") == F.col("known_iri")) & (F.col("label") == F.col("known_label")) & then
    before = resolved(asked.select(F.col("name").alias("mention"), *key[1:]), labels, countries).filter("iri is not null")
    before = before.join(typed, of_type, "left")
    before = before.select(F.col("mention").alias("name"), *key[1:], F.array("iri", F.coalesce("ner_type", F.lit("")), F.col("priority").cast("string"), "label").alias("known"))
    about = knowledge.about(asked.filter("base <> ''").select("name", "base"))
    about = about.filter("location is not null or description is not null").select("name", "base", F.struct(F.col("location").isNotNull().alias("placed"), F.col("location.names").alias("names"), F.col("description.labels").alias("labels")).alias("about"))
    happened = asked.filter("base = 'EVENT'").select("narrative_id", "owner", "name", "base", F.concat_ws("\n", "name", "sentence").alias("input"))
    happened = annotated(happened, provider, "noun_event", F.col("input"), "category_number int", "answer")
    happened = happened.select("narrative_id", "owner", "name", "base", event_category(F.col("answer.category_number")).alias("event"))
    rows = asked.select("narrative_id", "owner", "name", "base", *key[1:]).distinct().join(before, key, "left").join(about, ["name", "base"], "left").join(happened, ["narrative_id", "owner", "name", "base"], "left")
    given = rows.filter("known is not null or about is not null or event is not null").select("narrative_id", F.to_json(F.struct("owner", "name", "base", "known", "about", "event")).alias("given"))

    def of(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        before, about, event = {}, {}, {}
        for g in map(json.loads, right["given"]):
            if g.get("known"):
                iri, kind, rank, label = g["known"]
                before[g["name"]] = (iri, kind, int(rank), label)
            if g.get("about"):
                about[(g["name"], g["base"])] = g["about"]
            if g.get("event"):
                event[(g["owner"], g["name"])] = g["event"]
        facts = Reader(key[0], before, about, event).read(list(_units(left)))
        return pd.DataFrame([[f.get(c) for c in _COLUMNS] for f in facts], columns=_COLUMNS, dtype=object)

    return packed.groupBy("narrative_id").cogroup(given.groupBy("narrative_id")).applyInPandas(of, FACT)


def event_category(number: Column) -> Column:
    """Class of an event's ordinal; the last one, like all that are none, is the general class."""
    return F.coalesce(F.when((number > 0) & (number < len(V.EVENT_CATEGORIES)), F.try_element_at(F.array(*[F.lit(x) for x in V.EVENT_CATEGORIES]), F.greatest(number, F.lit(1)))), F.lit(":EventAndState"))

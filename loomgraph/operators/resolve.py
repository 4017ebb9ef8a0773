"""Entity resolution: mentions to known labels, by priority and then by the order of labels.

1 a country's name, 2 the label itself, 3 a label inside of the mention's base words, 4 the mention's base
words inside of a label. Exact matches are equi-joins; only what they leave enters the containment joins,
which are equi-joins on short substrings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import base_words, base_words_of, cleaned_name, iri_of
from loomgraph.operators.stored import large, stored
from loomgraph.operators.substring import containing


def resolved(mentions: DataFrame, labels: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """mentions (mention) x labels (label, iri, seq) x countries (name, iri) -> mention, iri, priority, label.

    Mentions without a match have a null iri and priority 5. Repeated mentions are resolved once; null ones
    are left out, an empty one matches nothing. Of equals the least seq, then the least iri wins.

    Where mentions have a place in an order (at) and labels are known after one (since) and up to another (until; null:
    for good), each mention is resolved by what was known at its place, and the result has at, too."""
    timed = "at" in mentions.columns
    key = ["mention", "at"] if timed else ["mention"]
    valid = (F.col("since") < F.col("at")) & (F.col("until").isNull() | (F.col("at") <= F.col("until"))) if timed else F.lit(True)
    m = mentions.select(key).where("mention is not null").distinct()
    labels = labels.select("label", F.col("iri").alias("label_iri"), F.col("seq").cast("long").alias("seq"), *(["since", "until"] if timed else [])).filter("label <> ''")
    named = m.join(large(labels), F.col("mention") == F.col("label")).filter(valid)
    exact = named.groupBy(key).agg(F.min(F.struct("seq", "label_iri"))["label_iri"].alias("label_iri"))
    got = m.join(large(exact), key, "left")
    if countries is not None:
        named = countries.groupBy(F.col("name").alias("mention")).agg(F.min("iri").alias("country_iri"))
        got = got.join(named, "mention", "left")
    else:
        got = got.withColumn("country_iri", F.lit(None).cast("string"))
    got = got.withColumn("iri", F.coalesce("country_iri", "label_iri")).withColumn("priority", F.when(F.col("country_iri").isNotNull(), 1).when(F.col("label_iri").isNotNull(), 2))
    known = F.col("mention") != ""
    done = got.filter(F.col("iri").isNotNull() & known).select(*key, "iri", "priority", F.col("mention").alias("label"))
    rest = stored(got.filter(F.col("iri").isNull() & known).select(*key, base_words(F.col("mention")).alias("base")))  # both searches read it often
    inside = containing(labels, "label", rest, "base").withColumn("priority", F.lit(3))
    around = containing(rest, "base", labels, "label").withColumn("priority", F.lit(4))
    hit = inside.unionByName(around).filter(valid).groupBy(key).agg(F.min(F.struct("priority", "seq", "label_iri", "label")).alias("b"))
    found = done.unionByName(hit.select(*key, F.col("b.label_iri").alias("iri"), "b.priority", "b.label"))
    return m.join(large(found), key, "left").withColumn("priority", F.coalesce("priority", F.lit(5)))


def phrase_or_rest(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase) looked up in known (phrase, role), else without its first word; no match drops the row."""
    short = F.regexp_replace("phrase", r"^\S+ ", "")
    k1, k2 = known.select(F.col("phrase").alias("p1"), F.col("role").alias("r1")), known.select(F.col("phrase").alias("p2"), F.col("role").alias("r2"))
    p = phrases.withColumn("short", F.when(F.contains("phrase", F.lit(" ")), short))
    p = p.join(k1, F.col("phrase") == F.col("p1"), "left").join(k2, F.col("short") == F.col("p2"), "left")
    return p.withColumn("role", F.coalesce("r1", "r2")).filter("role is not null").select("phrase", "role")


def hyphen_parts(mentions: DataFrame, known: DataFrame, keep_known: bool = False) -> DataFrame:
    """(mention) with '-' split into its parts if all of them are known (name); others stay whole.

    keep_known also keeps a mention that is known as a whole, so one that is split stays beside its parts."""
    p = mentions.select("mention").distinct().withColumn("part", F.explode(F.split("mention", "-")))
    k = known.select(F.col("name").alias("part")).distinct().withColumn("hit", F.lit(True))
    p = p.join(k, "part", "left")
    every = p.groupBy("mention").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all_known"))
    p = p.join(every, "mention")
    got = p.filter("all_known").select("mention", "part").unionByName(every.filter("not all_known").select("mention", F.col("mention").alias("part")))
    if keep_known:
        whole = k.select(F.col("part").alias("mention")).join(every.filter("all_known and contains(mention, '-')"), "mention", "left_semi")
        got = got.unionByName(whole.select("mention", F.col("mention").alias("part")))
    return got


def merged_places(entities: list[tuple], sentence: str) -> list[tuple]:
    """Neighbouring places (text, type, ...) of one type that the sentence has as 'a, b' become one 'a,b'; two
    are taken at a time, and what else they had is empty."""
    out, k = [], 0
    while k < len(entities):
        text, kind, *more = entities[k]
        if k + 1 < len(entities) and ("GPE" in kind or "LOC" in kind) and entities[k + 1][1] == kind and f"{text}, {entities[k + 1][0]}" in sentence:
            out.append((f"{text},{entities[k + 1][0]}", kind, *([] for _ in more)))
            k += 2
        else:
            out.append(tuple(entities[k]))
            k += 1
    return out


def merge_neighbours(rows: DataFrame) -> DataFrame:
    """sentence_id, sentence, entities array<struct<text,kind>> -> the same with merged places, see merged_places().

    A mark for each entity says whether it can be merged with the next; of a run of such, every second one is taken."""
    after = lambda k: F.get("entities", k + 1)
    place = lambda x, k: (F.contains(x["kind"], F.lit("GPE")) | F.contains(x["kind"], F.lit("LOC"))) & (after(k)["kind"] == x["kind"])
    both = lambda x, k: F.contains("sentence", F.concat(x["text"], F.lit(", "), after(k)["text"]))
    marks = F.transform("entities", lambda x, k: F.when(place(x, k) & both(x, k), "1").otherwise("0"))
    marked = rows.select("sentence_id", "sentence", "entities", F.split(F.regexp_replace(F.array_join(marks, ""), "1.", "1-"), "").alias("marks"))
    one = lambda x, k: F.struct(F.when(F.get("marks", k) == "1", F.concat(x["text"], F.lit(","), after(k)["text"])).otherwise(x["text"]).alias("text"), x["kind"].alias("kind"))
    merged = F.filter(F.transform("entities", lambda x, k: F.when(F.get("marks", k) != "-", one(x, k))), lambda x: x.isNotNull())
    return marked.select(F.col("sentence_id").cast("long").alias("sentence_id"), "sentence", merged.alias("entities"))


def gender(names: DataFrame, female: DataFrame, male: DataFrame) -> DataFrame:
    """(name) -> FEMALE or MALE by its first word, the female list first; empty for neither."""
    first = F.element_at(F.split("name", " "), 1)
    f, m = (x.select(F.col("name").alias(c)).distinct() for x, c in ((female, "f"), (male, "m")))
    got = names.withColumn("first", first).join(f, F.col("first") == F.col("f"), "left").join(m, F.col("first") == F.col("m"), "left")
    return got.select("name", F.when(F.col("f").isNotNull(), "FEMALE").when(F.col("m").isNotNull(), "MALE").otherwise("").alias("gender"))


class Dictionary:
    """A narrative's dictionary while it is read: what was known before, found by name, and what it defines.

    before: name -> (iri, ner_type, priority, label), see resolved(); own labels hide equal ones from before."""

    def __init__(self, before: dict):
        self.before, self.own = before, {}

    def find(self, text: str) -> tuple[str, str | None] | None:
        """(iri, ner_type) of a text: a country, an exact label, a label in the base words, the base words in
        a label; what was known before goes ahead of what the narrative defines."""
        known = self.before.get(text)
        rank = known[2] if known else 9
        if known and known[3] in self.own and rank > 1:
            known = (*self.own[known[3]], rank, known[3])
        if not text or rank == 1:
            return known[:2] if known else None
        if text in self.own:
            return self.own[text]
        if rank == 2:
            return known[:2]
        base = base_words_of(text)
        if rank == 3:
            return known[:2]
        hit = next((x for label, x in self.own.items() if label in base), None)
        if hit is None and rank == 4:
            return known[:2]
        return hit or next((x for label, x in self.own.items() if base in label), None)

    def exact(self, text: str) -> bool:
        known = self.before.get(text)
        return text in self.own or bool(known and known[2] == 2)

    def define(self, labels: list[str], iri: str, ner_type: str) -> None:
        for label in labels:
            if label:
                self.own[label] = (iri, ner_type)


def split_known(entities: list[tuple], known) -> list[tuple]:
    """(text, ner_type, ...) with hyphens split into parts if all are known; one known as a whole stays, too."""
    out = []
    for e in entities:
        parts = e[0].split("-")
        if len(parts) == 1:
            out.append(e)
            continue
        if known(e[0]):
            out.append(e)
        out += [(p, *e[1:]) for p in parts] if all(map(known, parts)) else [e]
    return out


def defined_in_order(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """(narrative_id, offset, k, text, kind) against (label, iri, seq) -> the same with iri and is_new.

    The dictionary grows while a narrative is read: a mention that no label matches defines an entity that
    the narrative's later mentions can match. Known labels are matched before, by distributed joins; only a
    narrative's own definitions are made in order, by one task a narrative: its mentions in turn."""
    rows = mentions.withColumn("name", cleaned_name(F.col("text"))).filter("name <> ''")
    known = resolved(rows.select(F.col("name").alias("mention")), labels).filter("iri is not null")
    rows = rows.join(known.select(F.col("mention").alias("name"), F.struct("iri", "priority", "label").alias("known")), "name", "left")

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        book, out = Dictionary({}), []
        for r in pdf.sort_values(["offset", "k"]).itertuples(index=False):
            if r.known is not None:
                book.before[r.name] = (r.known["iri"], r.kind, r.known["priority"], r.known["label"])
            hit = book.find(r.name)
            if hit is None:
                book.define([r.name], iri_of(r.name), r.kind)
            out.append((r.narrative_id, r.offset, r.k, r.text, r.kind, hit[0] if hit else iri_of(r.name), hit is None))
        return pd.DataFrame(out, columns=["narrative_id", "offset", "k", "text", "kind", "iri", "is_new"])

    return rows.groupBy("narrative_id").applyInPandas(of, "narrative_id string, offset long, k long, text string, kind string, iri string, is_new boolean")

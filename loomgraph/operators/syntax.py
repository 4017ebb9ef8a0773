"""Patterns in parsed sentences, and pronouns resolved by a provider.

A parse is an array of tokens (text, lemma, pos, dep, head: the index of the token it hangs on, its own for a
root, ent: entity type). Sentences are small, so a sentence's tree is searched in one go, in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vocab as V
from loomgraph.operators.providers import Provider, annotated

TOKENS = "array<struct<text: string, lemma: string, pos: string, dep: string, head: int, ent: string>>"
COREF = "updated_sentences array<string>"


def has_subject_verb(tokens: Column) -> Column:
    """Whether a verb or auxiliary has a subject."""
    return F.exists(tokens, lambda t: F.contains(t["dep"], F.lit("subj")) & F.get(tokens, t["head"])["pos"].isin("VERB", "AUX"))


def subject_verbs(parses: DataFrame) -> DataFrame:
    """(key, tokens) -> key, subject, verb of each subject of a verb."""
    t = parses.select("key", F.explode("tokens").alias("t"), "tokens").filter(F.col("t.dep").isin("nsubj", "nsubjpass"))
    head = F.get("tokens", F.col("t.head"))
    return t.select("key", F.col("t.text").alias("subject"), head["text"].alias("verb"), head["pos"].alias("pos")).filter("pos = 'VERB'").drop("pos")


def root_parts(parses: DataFrame) -> DataFrame:
    """(key, tokens) -> key, root, part, dep, under: a root's children without marks and auxiliaries of the passive, and
    the children of its prepositions."""
    t = parses.select("key", "tokens", F.posexplode("tokens").alias("i", "t"))
    head = F.get("tokens", F.col("t.head"))
    is_root = lambda x: x["dep"] == "ROOT"
    first = t.filter(is_root(head) & (F.col("t.head") != F.col("i")) & ~F.col("t.dep").isin("punct", "auxpass"))
    first = first.select("key", head["text"].alias("root"), F.col("t.text").alias("part"), F.col("t.dep").alias("dep"), F.lit(None).cast("string").alias("under"))
    above = F.get("tokens", head["head"])
    second = t.filter((head["dep"] == "prep") & is_root(above)).select("key", above["text"].alias("root"), F.col("t.text").alias("part"), F.col("t.dep").alias("dep"), head["text"].alias("under"))
    return first.unionByName(second)


def _below(tokens: list[dict], at: int) -> list[int]:
    """Tokens that hang on one, directly or not."""
    out, front = [], [at]
    while front:
        front = [i for i, t in enumerate(tokens) if t["head"] in front and i != t["head"] and i not in out]
        out += front
    return sorted(out)


def _names(tokens: list[dict], at: int) -> list[str]:
    """The name that a token heads, and those joined to it."""
    parts = [i for i, t in enumerate(tokens) if t["head"] == at and t["dep"] == "compound" and t["pos"] == "PROPN"]
    own = " ".join(tokens[i]["text"] for i in sorted([*parts, at]))
    more = [n for i, t in enumerate(tokens) if t["head"] == at and t["dep"] == "conj" and t["pos"] == "PROPN" and i != at for n in _names(tokens, i)]
    return [own, *more]


def life_facts(tokens: list[dict]) -> list[tuple[str, str, str]]:
    """(fact, what, value): born on a date, born in a place (by who tells), and relatives with their names: beside the
    relation ('her sister, Beatrice'), or on the two sides of 'be' ('Bob is her brother', 'her brothers are Bob and Paul')."""
    family, out = {**{k: k for k in V.FAMILY}, **{f"{k}s": k for k in V.FAMILY}}, []
    child = lambda at, dep: [i for i, t in enumerate(tokens) if t["head"] == at and i != at and t["dep"] == dep]
    for at, t in enumerate(tokens):
        below = [i for i in range(len(tokens)) if tokens[i]["head"] == at and i != at]
        if t["text"] == "born" and any(tokens[i]["text"] in ("I", "Narrator") for i in below):
            for i in _below(tokens, at):
                ent = tokens[i].get("ent")
                if ent == "DATE":
                    out.append(("born_on", "I", tokens[i]["text"]))
                elif ent in ("GPE", "LOC"):
                    out.append(("born_in", "I", tokens[i]["text"]))
        if t["text"] in family:
            out += [("family", family[t["text"]], n) for i in child(at, "appos") if tokens[i]["pos"] == "PROPN" for n in _names(tokens, i)]
        if t["dep"] == "ROOT" and t["lemma"] == "be":
            for who, name in (("nsubj", "attr"), ("attr", "nsubj")):
                kin = [family[tokens[i]["text"]] for i in child(at, who) if tokens[i]["text"] in family]
                out += [("family", k, n) for k in kin for i in child(at, name) if tokens[i]["pos"] == "PROPN" for n in _names(tokens, i)]
    return out


def lives(parses: DataFrame) -> DataFrame:
    """(key long, tokens) -> key, fact, what, value; see life_facts()."""

    def of(batches):
        for b in batches:
            rows = [(k, *f) for k, t in zip(b["key"], b["tokens"]) if t for f in life_facts(json.loads(t))]
            yield pd.DataFrame(rows, columns=["key", "fact", "what", "value"])

    return parses.select("key", F.to_json("tokens").alias("tokens")).mapInPandas(of, "key long, fact string, what string, value string")


def born(text: Column) -> tuple[Column, Column]:
    """Without a parse: the date after 'born on' and the capitalised place after 'born in' or after the date; empty if absent."""
    month = "|".join(V.MONTHS)
    on = F.regexp_extract(text, rf"\bborn(?: in [^.]*?)? on ((?:{month}) \d{{1,2}},? \d{{4}}|\d{{1,2}} (?:{month}) \d{{4}})", 1)
    place = F.regexp_extract(text, rf"\bborn(?: on (?:{month}) \d{{1,2}},? \d{{4}},?)? in (\p{{Lu}}[\p{{L}}-]*(?: \p{{Lu}}[\p{{L}}-]*)*)", 1)
    return on, place


def coreferences(narratives: DataFrame, provider: Provider) -> DataFrame:
    """(narrative_id, sentences: array) -> the same with pronouns as what they stand for, where the provider answers with
    as many sentences; else as they are."""
    got = annotated(narratives, provider, "coref", F.array_join("sentences", " "), COREF, "said")
    new = F.col("said.updated_sentences")
    return got.withColumn("sentences", F.when(F.size(new) == F.size("sentences"), new).otherwise(F.col("sentences"))).drop("said")

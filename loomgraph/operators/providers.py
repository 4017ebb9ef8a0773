"""What models and web services would answer: providers behind one interface.

The engine never calls the network. A provider maps a table of inputs to a table of answers; recorded
answers come from a table keyed by kind and digest of the input, rules from lexicons, and absent ones are
null structs, so that a missing answer is a row and not a failure."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import admin_level, json_reply
from loomgraph.operators.substring import containing


class Provider(Protocol):
    def answers(self, inputs: DataFrame, kind: str, schema: str) -> DataFrame:
        """inputs (key, input) -> key, input, answer (struct of the schema, null where there is none)."""


class Recorded:
    """Answers from a table (kind, digest, reply): JSON replies by sha256 of the input."""

    def __init__(self, table: DataFrame):
        self.table, self.kinds = table, None

    def replies(self, kind: str) -> DataFrame | None:
        """digest (as bytes), reply of a kind; None where the table has none."""
        if self.kinds is None:
            self.kinds = {r["kind"] for r in self.table.select("kind").distinct().collect()}  # no more than KINDS
        own = self.table.filter(F.col("kind") == kind).select(F.unhex("digest").alias("digest"), "reply")
        return own.groupBy("digest").agg(F.max("reply").alias("reply")) if kind in self.kinds else None

    def answers(self, inputs: DataFrame, kind: str, schema: str) -> DataFrame:
        known = self.table.filter(F.col("kind") == kind).groupBy("digest").agg(F.max("reply").alias("reply"))
        asked = inputs.withColumn("digest", F.sha2("input", 256)).join(known, "digest", "left")
        return asked.select("key", "input", json_reply(F.col("reply"), schema).alias("answer"))


class Absent:
    def replies(self, kind: str) -> None:
        return None

    def answers(self, inputs: DataFrame, kind: str, schema: str) -> DataFrame:
        return inputs.select("key", "input", F.from_json(F.lit(None).cast("string"), schema).alias("answer"))


def silent(provider: Provider, kind: str) -> bool:
    """Whether a provider is known to have no answers of a kind."""
    return hasattr(provider, "replies") and provider.replies(kind) is None


def annotated(rows: DataFrame, provider: Provider, kind: str, text: F.Column, schema: str, name: str) -> DataFrame:
    """rows with the provider's answer about `text` as the column `name`; equal texts are asked once."""
    own = "asked key"
    while own in {c.lower() for c in rows.columns}:
        own += "_"
    if silent(provider, kind):
        return rows.withColumn(name, F.from_json(F.lit(None).cast("string"), schema))
    rows = rows.withColumn(own, F.sha2(text, 256))
    if hasattr(provider, "replies"):  # by digest, which the key is: inputs don't move
        got = provider.replies(kind).select(F.col("digest").alias(own), json_reply(F.col("reply"), schema).alias(name))
        return rows.withColumn(own, F.unhex(own)).join(got, own, "left").drop(own)
    asked = rows.select(F.col(own).alias("key"), text.alias("input")).filter("key is not null").dropDuplicates(["key"])
    got = provider.answers(asked, kind, schema).select(F.col("key").alias(own), F.col("answer").alias(name))
    return rows.join(got, own, "left").drop(own)


#: A run of letters and digits, or one other character: names begin and end between these.
_PIECES = re.compile(r"[\w#]+|[^\w#]")
#: Names whose tree of pieces is one block.
NAMES = 200_000


def tree(names: Iterable[tuple[str, str]]) -> dict:
    """Names as a tree of their pieces; a name's end holds its type, of several the least."""
    root: dict = {}
    for name, kind in names:
        node = root
        for x in _PIECES.findall(name):
            node = node.setdefault(x, {})
        node[None] = min(kind or "", node.get(None, kind or ""))
    return root


def longest(root: dict, text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the longest name from each place of a text that has one, by places."""
    pieces, out = list(_PIECES.finditer(text)), []
    for i, first in enumerate(pieces):
        node, end, kind = root.get(first[0]), None, ""
        j = i
        while node is not None:
            if None in node:
                end, kind = pieces[j].end(), node[None]
            j += 1
            node = node.get(pieces[j][0]) if j < len(pieces) else None
        if end is not None:
            out.append((first.start(), end, kind))
    return out


def leftmost(found: Iterable[tuple]) -> list[tuple]:
    """Of (start, end, ...) those that begin first, of these the longest, without what they overlap."""
    out, until = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1], *x[2:])):
        if x[0] >= until:
            out.append(x)
            until = x[1]
    return out


class Lexicon:
    """Rule-based entities: the longest known names that a text contains, leftmost first, at every place.

    names (name, ner_type): a tree of them goes to all tasks, in blocks of a bounded number; texts don't move."""

    def __init__(self, names: DataFrame, block: int = NAMES):
        self.names, self.block = names.filter("name <> ''").select("name", "ner_type"), block

    def _blocks(self) -> Iterator[dict]:
        rows = self.names.toLocalIterator()
        while some := list(islice(rows, self.block)):
            yield tree((r["name"], r["ner_type"]) for r in some)

    def entities(self, sentences: DataFrame) -> DataFrame:
        """(key, text) -> key, name, ner_type, place (from 1) of each name in each text; keys are of one text each.

        A name is in a text where its letters are and no word goes on before or after it, case counts. Of names that
        overlap the one that begins first stays, then the longest; one name of several types has the least. Null and
        empty texts have none."""
        schema = f"key {sentences.schema['key'].dataType.simpleString()}, start int, until int, name string, ner_type string"
        spark, got, blocks = sentences.sparkSession, None, 0
        every = len(self.names.take(self.block + 1)) > self.block  # what one block leaves out can be what stays of all
        for block in self._blocks():
            found = sentences.select("key", "text").mapInPandas(self._finder(spark.sparkContext.broadcast(block), every), schema)
            got, blocks = found if got is None else got.unionByName(found), blocks + 1
        if got is None:
            got = spark.createDataFrame([], schema)
        elif blocks > 1:  # what the blocks found in a text meets
            got = got.groupBy("key").applyInPandas(_leftmost_rows, schema)
        return got.select("key", "name", F.nullif("ner_type", F.lit("")).alias("ner_type"), (F.col("start") + 1).alias("place"))

    @staticmethod
    def _finder(shared, every: bool):
        def of(batches):
            root = shared.value
            for b in batches:
                found = ((k, t, longest(root, t)) for k, t in zip(b["key"], b["text"]) if t)
                rows = [(k, s, e, t[s:e], kind) for k, t, own in found for s, e, kind in (own if every else leftmost(own))]
                yield pd.DataFrame(rows, columns=_FOUND)

        return of

    def answers(self, inputs: DataFrame, kind: str, schema: str) -> DataFrame:
        """As a provider: entities by the lexicon, no other answers."""
        if kind != "entities":
            return Absent().answers(inputs, kind, schema)
        found = self.entities(inputs.select("key", F.col("input").alias("text")))
        listed = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "name", "ner_type"))).alias("x"))
        answer = F.struct(F.transform("x", lambda e: F.struct(e["name"].alias("text"), e["ner_type"].alias("ner_type"))).alias("entities"))
        return inputs.join(listed, "key", "left").select("key", "input", F.when(F.col("x").isNotNull(), answer).alias("answer"))


_FOUND = ["key", "start", "until", "name", "ner_type"]


def _leftmost_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = leftmost(zip(pdf["start"], pdf["until"], pdf["ner_type"], pdf["name"]))
    return pd.DataFrame([(pdf["key"].iloc[0], s, e, name, kind) for s, e, kind, name in rows], columns=_FOUND)


class Either:
    """The first provider's answers, and where it has none the second's."""

    def __init__(self, first: Provider, second: Provider):
        self.first, self.second = first, second

    def answers(self, inputs: DataFrame, kind: str, schema: str) -> DataFrame:
        a = self.first.answers(inputs, kind, schema)
        b = self.second.answers(inputs, kind, schema).select(F.col("key").alias("other key"), F.col("answer").alias("other"))
        return a.join(b, F.col("key") == F.col("other key"), "left").select("key", "input", F.coalesce("answer", "other").alias("answer"))


def places(found: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(text) against (toponym, ascii, feature, code, ...), whatever the case: the toponym itself, else the
    longest toponym that the text starts with, else a first-order division (ADM1) whose toponym or ascii name
    contains the text, else any place that does; of equals the least toponym, then code.

    All are equi-joins: on the name, on the text's prefixes, on short substrings."""
    columns = [c for c in gazetteer.columns]
    t = found.select("text").filter("text <> ''").distinct().withColumn("low", F.lower("text"))
    g = gazetteer.filter("toponym is not null").select(F.struct(*columns).alias("g"), F.lower("toponym").alias("top"), F.lower(F.coalesce("ascii", "toponym")).alias("asc"))
    heads = t.select("text", "low", F.explode(F.transform(F.sequence(F.lit(1), F.length("low")), lambda n: F.left(F.col("low"), n))).alias("head"))
    first = heads.join(g, F.col("head") == F.col("top")).select("text", F.struct(F.when(F.col("low") == F.col("top"), 1).otherwise(2).alias("rank"), (-F.length("top")).alias("n"), "g.toponym", "g.code").alias("by"), "g")
    names = g.select("g", F.explode(F.array_distinct(F.array("top", "asc"))).alias("name"))
    inside = containing(t.join(first.select("text"), "text", "left_anti"), "low", names, "name")
    division = F.when(F.coalesce(F.col("g.code"), F.lit("")) == "ADM1", 3).otherwise(4)
    relaxed = inside.select("text", F.struct(division.alias("rank"), F.lit(0).alias("n"), "g.toponym", "g.code").alias("by"), "g")
    best = first.unionByName(relaxed).groupBy("text").agg(F.min_by("g", "by").alias("g"))
    return found.join(best, "text", "left").select("text", "g.*")


def admin_division(feature: F.Column, code: F.Column) -> F.Column:
    """Level of an administrative division: the code's digit; 1 for a seat's code without one; else 0."""
    digit = admin_level(code)
    return F.when((feature == "A") & code.startswith("ADM"), digit).when((feature == "P") & code.startswith("PPLA"), F.when(code.rlike("[0-9]"), digit).otherwise(1)).otherwise(0)


def feature_class(feature: F.Column, code: F.Column) -> F.Column:
    """Location class of a gazetteer's feature class and code."""
    return (
        F.when((feature == "A") & code.startswith("ADM"), ":PopulatedPlace, :AdministrativeDivision")
        .when((feature == "A") & code.startswith("PCL"), ":Country")
        .when((feature == "A") & code.rlike("^[LZ]"), ":DesignatedArea")
        .when((feature == "P") & code.startswith("PPLA"), ":PopulatedPlace, :AdministrativeDivision")
        .when(feature.isin("H", "U"), ":WaterFeature").when(feature == "L", ":DesignatedArea")
        .when(feature == "R", ":TransportationFeature").when(feature == "S", ":PhysicalLocation")
        .when(feature.isin("T", "V"), ":GeographicFeature").otherwise(":PopulatedPlace")
    )

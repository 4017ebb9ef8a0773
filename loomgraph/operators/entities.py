"""What is known of named entities: recorded answers of gazetteers and knowledge bases, and entities as quads.

Lookups are joins on distinct names. An entity is one row: a branch of the table for each kind of property
is a projection of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import vocab as V
from loomgraph.operators import quads as Q
from loomgraph.operators.providers import admin_division, feature_class, places

LOCATION = "location struct<class: string, country: string, admin_level: int, names: array<string>, link: string>"
DESCRIPTION = "description struct<text: string, url: string, item: string, labels: array<string>>"


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_names() -> Column:
    return F.array().cast("array<string>")


def ordered_union(*arrays: Column) -> Column:
    """The arrays' elements in order, each once; null arrays are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(a, no_names()) for a in map(_column, arrays)]))


def labels_of(labels: DataFrame, languages: tuple = ("mul", "en")) -> DataFrame:
    """(item, lang, kind: label or alias, seq, value) -> (item, labels): by language in the given order, the
    label first, then the aliases, each once."""
    at = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    got = labels.filter(F.col("lang").isin(list(languages))).select("item", F.struct(at.alias("l"), (F.col("kind") != "label").alias("k"), "seq", "value").alias("x"))
    return got.groupBy("item").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"])).alias("labels"))


def event_times(statements: DataFrame) -> DataFrame:
    """(item, property, value) -> (item, begins, ends): the least start (P580) and end (P582) of each item."""
    least = lambda p: F.min(F.when(F.col("property") == p, F.col("value")))
    return statements.filter(F.col("property").isin("P580", "P582")).groupBy("item").agg(least("P580").alias("begins"), least("P582").alias("ends"))


def described(nouns: DataFrame, pages: DataFrame, instances: DataFrame, labels: DataFrame, allowed: dict | None = None) -> DataFrame:
    """nouns (noun, ner_type, link) -> the same with `description`, null where there is none.

    pages (title, type, extract, url, item); instances (item, class) closed over subclasses. The link's page is
    taken, else the one of the noun in the country, else the noun's; the page that is there must not be a
    disambiguation, and its item must be an instance of a class allowed for the type."""
    allowed = V.ALLOWED_ITEMS if allowed is None else allowed
    noun = F.replace("noun", F.lit(" "), F.lit("_"))
    titles = F.array(F.element_at(F.split("link", "/"), -1), F.concat(F.lit("United_States_"), noun), noun)
    tries = nouns.select("noun", "ner_type", "link").distinct().select("noun", "ner_type", "link", F.posexplode(titles).alias("rank", "title")).filter("title <> ''")
    one = pages.groupBy("title").agg(F.min(F.struct("item", "type", "extract", "url")).alias("p"))
    hit = tries.join(one, "title").groupBy("noun", "ner_type", "link").agg(F.min_by("p", "rank").alias("p")).filter("p.item is not null and coalesce(p.type, '') <> 'disambiguation'")
    kinds = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    fits = instances.groupBy("item").agg(F.collect_set("class").alias("classes"))
    hit = hit.join(fits, F.col("p.item") == F.col("item")).filter(F.arrays_overlap("classes", F.try_element_at(kinds, F.col("ner_type"))))
    hit = hit.drop("item").join(labels_of(labels), F.col("p.item") == F.col("item"), "left")
    about = F.concat(F.lit("From Wikipedia (wikibase_item: "), F.col("p.item"), F.lit("): '"), T.plain_extract(F.col("p.extract")), F.lit("'"))
    hit = hit.select("noun", "ner_type", F.col("link").alias("by_link"), F.struct(F.coalesce(about, F.lit("")).alias("text"), F.coalesce("p.url", F.lit("")).alias("url"), F.col("p.item").alias("item"), F.coalesce("labels", no_names()).alias("labels")).alias("description"))
    same = (nouns["noun"] == hit["noun"]) & nouns["ner_type"].eqNullSafe(hit["ner_type"]) & nouns["link"].eqNullSafe(hit["by_link"])
    return nouns.join(hit, same, "left").select(nouns["*"], "description")


def located(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """names (name) -> name, location: class, country, admin level, names and link of its place, else null.

    gazetteer (toponym, ascii, feature, code, country, names, link): names are its English names."""
    g = places(names.select(F.col("name").alias("text")).distinct(), gazetteer)
    kind = feature_class(F.col("feature"), F.col("code"))
    country = F.when(kind == ":Country", "").otherwise(F.coalesce("country", F.lit("")))
    found = F.col("toponym").isNotNull() & (F.coalesce("country", "feature") != "")
    place = F.struct(kind.alias("class"), country.alias("country"), admin_division(F.col("feature"), F.col("code")).alias("admin_level"), ordered_union("names", F.array("text"), F.array("ascii")).alias("names"), F.coalesce("link", F.lit("")).alias("link"))
    return g.select(F.col("text").alias("name"), F.when(found, place).alias("location"))


class Knowledge:
    """Recorded answers about names; every table may be absent."""

    def __init__(self, spark, gazetteer: DataFrame | None = None, pages: DataFrame | None = None, instances: DataFrame | None = None, labels: DataFrame | None = None, statements: DataFrame | None = None):
        empty = lambda schema: spark.createDataFrame([], schema)
        self.gazetteer = empty("toponym string, ascii string, feature string, code string, country string, names array<string>, link string") if gazetteer is None else gazetteer
        self.pages = empty("title string, type string, extract string, url string, item string") if pages is None else pages
        self.instances = empty("item string, class string") if instances is None else instances
        self.labels = empty("item string, lang string, kind string, seq int, value string") if labels is None else labels
        self.statements = empty("item string, property string, value string") if statements is None else statements

    def about(self, names: DataFrame) -> DataFrame:
        """(name, base: NER type) -> name, base, location, place_description, description, begins, ends.

        Places are sought for GPE, LOC, FAC and ORG, descriptions for PERSON, NORP, ORG and EVENT."""
        n = names.select("name", "base").distinct()
        spots = located(n.filter(F.col("base").isin("GPE", "LOC", "FAC", "ORG")).select("name"), self.gazetteer).filter("location is not null")
        n = n.join(spots, "name", "left").withColumn("location", F.when(F.col("base").isin("GPE", "LOC", "FAC", "ORG"), F.col("location")))
        at_place = described(n.filter("location is not null").select(F.col("name").alias("noun"), F.col("base").alias("ner_type"), F.col("location.link").alias("link")), self.pages, self.instances, self.labels)
        others = n.filter(F.col("base").isin("PERSON", "NORP", "EVENT") | ((F.col("base") == "ORG") & F.col("location").isNull()))
        plain = described(others.select(F.col("name").alias("noun"), F.col("base").alias("ner_type"), F.lit("").alias("link")), self.pages, self.instances, self.labels)
        both = at_place.unionByName(plain).filter("description is not null").select(F.col("noun").alias("name"), F.col("ner_type").alias("base"), "description")
        got = n.join(both, ["name", "base"], "left")
        return got.join(event_times(self.statements), (F.col("base") == "EVENT") & (F.col("description.item") == F.col("item")), "left").drop("item")


#: One entity a row. class: its type's class string; base: its type without number and gender.
ENTITY = f"iri string, name string, ner_type string, base string, class string, labels array<string>, gender string, begins string, ends string, {LOCATION}, {DESCRIPTION}"


def entity_quads(entities: DataFrame, repo: Column, graph: Column, geo: DataFrame | None = None) -> DataFrame:
    """Entities (ENTITY columns, and those that repo and graph are made of) as quads.

    Text and types; labels without articles; comment, link and identifier where there are such; gender;
    admin level and country of places, and the country's :has_component where geo (name, iri) knows it;
    beginning and end of events. A class owl:Thing gives no types, labels or links."""
    e = entities.withColumn("at", repo).withColumn("in", graph)
    r, g, s = F.col("at"), F.col("in"), F.col("iri")
    named = e.filter(~F.contains("class", F.lit("owl:Thing")))
    some = lambda c: F.when(c != "", c)
    types = ordered_union(F.split("location.class", ", "), F.when(F.col("location").isNull() | (F.col("base") != "ORG"), F.split("class", ", ")).otherwise(F.split(F.replace("class", F.lit("OrganizationalEntity"), F.lit("Location")), ", ")))
    d = F.col("description")
    parts = [
        Q.triplify(e, s, r, g, **{":text": (F.col("name"), "lit")}),
        Q.triplify(named.withColumn("type", F.explode(types)), s, r, g, **{"rdf:type": (F.col("type"), "iri")}),
        Q.triplify(named.withColumn("label", F.explode(ordered_union("location.names", "labels"))), s, r, g, **{"rdfs:label": (T.without_article(F.col("label")), "lit")}),
        Q.triplify(named, s, r, g, **{"rdfs:comment": (some(d["text"]), "lit"), ":external_link": (some(d["url"]), "lit"), ":external_identifier": (some(d["item"]), "lit"), ":gender": (F.lower(some(F.col("gender"))), "lit"), ":has_beginning": (F.concat(F.lit(":PiT_"), some(F.col("begins"))), "iri"), ":has_end": (F.concat(F.lit(":PiT_"), some(F.col("ends"))), "iri")}),
        Q.triplify(named, s, r, g, **{":admin_level": (F.when(F.col("location.admin_level") > 0, F.col("location.admin_level")), "xsd:integer"), ":country_name": (some(F.col("location.country")), "lit")}),
    ]
    if geo is not None:
        known = geo.select(F.col("name").alias("country_name"), F.col("iri").alias("country_iri"))
        parts.append(Q.triplify(named.join(known, F.col("location.country") == F.col("country_name")), F.col("country_iri"), r, g, **{":has_component": (F.col("iri"), "iri")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(Q.KEY)


def by_type(entities: DataFrame) -> DataFrame:
    """(ner_type, text, ...) -> ner_type, names: the distinct texts of each type, sorted."""
    return entities.groupBy("ner_type").agg(F.sort_array(F.collect_set("text")).alias("names"))


def known_types(entities: DataFrame, items: DataFrame, instances: DataFrame) -> DataFrame:
    """(text) through items (label, item) and instances (item, class) -> text, item, classes."""
    one = items.groupBy(F.col("label").alias("text")).agg(F.min("item").alias("item"))
    of = instances.groupBy("item").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    return entities.select("text").distinct().join(one, "text", "left").join(of, "item", "left").select("text", "item", "classes")


def multimap(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the array of its values, in order."""
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("x"))
    return got.select(key, F.transform("x", lambda x: x["v"]).alias("values"))

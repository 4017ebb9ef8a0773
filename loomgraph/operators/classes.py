"""Classes of events and nouns without a model: terms of a lexicon that a text holds vote for their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vocab as V
from loomgraph.operators.providers import NAMES, Absent, Lexicon
from loomgraph.operators.reading import NOUN_CLASSES
from loomgraph.operators.stored import stored

#: Votes of a term of one word, shared evenly and rounded down by the classes that have it.
VOTES = 5040
#: Classes that an answer names, those with most votes first.
NAMED = 3


def _with_s(word: Column) -> Column:
    return F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def _verb(word: Column) -> Column:
    """Third person, past and participle of a regular verb; a short one's last consonant doubles."""
    double = F.when(word.rlike("^[^aeiou]*[aeiou][bdgmnprt]$"), F.concat(word, F.right(word, F.lit(1)))).otherwise(word)
    past = F.when(word.endswith("e"), F.concat(word, F.lit("d"))).when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ied")).otherwise(F.concat(double, F.lit("ed")))
    ing = F.when(word.rlike("ie$"), F.regexp_replace(word, "ie$", "ying")).when(word.rlike("[^eoy]e$"), F.regexp_replace(word, "e$", "ing")).otherwise(F.concat(double, F.lit("ing")))
    return F.array(_with_s(word), past, ing)


def forms(term: Column, kind: Column) -> Column:
    """A lower-case term and its regular forms: of a verb the first word is inflected, of others the last in the plural.
    Irregular forms are terms of their own."""
    first, rest = F.regexp_extract(term, r"^\S+", 0), F.regexp_replace(term, r"^\S+", "")
    verb = F.transform(_verb(first), lambda w: F.concat(w, rest))
    return F.array_distinct(F.concat(F.array(term), F.when(kind == "verb", verb).otherwise(F.array(_with_s(term)))))


def voted(texts: DataFrame, known: DataFrame, block: int = NAMES) -> DataFrame:
    """(key, text) x (term, kind, class) -> key, class, votes, confidence (percent of the text's votes), rank from 1.

    Terms are found as the longest ones from left to right, whatever the case, in their regular forms too: a term
    inside of a longer one has no vote. A term of n words has n times VOTES, shared by its classes; equal votes rank
    by class. Texts without a term, null ones and terms or classes that are null give no row; keys are of one text."""
    clean = F.regexp_replace(F.trim(F.lower("term")), r"\s+", " ")
    terms = known.filter("class is not null").select(clean.alias("term"), "kind", "class").filter("term <> ''")
    shapes = stored(terms.select(F.explode(forms(F.col("term"), F.coalesce("kind", F.lit("")))).alias("form"), "class").distinct())
    shared = shapes.groupBy("form").agg(F.collect_list("class").alias("classes"))
    names = shared.select(F.col("form").alias("name"), F.lit(None).cast("string").alias("ner_type"))
    spaced = F.regexp_replace(F.lower("text"), r"\s+", " ")
    found = Lexicon(names, block).entities(texts.select("key", spaced.alias("text")).filter("text is not null"))
    found = found.repartition("key").groupBy("key").agg(F.sort_array(F.collect_list("name")).alias("terms"))
    found = stored(found.withColumn("of", F.sha2(F.array_join("terms", "\n"), 256)))
    # texts with the same terms have the same votes, so a term of many texts isn't joined with each of them
    terms = found.select("of", "terms").dropDuplicates(["of"]).select("of", F.explode("terms").alias("name")).groupBy("of", "name").agg(F.count("*").alias("n"))
    weight = F.expr(f"({VOTES}L * size(split(form, ' '))) div size(classes)")
    votes = terms.join(shared, F.col("name") == F.col("form")).select("of", (F.col("n") * weight).alias("votes"), F.explode("classes").alias("class"))
    votes = votes.groupBy("of", "class").agg(F.sum("votes").alias("votes"))
    ranked = votes.groupBy(F.col("of").alias("by")).agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "class"))).alias("ranked"), F.sum("votes").alias("total"))
    got = found.join(ranked, F.col("of") == F.col("by")).select("key", "total", F.posexplode("ranked").alias("k", "x"))
    got = got.select("key", "x.class", (-F.col("x.less")).alias("votes"), "total", (F.col("k") + 1).alias("rank"))
    return got.select("key", "class", "votes", F.expr("cast((100 * votes) div total as int)").alias("confidence"), "rank")


class Voted:
    """As a provider: the classes of situations and of noun phrases by votes of known (term, kind, class).

    A situation with votes is one event of its own text with the NAMED best classes, a noun phrase has the best one;
    what has no votes has no answer, so that another provider can be asked (see providers.Either)."""

    def __init__(self, known: DataFrame):
        self.known = known

    def _numbered(self, texts: DataFrame, classes: list[str], kinds: list[str]) -> DataFrame:
        number = F.create_map(*[F.lit(x) for c in dict.fromkeys(classes) for x in (c, classes.index(c) + 1)])
        terms = self.known.filter(F.col("class").isin(classes) & F.col("kind").isin(kinds))
        return voted(texts, terms).withColumn("number", F.try_element_at(number, F.col("class")))

    def answers(self, inputs: DataFrame, kind: str, schema: str) -> DataFrame:
        if kind == "situation":
            got = self._numbered(inputs.select("key", F.col("input").alias("text")), V.EVENT_CATEGORIES, ["verb", "noun", "label"])
            one = F.struct("rank", F.col("number").alias("category_number"), F.lit("same").alias("same_or_opposite"), F.col("confidence").alias("correctness"))
            listed = got.filter(F.col("rank") <= NAMED).groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("semantics"))
            body = F.to_json(F.struct(F.array(F.struct(F.col("input").alias("text"), "semantics")).alias("simpler_sentences")))
        elif kind == "nouns":
            phrases = inputs.select("key", F.posexplode(F.split("input", r" \*\* ")).alias("at", "text"))
            got = self._phrases(phrases)
            one = F.struct("at", "text", F.col("number").alias("category_number"), F.lit("same").alias("same_or_opposite"), F.col("confidence").alias("correctness"))
            listed = got.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("noun_phrases"))
            body = F.to_json(F.struct("noun_phrases"))
        else:
            return Absent().answers(inputs, kind, schema)
        column = listed.columns[1]
        reply = F.when(F.col(column).isNotNull(), F.from_json(body, schema))
        return inputs.join(listed, "key", "left").select("key", "input", reply.alias("answer"))

    def _phrases(self, phrases: DataFrame) -> DataFrame:
        """key, at, text, number, confidence of the phrases that have votes; equal phrases are asked once."""
        own = phrases.select(F.col("text").alias("phrase")).filter("phrase is not null").distinct()
        best = self._numbered(own.select(F.col("phrase").alias("key"), F.col("phrase").alias("text")), NOUN_CLASSES, ["noun", "label"]).filter("rank = 1")
        return phrases.join(best.select(F.col("key").alias("text"), "number", "confidence"), "text")

from loomgraph.functions import text as T
from loomgraph.operators import semantics as S
from pyspark.sql import functions as F


def values(spark, fn, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(fn(F.col("t"))).collect()]


def test_strings(spark):
    assert values(spark, T.normalised, " a\nb   c ", None) == ["a b  c", None]
    assert values(spark, T.repaired, "5 % x ] a- b- c") == ["5% x] a-b-c"]
    assert values(spark, T.sentences, "One. Two! Three?  Four", "U.S. Rep. Jo A. Doe met Mr.  Roe. They left") == [["One.", "Two!", "Three?", "Four"], ["U.S. Rep. Jo A. Doe met Mr.  Roe.", "They left"]]
    assert values(spark, T.dominant_style, 'say "a" and “b” “c”', "none", 'a "x" ‘y’') == ["double", None, "straight"]
    assert values(spark, T.without_article, "The cat", "an owl", "Theory") == ["cat", "owl", "Theory"]
    assert values(spark, T.without_possessive, "Jack's", "the Smiths’", "it") == ["Jack", "the Smiths", "it"]
    assert values(spark, T.iri, "Liz Cheney", "U.S. Rep_", "-x y") == [":Liz_Cheney", ":U_S_Re", ":x_y"]
    assert values(spark, T.base_type, "PLURALFEMALEPERSON", "SINGGPE") == ["PERSON", "GPE"]
    assert values(spark, T.name_parts, "Mary  Smith-Evans") == [["Mary", "Smith", "Evans"]]
    assert values(spark, T.date_valid, "1998-02-31", "1900-01-01", "98-1-1", None, "1998-1-9", "1998-13-01") == [True, False, False, False, True, False]
    assert values(spark, T.time_iri, "August 16, 2022", "March 5", "2022 ", "soon then.", "Friday, June 5, 2024", "on Monday", "31 May") == [":PiT_Yr2022_MoAugust_Day16", ":PiT_MoMarch", ":PiT_Yr2022_Day22", ":PiT_soon_then", ":PiT_Yr2024_MoJune_Day5", ":PiT_DayMonday", ":PiT_MoMay_Day31"]
    assert values(spark, T.base_words, "the former President Donald Trump", "water rights") == ["President Donald Trump", "water rights"]
    assert values(spark, T.ascii_folded, "Café Øst ß") == ["Cafe Ost ss"]
    assert values(spark, lambda c: T.after(c, "//"), "http://a", "b") == ["a", ""]
    assert values(spark, lambda c: T.json_reply(c, "a int"), '{"a":\n1}', "no")[0]["a"] == 1


def test_sentences_keep_their_characters(spark):
    """Characters at a sentence's ends that spell its place, and control characters, as the query's SQL has them."""
    import duckdb
    from loomgraph.functions.tables import sentences_of
    from loomgraph.plans.texts import NORM, SENTS

    texts = ["So. 1 of 11", "A b. Cd.  11 ! 2 22", "a.\x0bb.\x0c c. \x01 d.\x01e\x02. f.\x02 g", "  0 0.", "Mr.\x02 X. Mr. \x02Y.\u00a0Z! \x1cQ", None]
    want = [duckdb.execute(f"SELECT {SENTS.format(NORM)} FROM (SELECT CAST(? AS VARCHAR) AS text)", [t]).fetchone()[0] for t in texts]
    assert want[0] == ["So.", "1 of 11"]
    assert values(spark, lambda c: T.sentences(T.normalised(c)), *texts) == want
    assert [sentences_of(t) for t in texts[:-1]] == want[:-1]


def test_semantics(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(S.modal_class(F.lit("could"), F.lit(True))) == ":OpportunityAndPossibility"
    assert pick(S.modal_class(F.lit("will"), F.lit(False))) is None
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    no, yes = F.lit(False), F.lit(True)
    rule = lambda role, event, noun, text="x", agent=no: pick(S.predicate(F.lit(role), arr(*event), F.lit(noun), F.lit(text), agent))
    assert rule("theme", [":Measurement"], ":Resource", "66.3%") == ":has_quantification"
    assert rule("agent", [":Win"], ":Person") == ":has_active_entity"
    assert rule("theme", [":Affiliation"], ":OrganizationalEntity") == ":affiliated_with"
    assert rule("theme", [":MovementTravelAndTransportation"], ":Location") == ":has_destination"
    assert rule("experiencer", [":Win"], ":Person") == ":has_active_entity"
    assert rule("experiencer", [":Win"], ":Person", agent=yes) == ":has_affected_entity"
    assert rule("location", [":Win"], ":Resource") == ":has_context"
    assert rule("goal", [":Win"], ":Location") == ":has_destination"
    assert rule("co-agent", [":Win"], ":Person") is None
    assert rule("recipient", [":Win"], ":OrganizationalEntity") == ":has_recipient" and rule("source", [":Win"], ":GeopoliticalEntity") == ":has_source"
    assert rule("location", [":Win"], ":Prison") == ":has_context" and rule("recipient", [":Win"], ":Location, :Collection") == ":has_destination"
    texts = F.array(F.lit("x" * 95), F.lit("abc"), F.lit("b"), F.lit("zz"))
    assert pick(S.details_concatenated(texts)) == "x" * 90 + " ...; abc; zz"

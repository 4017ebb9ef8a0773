import random

from loomgraph.functions import vocab as V
from loomgraph.operators import classes as C
from loomgraph.operators import narrative as N
from loomgraph.operators.providers import Absent, Either
from loomgraph.operators.reading import NOUN_CLASSES

KNOWN = "term string, kind string, class string"


def test_forms(spark):
    terms = [("army", "noun"), ("box", "noun"), ("day", "label"), ("stop", "verb"), ("carry out", "verb"), ("lie", "verb"), ("free", "verb"), ("agree", "verb"), ("join", "verb")]
    got = {r[0]: set(r[1]) for r in spark.createDataFrame(terms, "term string, kind string").select("term", C.forms(C.F.col("term"), C.F.col("kind"))).collect()}
    assert got["army"] == {"army", "armies"} and got["box"] == {"box", "boxes"} and got["day"] == {"day", "days"}
    assert got["stop"] == {"stop", "stops", "stopped", "stopping"} and got["carry out"] == {"carry out", "carries out", "carried out", "carrying out"}
    assert got["lie"] == {"lie", "lies", "lied", "lying"} and got["free"] == {"free", "frees", "freed", "freeing"} and got["join"] == {"join", "joins", "joined", "joining"}


def test_votes_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["ab", "cd", "ef", "gh", "ij"])
    known = {(" ".join(word() for _ in range(rnd.randrange(1, 4))), rnd.choice(["X", "Y", "Z"])) for _ in range(25)}
    texts = [(k, " ".join(rnd.choice([word(), word() + "s", word().upper(), "zz", "abc"]) for _ in range(rnd.randrange(0, 12)))) for k in range(80)] + [(900, None), (901, "  ")]
    by = {}
    for term, c in known:
        for f in (term, term + "s"):
            by.setdefault(f, set()).add(c)
    want = {}
    for key, text in texts:
        w, at, votes = (text or "").lower().split(), 0, {}
        while at < len(w):
            n = next((n for n in range(len(w), 0, -1) if " ".join(w[at : at + n]) in by and at + n <= len(w)), 0)
            for c in by[" ".join(w[at : at + n])] if n else ():
                votes[c] = votes.get(c, 0) + C.VOTES * n // len(by[" ".join(w[at : at + n])])
            at += n or 1
        for rank, c in enumerate(sorted(votes, key=lambda c: (-votes[c], c)), 1):
            want[key, c] = (votes[c], 100 * votes[c] // sum(votes.values()), rank)
    rows = spark.createDataFrame(texts, "key long, text string")
    odd = [(None, "noun", "X"), ("ab", "noun", None), ("", "noun", "Y")]
    lexicon = spark.createDataFrame([(t, "noun", c) for t, c in known] + odd, KNOWN)
    for block in (200_000, 7):
        assert {(r["key"], r["class"]): (r["votes"], r["confidence"], r["rank"]) for r in C.voted(rows, lexicon, block).collect()} == want
    assert len(want) > 100 and C.voted(rows, lexicon.limit(0)).count() == 0


def test_as_provider(spark):
    known = spark.createDataFrame([("army", "noun", ":ArmedForce"), ("join", "verb", ":Affiliation"), ("agree", "verb", ":Agreement"), ("agree", "verb", ":Nothing")], KNOWN)
    p = Either(C.Voted(known), Absent())
    asked = lambda *x: spark.createDataFrame([(v, v) for v in x], "key string, input string")
    got = {r["key"]: r["answer"] for r in p.answers(asked("Jane joined the army.", "It rained."), "situation", N.SITUATION).collect()}
    (one,) = got["Jane joined the army."].simpler_sentences
    assert got["It rained."] is None and one.text == "Jane joined the army." and [V.EVENT_CATEGORIES[s.category_number - 1] for s in one.semantics] == [":Affiliation"]
    assert one.semantics[0].correctness == 100 and one.semantics[0].same_or_opposite == "same"
    got = {r["key"]: r["answer"] for r in p.answers(asked("two armies ** Jane ** army", "Jane"), "nouns", N.NOUNS).collect()}
    assert got["Jane"] is None
    assert [(x.text, NOUN_CLASSES[x.category_number - 1]) for x in got["two armies ** Jane ** army"].noun_phrases] == [("two armies", ":ArmedForce"), ("army", ":ArmedForce")]
    assert p.answers(asked("x"), "chronology", N.KINDS["chronology"]).first()["answer"] is None


def test_votes_of_a_term_of_all_texts(spark):
    """Texts of the same terms are joined with the classes once, however many they are."""
    from loomgraph.operators import classes as C

    known = spark.createDataFrame([("ring", "noun", c) for c in ("a", "b", "c")] + [("blue ring", "noun", "b"), ("bolt", "noun", "d")], "term string, kind string, class string")
    texts = spark.range(3_000).selectExpr("id as key", "case id % 3 when 0 then 'A ring, a blue ring and rings' when 1 then 'Bolt' else 'none' end as text")
    got = C.voted(texts, known)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["key"] % 3, set()).add(tuple(r)[1:])
    assert rows == {0: {("b", 2 * 1680 + 10080, 66, 1), ("a", 3360, 16, 2), ("c", 3360, 16, 3)}, 1: {("d", 5040, 100, 1)}}
    assert got.groupBy("key").count().count() == 2_000
    joined = lambda node: [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    plan, most = got._jdf.queryExecution(), []
    got._jdf.collectToPython()
    stack = [plan.executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        most += joined(node)
        stack += [node.children().apply(k) for k in range(node.children().size())]
    assert sorted(most) == [4, 2_000]  # terms of two kinds of texts, then one row a text

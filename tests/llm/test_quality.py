import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c#", "\n", " ", "\t", "é<"]), max_size=60).map(" ".join))
def test_features(text):
    f = quality.Features(text)
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute(text)


def test_order_changes_no_verdict():
    texts = ["a b c " * 40, "# " * 60, " ".join(f"w{i}" for i in range(80)), None, "X" * 900]
    ordered = quality.cascade(texts, quality.RULES)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.RULES)
    for t in texts:
        assert any(r.rejects(quality.Features(t)) for r in ordered) == any(r.rejects(quality.Features(t)) for r in quality.RULES)


def test_cheap_and_selective_rules_go_first():
    """By a clock that the rules move: rejections per second decide, of what the base lets through."""
    now = [0.0]

    def rule(name, cost, share):
        def rejects(f):
            now[0] += cost
            return hash(f.text) % 100 < share

        return quality.Rule(name, rejects)

    texts = [" ".join(f"w{i}x{k}" for i in range(80)) for k in range(300)] + ["few words"] * 300
    rules = [rule("dear", 5.0, 60), rule("rare", 1.0, 2), rule("good", 1.0, 50)]
    assert [r.name for r in quality.cascade(texts, rules, clock=lambda: now[0])] == ["good", "dear", "rare"]


def test_a_rejected_text_meets_no_later_rule():
    asked = []
    rules = [quality.Rule(n, lambda f, n=n: asked.append(n) or n == "second") for n in ("first", "second", "third")]
    good = quality.Features(" ".join(f"w{i}" for i in range(60)))
    assert quality.verdict(good, rules) == (False, False) and asked == ["first", "second"]
    assert quality.verdict(quality.Features("few"), rules) == (True, False) and asked == ["first", "second"]
    assert quality.verdict(good, rules[:1]) == (False, True)
    f = quality.Features("# * & " * 40 + " ".join(f"w{i}" for i in range(60)))
    quality.verdict(f, [r for r in quality.RULES if r.name in ("symbols", "one_word")])
    assert "commonest" not in vars(f)  # the feature of a rule that wasn't asked is not computed


def test_sample_is_random(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r["doc_id"] for r in quality.random_rows(docs, 100).collect()]
    assert 60 <= len(got) <= 100 and max(got) > 500 and got == [r["doc_id"] for r in quality.random_rows(docs, 100).collect()]


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in quality.op5_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    for d in docs:
        r, b = got[d["doc_id"]], brute(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert r["kept"] <= (not r["base_failed"])
        if d["doc_id"] in good:
            assert r["kept"] or r["base_failed"]


def test_edges(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in quality.judged(odd_docs).collect()}
    assert got[2]["n_words"] == got[3]["n_words"] == got[4]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert quality.judged(odd_docs).count() == odd_docs.count() and quality.judged(no_docs).count() == 0

import random
import re
from collections import Counter

import pytest

from loomgraph.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document for every item; docs and items are lists of (key, text)."""
    words = [(d, split(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(x for _, w in words for x in set(w))
    out = []
    for q, text in items:
        scores = []
        for d, w in words:
            m, tf = 10 + 90 * len(w) * n // total, Counter(w)
            s = sum(search.weight(n, df[t]) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(split(text)) if tf[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(q, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


@pytest.mark.parametrize("text", [None, "", " \x00\x7f-", "Ab1_2 ÉÀ x 日本,語 😀\n[z]{y}`@/:;", "a" * 5000])
def test_terms(text):
    assert [t.decode() for t in search.terms((text or "").encode())] == split(text)


def test_shards_of_any_size_give_the_same(spark, tmp_path, monkeypatch):
    """Ties, copies, repeated ids, no id, no terms; one document a shard up to all in one; blocks of two items."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(r.choices(words, [1 / (i + 1) for i in range(40)], k=r.randrange(1, 60)))) for k in range(150)]
    docs += [(200 + k, docs[7][1]) for k in range(40)] + [(5, "w1 W2"), (None, "w1 w2"), (None, docs[3][1]), (300, ""), (301, None), (302, "- -")]
    items = [(k, " ".join(r.sample(words, r.randrange(1, 12)))) for k in range(9)] + [(3, "w39"), (20, None), (21, ""), (22, "nowhere"), (23, "w0 w0 NOWHERE w1"), (None, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(search, "BLOCK_ITEMS", 2)
    n, total = search.statistics(d)
    want = plain(docs, items)
    for size in (1, 400, 1 << 20):
        shards = search.index(d, n, total, shard_bytes=size)
        assert shards.count() == 193 if size == 1 else shards.count() < 193
        assert got(search.ranked(shards, q, n).collect()) == want, size


def test_few_nodes_at_a_time(monkeypatch):
    """Best first: whatever number of nodes is opened together, the same are found, and fewer are opened than there are documents."""
    r = random.Random(8)
    texts = [[f"w{int(r.paretovariate(0.7))}".encode() for _ in range(r.randrange(5, 80))] for _ in range(3000)]
    s = search.shard_of(list(range(3000)), texts, 3000, sum(map(len, texts)))
    import numpy as np

    shard = search.Shard(s["ids"], s["terms"], s["lists"], s["impacts"], s["bits"])
    opened = []
    real = np.argpartition
    monkeypatch.setattr(search.np, "argpartition", lambda a, k: (opened.append(k), real(a, k))[1])
    answers = []
    for step in (1, 16, 512):
        monkeypatch.setattr(search, "STEP", step)
        best = search.Best()
        shard.search([(b"w900", 7000), (b"w77", 4000), (b"w3", 900)], best)
        answers.append(best.found)
        if step == 1:
            assert 0 < len(opened) < 1000
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 10


def test_edges(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "card mail here"), (2, None)], "item_id long, text string")
    n, total = search.statistics(odd_docs)
    shards = search.index(odd_docs, n, total)
    want = plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(1, "card mail here")])
    assert got(search.ranked(shards, items, n).collect()) == want
    assert search.ranked(shards, items.limit(0), n).count() == 0
    assert search.statistics(no_docs) == (0, 0)
    assert search.ranked(search.index(no_docs, 0, 0), items, 0).count() == 0
    named = spark.createDataFrame([("x", "card mail here")], "item_id string, text string")
    assert {r["item_id"] for r in search.ranked(shards, named, n).collect()} == {"x"}

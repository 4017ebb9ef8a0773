import zlib

from loomgraph.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op6_toxicity(spark, sf).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == t for p, t in held) / len(held) > 0.9


def test_unseen_misspelling_scores():
    clean = [f"the day number{i} was fine and the sun went over town{i % 7} again" for i in range(120)]
    bad = [f"the day number{i} was fine you worthless moron over town{i % 7} again" for i in range(60)]
    m = toxicity.trained(clean + bad, [0] * 120 + [1] * 60)
    s = toxicity.word_scores(m)
    assert s.log_odds("what a worthles moronn went over town") > 0 > s.log_odds("what a fine day went over town")
    again = toxicity.trained(clean + bad, [0] * 120 + [1] * 60)
    assert again.share == m.share and again.bias == m.bias


def test_edges(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fitted(odd_docs, none)
    assert m.share == {}
    got = toxicity.scored(odd_docs, m, keep=odd_docs.columns, out=("s", "p"))
    assert got.count() == odd_docs.count() and got.columns == [*odd_docs.columns, "s", "p"]
    assert toxicity.scored(no_docs, m).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.fitted(odd_docs, labels)


def test_long_words_are_read_to_their_end():
    """What stands after the first 62 bytes of a word counts, in scoring and in training, and a long word weighs by its length."""
    clean = [f"the day number{i} was fine and the sun went over town{i % 7} again" for i in range(120)]
    bad = [f"the day number{i} was fine you worthless moron over town{i % 7} again" for i in range(60)]
    s = toxicity.word_scores(toxicity.trained(clean + bad, [0] * 120 + [1] * 60))
    start = "https://host.example/" + "q" * 80 + "/"
    for join in ("_", "\u00a0", "\u3000", "."):
        plain, toxic = (start + join.join(["you", end, "x", end]) for end in ("zzzzzzz", "worthless"))
        assert s.log_odds(toxic) > s.log_odds(plain)
        assert all(s.log_odds("x" * k + "worthless") > s.log_odds("x" * k + "zzzzzzzzz") for k in range(40, 140))
    filler = "今日は天気がとても良いので公園まで散歩に行って友達と話をしてから帰りました"
    texts = [filler + f"番号{i}の日" for i in range(120)] + [filler + f"番号{i}の馬鹿野郎" for i in range(60)]
    s = toxicity.word_scores(toxicity.trained(texts, [0] * 120 + [1] * 60))
    assert s.log_odds(filler + "番号999の馬鹿野郎") > s.log_odds(filler + "番号999の日")
    text = "z" * 5000 + "worthless"
    assert b"".join(p[: 64 - 5] for p in toxicity.pieces(text)).startswith(b"<" + b"z" * 4000) and all(len(p) <= 64 for p in toxicity.pieces(text))
    want = f"<{text}>".encode()
    got = {g for p in toxicity.pieces(text) for g in toxicity.subwords(p)}
    assert all(want[i : i + n] in got for n in (4, 5, 6) for i in range(len(want) - n + 1))


def test_sample_is_bounded(spark):
    """Repeated rows count once, texts over a quarter of the bytes not at all, and a label's texts fill half of them."""
    rows = [(k, "word " * 200) for k in range(400)] * 3 + [(1000, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in [*range(400), 1000]], "doc_id long, quality int, toxic int")
    got = toxicity.training_sample(docs, labels, sample_bytes=100_000)
    assert len({d for d, _, _ in got}) == len(got) and sum(len(t) for _, t, _ in got) <= 100_000
    assert all(zlib.crc32(str(d).encode()) % 5 and y == d % 2 for d, _, y in got) and len([1 for _, _, y in got if y]) == 50
    assert len(toxicity.training_sample(docs, labels, (3, 2))) == 5

import itertools
import random

from loomgraph.operators import align as A


def test_topics_by_rare_words(spark):
    """Against all pairs; and a word that every topic has joins nothing."""
    rnd = random.Random(3)
    name = lambda: " ".join(rnd.choices("abcdefghij", k=rnd.randrange(0, 6)))
    left, right = {name() for _ in range(60)}, {name() for _ in range(60)} | {"", "the"}
    t = lambda x: spark.createDataFrame([(v,) for v in x] + [(None,)], "topic string")
    for least in (0.3, 0.5, 0.8, 1.0):
        score = {}
        for x, y in itertools.product(left, right):
            a, b = set(x.split()), set(y.split())
            if a & b and len(a & b) / len(a | b) >= least:
                score[x, y] = len(a & b) / len(a | b)
        l = {x: min((-s, y) for (u, y), s in score.items() if u == x)[1] for x, _ in score}
        r = {y: min((-s, x) for (x, u), s in score.items() if u == y)[1] for _, y in score}
        pairs = {(x, y) for x, y in l.items() if r[y] == x}
        want = pairs | {(x, None) for x in left - {x for x, _ in pairs}} | {(None, y) for y in right - {y for _, y in pairs}}
        got = [(q["left"], q["right"]) for q in A.compared(t(left), t(right), least).collect()]
        assert len(got) == len(want) and set(got) == want

    many = lambda town: spark.createDataFrame([("left" if town == "Town" else "right", f"{town} {k} of the world", ["of", "the", "world", town, str(k)]) for k in range(300)], "side string, topic string, words array<string>")
    rare = A._rare_first(many("Town").unionByName(many("City")), 0.8)
    met = rare.filter("side = 'left'").alias("a").join(rare.filter("side = 'right'").alias("b"), "word")
    assert rare.count() == 600 * 2 and met.count() == 300  # of 90,000 pairs

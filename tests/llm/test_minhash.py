import hashlib
import re

import numpy as np
from loomgraph.llm import minhash, simhash


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_signatures_estimate_jaccard():
    r = np.random.default_rng(1)
    base = [f"w{r.integers(4000)}" for _ in range(2000)]
    texts, want = [], []
    for k in (0, 10, 100, 400):
        t = base.copy()
        for i in r.choice(len(t), k, replace=False):
            t[i] = f"x{i}"
        texts.append(" ".join(t))
    s = minhash.signatures([t.encode() for t in texts])
    for k in range(4):
        a, b = shingles(texts[0]), shingles(texts[k])
        want = len(a & b) / len(a | b)
        assert abs(minhash.likeness(s[0], s[k]) - want) < 0.15
    assert (minhash.signatures([texts[0].upper().encode()])[0] == s[0]).all()


def test_batches_do_not_change_signatures():
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{r.integers(500)}" for _ in range(n)).encode() for n in (0, 1, 4, 5, 6, 300, 50_000, 2)]
    together = minhash.signatures(texts)
    for t, s in zip(texts, together):
        assert (minhash.signatures([t])[0] == s).all()
    assert (together[0] == 0xFFFFFFFF).all() and not (together[1] == together[7]).all()


def plain_signature(text):
    """Minima of all permutations over a text's shingles one by one, in Python's integers."""
    m64 = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    def word(w):
        p, total = 1, 0
        for c in w:
            total = (total + (c + 1) * p) & m64
            p = p * 0x9E3779B97F4A7C15 & m64
        return mix((total + len(w)) & m64)

    words = [word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())]
    hashes = []
    for k in range(max(1, len(words) - 4) if words else 0):
        total = 0
        for n, w in enumerate(words[k : k + 5]):
            total = (total * 0x100000001B3 + mix((w + (2 * n + 1) * 0xD6E8FEB86659FD93) & m64)) & m64
        for _ in range(5 - len(words[k : k + 5])):
            total = total * 0x100000001B3 & m64
        hashes.append(mix(total) >> 32)
    a, b = minhash.permutations()
    return [min(((x * int(p) + int(q)) & 0xFFFFFFFF for x in hashes), default=0xFFFFFFFF) for p, q in zip(a, b)]


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in minhash.op2_minhash(spark, sf).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert len(got) == len(docs)
    short = {d for d, t in docs if len(t) < 3000}
    own = {d: plain_signature(t) for d, t in docs if d in short}
    low = lambda s: [x & 0xFFFF for x in s]
    code = lambda s: b"".join(x.to_bytes(2, "little") for x in low(s)).hex()
    share = lambda s, t: sum(x == y for x, y in zip(low(s), low(t))) / len(s)
    checked = 0
    for k, (d, t) in enumerate(docs):
        following, after = docs[(k + 1) % len(docs)]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        x, y = shingles(t), shingles(edited)
        assert abs(r["near_edited"] - (len(x & y) / len(x | y) if x | y else 1)) < 0.25
        if d in short and len(edited) < 3000:
            checked += 1
            s = plain_signature(edited)
            assert r["fingerprint"] == code(own[d]) and r["edited_fingerprint"] == code(s) and abs(r["near_edited"] - share(own[d], s)) < 1e-12
            if following in short:
                assert abs(r["near_next"] - share(own[d], own[following])) < 1e-12
    assert checked > 100


def test_successors_over_ranges(odd_docs, no_docs):
    rows = minhash.with_next(odd_docs, buckets=3).collect()
    assert sum(r["tail"] == 0 for r in rows) == odd_docs.count()
    assert minhash.with_next(no_docs).count() == 0
    ends = {}
    for r in rows:
        ends.setdefault(r["bucket"], []).append(r["tail"])
    assert all(sum(x) == 1 for x in ends.values())


def test_copy_groups_against_brute_force(spark):
    """Chains, edits on both sides of 0.8, copies, texts without words; small groups and cells give the same components."""
    r, texts = np.random.default_rng(8), []
    for k in range(14):
        words = [f"w{x}" for x in r.integers(0, 5000, int(r.integers(4, 160)))]
        for step in range(9):
            texts.append(" ".join(words))
            for at in r.integers(0, len(words), max(1, len(words) * (step % 4) // 90)):
                words[at] = f"new{r.integers(0, 10**9)}"
    texts += [texts[0], texts[0].upper(), "", None, " \n "]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    name = list(range(len(texts)))
    close = 0
    for i in range(len(texts)):
        for j in range(i):
            likeness = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            close += 0.5 <= likeness < 0.8
            if likeness >= 0.8 and name[i] != name[j]:
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    assert close > 20 and len(set(name)) < len(texts) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ({}, {"group_rows": 6, "cluster_bytes": 2000}):
        got = {x["doc_id"]: x["component_id"] for x in minhash.copy_groups(docs, **sizes).collect()}
        assert [got[k] for k in range(len(texts))] == name
    assert minhash.copy_groups(docs.limit(0)).count() == 0


def test_copy_groups_by_simhash(spark):
    """Copies whose fingerprints op4 links are found where the bands of minima propose nothing; the whole texts decide."""
    words = [f"w{k * k % 7919}" for k in range(3_000)]
    changed = lambda n: " ".join("changed" if k in (700, 1900)[:n] or k % 37 == 5 and k < 37 * (n - 2) else w for k, w in enumerate(words))
    bits = lambda text: (simhash.fingerprint(changed(0)) ^ simhash.fingerprint(text)).bit_count()
    a, b, c = changed(0), changed(2), next(changed(n) for n in range(3, 60) if 0 < bits(changed(n)) <= simhash.RADIUS)
    assert bits(b) == 0 and simhash.fingerprint(a.encode()) == simhash.fingerprint(a)
    docs = spark.createDataFrame([(1, "else " * 50), (4, b), (5, c), (3, a), (6, a), (7, None), (8, " ")], "doc_id long, text string")
    want = {(1, 1), (3, 3), (4, 3), (5, 3), (6, 3), (7, 7), (8, 7)}
    assert {tuple(r) for r in minhash.copy_groups(docs, bands=1).collect()} == want
    assert {tuple(r) for r in minhash.copy_groups(docs, threshold=0.9999, bands=1).collect()} == {(d, d if d in (4, 5) else c) for d, c in want}

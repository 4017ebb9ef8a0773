import re
import zlib
from collections import Counter

import corpus_pipeline as C
import pytest
from loomgraph.llm import packing, pseudonyms, toxicity
from test_mixing import fair_queue, turns

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The small corpus with exact and near copies, a toxic text and personal data added, as a folder of tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = next(r for r in docs.filter("n_chars between 3000 and 4000").orderBy("doc_id").collect())
    words = long["text"].split(" ")
    near = " ".join("changed" if k in (100, 300) else w for k, w in enumerate(words))
    toxic = "You stupid worthless moron, what a pathetic disgusting loser and idiot scum you are. " * 3
    mail = "Write to jane.doe42@mail.example.org or call. " + " ".join(f"zq{k}x{k * k}" for k in range(80))
    new = [(9001, long["text"], "en", "src1", 1), (9002, near, "en", "src1", 1), (9003, toxic, "en", "src2", 1), (9004, mail, "en", "src3", 1)]
    sf = f"file://{tmp_path_factory.mktemp('planted')}"
    docs.unionByName(spark.createDataFrame(new, docs.schema)).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    return sf, long["doc_id"]


def copies_by_hand(rows):
    """Least doc_id of each group of texts with a Jaccard similarity of 0.8, all pairs with a word in common."""
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {b""}
    name, owners = {d: d for d in sets}, {}
    for d in sorted(sets):
        near = Counter(o for s in sets[d] for o in owners.get(s, ()))
        for o, common in near.items():
            if common / (len(sets[d]) + len(sets[o]) - common) >= 0.8 and name[o] != name[d]:
                a, b = sorted((name[o], name[d]))
                name = {k: a if v == b else v for k, v in name.items()}
        for s in sets[d]:
            owners.setdefault(s, []).append(d)
    return set(name.values())


def test_run_against_brute_force(spark, planted):
    """Each stage on all that its predecessor kept: by the formulas of its contract, in plain Python."""
    sf, original = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash", "pseudonyms", "mixing", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    odds = {}
    for d, r in rows.items():
        words = [p for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for p in toxicity.pieces(toxicity.normal(w))]
        share = lambda p: sum(model.share.get(x, 0.0) for x in toxicity.subwords(p)) / len(toxicity.subwords(p))
        odds[d] = model.bias + (sum(map(share, words)) / (len(words) + toxicity.BLANKS) if words else 0.0)
    clean = {d for d in rows if odds[d] < -1e-9}
    assert 9003 not in clean and {9001, 9002, 9004, original} <= clean
    one = copies_by_hand([(d, rows[d]["text"]) for d in clean])
    assert 9001 not in one and 9002 not in one and {original, 9004} <= one
    key = pseudonyms.session_key(spark)
    text = {d: pseudonyms.pseudonymised(rows[d]["text"], key)[0] for d in one}
    assert "jane.doe42" not in text[9004]
    sized = [(d, rows[d]["source"], len(re.findall(r"[^\x20\x09-\x0D]+", text[d] or ""))) for d in sorted(one)]
    turn = turns(spark, sized)
    times = whole_passes(sized, turn)
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for d, n in times.items():
        ids = [*tok.encode(text[d] or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[(d, k, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += n
    got = C.run(spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(held) <= -(-total // 4096) + 3


def whole_passes(sized, turn):
    """How often the mix takes each document whole: passes of which it takes half of the words or more."""
    out = {}
    for d, given in fair_queue(sized, turn, by_pass=True)[2].items():
        n = next(n for x, _, n in sized if x == d)
        times = sum(2 * t >= n for t in given.values() if t)
        if times:
            out[d] = times
    return out


def test_stages_keep_columns(spark, planted):
    sf, _ = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in C.STAGES[:4]:
        got = f(spark, docs, sf)
        assert got.columns == docs.columns, name
        docs = got
    assert C.STAGES[4][1](spark, docs.limit(50), sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_empty_and_clashing(spark, odd_docs, no_docs, tmp_path):
    """Odd rows, no rows, and columns with the names that stages use come through all stages."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clash = odd_docs
    for name in ("kept", "rows", "mixed", "passes", "pass", "score", "toxic", "found", "component_id"):
        clash = clash.withColumn(name, odd_docs["slot"])
    for k, rows in enumerate((odd_docs, no_docs, clash)):
        sf = f"file://{tmp_path}/{k}"
        rows.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for name, f in C.STAGES[:4]:
            got = f(spark, docs, sf)
            assert got.columns == rows.columns, name
            if name == "simhash":
                ids = [r["doc_id"] for r in got.collect()]
                assert sorted(ids, key=str) == (sorted([1, 2, 5, 7, 8, None], key=str) if k != 1 else [])
        packed = C.run(spark, sf).collect()
        assert (len(packed) == 0) == (k == 1) and all(r["length"] <= 4096 for r in packed)

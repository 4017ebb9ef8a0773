import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import packing
from tokenizers import Tokenizer


def test_chunks_give_the_tokenizer_s_ids(spark, sf):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = packing.chunk_ids(packing.tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    odd = ["", "  ", "Don't 'S I'll 12,345 _x__ ÀÉß×÷ Ω ΣΑΣ İI é ́x ﬁ ½ª", "<|endoftext|> a<|startoftext|>b <|x|>", "a b c\x1cd\x0be\rf", "日本語 テスト 😀👍🏽 ​!", "Ж'с d'd're'"]
    for t in texts + odd:
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t[:80]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    tok = packing.chunk_ids(packing.tokenizer_path())
    assert np.frombuffer(tok.ids(t), "<u4").tolist()[:-1] == tok.tok.encode(t, add_special_tokens=False).ids


def check_plan(counts, capacity):
    p = packing.plan(counts, capacity, groups=6)
    fill, seen = {}, {}
    order = np.lexsort((p["rank"], p["length"]))
    for k, i in enumerate(order):
        length, rank, each, seq, at = (int(p[n][i]) for n in ("length", "rank", "each", "sequence", "offset"))
        last = k + 1 == len(order) or p["length"][order[k + 1]] != length
        end = counts[length] if last else int(p["rank"][order[k + 1]])
        for r in range(rank, end):
            over = r - rank
            fill.setdefault(seq + over // each, []).append((at + over % each * length, length))
            seen[length] = seen.get(length, 0) + 1
    assert seen == {k: v for k, v in counts.items() if v}
    for parts in fill.values():
        place = 0
        for at, length in sorted(parts):
            assert at == place
            place += length
        assert place <= capacity
    return len(fill)


def test_plans():
    r = np.random.default_rng(0)
    for capacity, n in ((64, 500), (64, 3), (4096, 5000)):
        lengths = np.minimum(capacity, 1 + (r.pareto(1.1, n) * capacity / 12).astype(int))
        counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
        least = -(-int(lengths.sum()) // capacity)
        assert check_plan(counts, capacity) <= max(least + 2, 1.02 * least)
    assert check_plan({}, 64) == 0
    assert check_plan({64: 5}, 64) == 5
    assert check_plan({40: 7, 24: 7}, 64) == 7


def test_rows(spark, odd_docs, no_docs):
    cut = packing.pieces(odd_docs)
    got = packing.packed(cut).collect()
    ids = packing.chunk_ids(packing.tokenizer_path())
    want = []
    for r in odd_docs.collect():
        buf = ids.ids(r["text"])
        for k, s in enumerate(range(0, len(buf), 4 * 4096)):
            want.append((r["doc_id"], k, s // 4, len(buf[s : s + 4 * 4096]) // 4, zlib.crc32(buf[s : s + 4 * 4096])))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        place = 0
        for at, n in sorted(parts):
            assert at == place
            place += n
        assert place <= 4096
    assert len(by) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.packed(packing.pieces(no_docs)).count() == 0


def test_query_against_the_tokenizer(spark, sf):
    """All pieces of all documents by the whole tokenizer, gapless sequences, and as few of them as the tokens need."""
    tok, want = Tokenizer.from_file(packing.tokenizer_path()), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want.append((r["doc_id"], k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())))
    got = packing.op3_packing(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        place = 0
        for at, n in sorted(parts):
            assert at == place
            place += n
        assert place <= 4096
    least = -(-sum(n for *_, n, _ in want) // 4096)
    assert len(held) <= least + 1


def test_ties_and_repeats(spark):
    """Pieces of one length, and rows that are all alike, have places of their own."""
    cut = spark.createDataFrame([(1, 0, 0, 2048, 7)] * 6 + [(k, 0, 0, 1024, 7) for k in range(4)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = [(r["sequence_id"], r["offset"]) for r in packing.packed(cut).collect()]
    assert len(set(got)) == 10 and len({s for s, _ in got}) == 4

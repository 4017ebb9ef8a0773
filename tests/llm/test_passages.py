import random
import re
import unicodedata
import zlib

from loomgraph.llm import passages

A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))


def plain_pieces(text):
    """(start, end, words, is the line's last) word by word, by the rules in words: a sentence ends where a word ends
    with a mark and more follows on the line; one of over 14 words is also cut by the hash of two words."""
    out, at = [], 0
    for line in text.split("\n"):
        words = [(m[0], at + m.start(), at + m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        norm = [unicodedata.normalize("NFKC", w).casefold() for w, _, _ in words]
        ends = [k for k, (w, _, _) in enumerate(words[:-1]) if re.search(r"[.!?]+[)\"'’”]*$", w)] + [len(words) - 1]
        first, start = 0, at
        for k in ends if words else ():
            stop = words[k + 1][1] if k + 1 < len(words) else at + len(line)
            cuts = [c for c in range(first + 1, k) if zlib.crc32(f"{norm[c - 1]} {norm[c]}".encode()) % 4 == 0] if k + 1 - first > 14 else []
            for c in [*cuts, k]:
                end = stop if c == k else words[c][2]
                out.append([start, end, norm[first : c + 1], False])
                first, start = c + 1, end
        if words:
            out[-1][3] = True
        at += len(line) + 1
    return out


def plain_units(text, least=20):
    p, found = plain_pieces(text or ""), set()
    hashes = [zlib.crc32(" ".join(x[2]).encode()) for x in p]
    starts = {k for k in range(len(p)) if k == 0 or p[k - 1][3]}
    for k in range(len(p)):
        near = next((m for m in range(1, len(p) - k + 1) if sum(len(x[2]) for x in p[k : k + m]) >= 12), 0)
        starts |= {k + hashes[k : k + near].index(min(hashes[k : k + near]))} if near else set()
    for i in range(len(p)):
        for j in range(i, len(p)):
            n = sum(len(x[2]) for x in p[i : j + 1])
            if i in starts and n >= least and (j == i or n - len(p[j][2]) < least):
                found.add((i, j))  # the shortest from i on
            if n >= least and p[j][3] and (j == i or n - len(p[i][2]) < least):
                found.add((i, j))  # the shortest up to the line's end
            if n >= least and n - len(p[i][2]) - len(p[j][2]) >= least:
                break
    return [(p[i][0], p[j][1], tuple(w for x in p[i : j + 1] for w in x[2])) for i, j in sorted(found)]


def plain_cleaned(rows, least=20):
    seen, out = set(), {}
    for d, text in sorted(rows):
        spans, until, mine = [], {}, set()
        for s, e, words in plain_units(text, least):
            if until.get(words, 0) <= s:
                if words in seen or words in mine:
                    spans.append((s, e))
                until[words] = e
                mine.add(words)
        seen |= mine
        gone = set()
        for s, e in spans:
            gone |= set(range(s, e + (text[e : e + 1] == "\n")))
        out[d] = ("".join(c for k, c in enumerate(text) if k not in gone), len(spans))
    return out


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in passages.op9_passages(spark, sf).collect()}
    want = plain_cleaned(rows)
    assert got == want and any(n for _, n in want.values())


def test_planted(spark):
    rows = [(3, f"{A}\nown three"), (1, f"first {A}"), (2, f"own two\n{A.upper()}\nend"), (4, f"{B}"), (5, f"x\n{B}\ny"), (6, "short line\nshort line"), (7, None), (8, "")]
    got = {r["doc_id"]: r for r in passages.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5]["text"] == "x\ny" and got[4]["n_removed"] == 0 and got[1]["n_removed"] == 0
    assert len(got[3]["text"]) < 120 and got[3]["text"].endswith("own three") and got[3]["removed"][0]["first_doc_id"] == 2
    assert got[2]["text"].startswith("own two\n") and got[2]["text"].endswith("end") and len(got[2]["text"]) < 120
    assert got[6]["text"] == "short line\nshort line" and got[7]["text"] is None and got[8]["text"] == ""


def test_passages_at_any_place(spark):
    """Passages of 60 words, with and without marks, begin and end anywhere in a line: all later ones are caught, and
    most of their words go; documents without one stay."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n))
    rows, planted, clean = [], {}, set()
    for k in range(60):
        words = [word() for _ in range(60)]
        for at in range(9 + k % 13, 60, 9 + k % 13) if k % 3 else ():
            words[at] += "."
        for copy in range(2):
            d = 10 * k + copy
            rows.append((d, f"{prose(40)} {' '.join(words)} {prose(40)}\n{prose(30)}"))
            if copy:
                planted[d] = words
        clean.add(10 * k + 5)
        rows.append((10 * k + 5, f"{prose(80)}\n{prose(60)}"))
    got = {x["doc_id"]: x for x in passages.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d]["n_removed"] > 0 for d in planted) and all(got[d]["n_removed"] == 0 for d in got if d not in planted)
    left = [sum(w in set(got[d]["text"].split()) for w in words if len(w) > 4) / sum(len(w) > 4 for w in words) for d, words in planted.items()]
    assert sum(left) / len(left) < 0.3


def test_one_id_and_several_texts(spark):
    """Rows that share a doc_id and not the text keep their own offsets; equal rows are one document."""
    other = f"An altogether different start of it all. {B}"
    rows = [(1, f"{A}\none"), (2, f"two\n{A}\n{B}"), (2, other), (2, other), (None, A)]
    got = [tuple(r)[:3] for r in passages.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (1, f"{A}\none", 0) in got and (None, A, 0) in got and len(got) == 5
    texts = sorted(t for d, t, _ in got if d == 2)
    assert sum(t.startswith("An altogether different start of it all.") for t in texts) == 2 and sum(t.startswith("two") and "alpha5 " not in t for t in texts) == 1
    assert sum(" beta30 " in t for t in texts) in (1, 2)  # one of the two texts has it first


def test_paragraphs_and_edges(odd_docs, no_docs):
    assert len(passages.units_of(f"{A}\n{A}\n\n{B}", paragraphs=True)) == 2
    got = passages.cleaned(odd_docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == odd_docs.count() and by[6]["text"] == "" and by[6]["removed"][0]["first_doc_id"] == 5
    assert passages.cleaned(no_docs).count() == 0


def test_wrapped_listed_and_inner_passages(spark):
    """A passage of short lines, and one inside of longer lines, goes; short repeats and the first occurrence stay."""
    words = [f"gamma{i}" for i in range(60)]
    wrapped = "\n".join(" ".join(words[k : k + 12]) for k in range(0, 60, 12))
    verse = "\n\n".join(" ".join(words[k : k + 4]) + "," for k in range(0, 60, 4))
    inner = " ".join(" ".join(words[k : k + 12]) + "." for k in range(0, 60, 12))
    short = "Only nine words are in this one short line."
    rows = [(10 * k + d, f"Own start {k} {d}.\n{p}\nown end {k} {d}") for k, p in enumerate((wrapped, verse)) for d in (1, 2)]
    rows += [(31, f"First of all. {inner} So it ends."), (32, f"Here is more. {inner} Then it goes on."), (33, short), (34, f"x\n{short}\ny")]
    rows += [(41, "la la la\n" * 20), (42, "Same here\n" + "la la la\n" * 8)]
    got = {r["doc_id"]: r for r in passages.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for k in (0, 10):
        assert got[k + 1]["text"] == text[k + 1] and got[k + 2]["text"] == f"Own start {k // 10} 2.\nown end {k // 10} 2"
    assert got[31]["text"] == text[31] and got[32]["text"] == "Here is more. Then it goes on."
    assert got[33]["text"] == text[33] and got[34]["text"] == text[34]
    assert got[41]["text"].startswith("la la la\n" * 8) and {(r["first_doc_id"]) for r in got[42]["removed"]} == {41}

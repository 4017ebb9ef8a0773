"""Repeated passages, removed by runs of sentences and lines.

A text's lines are cut into sentences, and sentences of more than LONG words into pieces, after words that a hash of
the word and the one before it picks: the same words are cut at the same places wherever they stand. Units are the
shortest runs of pieces that have min_words words, from each line's first piece on, from the piece with the least hash
of any adjacent ones that have NEAR words on, and up to each line's last piece (or they are the text's paragraphs).
Units are normalised and hashed; digests are grouped over the whole corpus; the occurrence with the least (doc_id, offset) stays
and the others are removed, with their original offsets kept beside the cleaned text. A passage of 50 words is thus
found wherever it begins and ends in its sentences, lines and texts. Less than min_words words are never removed: they
repeat by chance."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._common import WORD, bounded_batches, table, written

#: Words of a unit, at least; words of a sentence that is not cut; one in how many places of a longer one is a cut;
#: words of adjacent pieces of which at least one starts a unit.
MIN_WORDS, LONG, CUT, NEAR = 20, 14, 4, 12
_WORDS = re.compile(WORD)
#: A line; a sentence's end in it with the blanks after it, each run of marks read once; marks that need no blank.
_LINE, _END = re.compile(r"[^\n]+"), re.compile(r"(?<![.!?])[.!?]++[)\"'’”]*+[ \t]++(?=[^ \t\n])")
_FULL_STOP, _BLANK_LINE = re.compile(r"[。！？]++"), re.compile(r"\n\s*\n")


def _sentences(text: str) -> Iterator[tuple[int, int]]:
    """Places of the sentences of each line, in time by the text's length: up to ends with a blank while the line has one,
    then up to full stops that need none, then the rest."""
    for line in _LINE.finditer(text):
        at = line.start()
        for pattern in (_END, _FULL_STOP):
            for m in pattern.finditer(text, at, line.end() + (pattern is _END)):
                yield at, m.end()
                at = m.end()
        if at < line.end():
            yield at, line.end()


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Places between blank lines."""
    at = 0
    for m in _BLANK_LINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _normal(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def _digest(plain: str) -> bytes:
    return hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def pieces_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normal form) of a text's sentences, long ones in pieces; all are adjacent within a line.

    Normal form: NFKC, case-folded, words with one blank between them."""
    out = []
    for at, until in _sentences(text):
        words = _WORDS.findall(text, at, until)
        if not words:
            continue
        if len(words) <= LONG:
            out.append((at, until, len(words), _normal(" ".join(words))))
            continue
        plain = [_normal(w) for w in words]
        start, low, ends = at, 0, [x.end() for x in _WORDS.finditer(text, at, until)]
        for k in range(1, len(plain) - 1):
            if crc32(f"{plain[k - 1]} {plain[k]}".encode("utf-8", "surrogatepass")) % CUT == 0:
                end = ends[k]
                out.append((start, end, k + 1 - low, " ".join(plain[low : k + 1])))
                start, low = end, k + 1
        out.append((start, until, len(plain) - low, " ".join(plain[low:])))
    return out


def units_of(text: str | None, min_words: int = MIN_WORDS, paragraphs: bool = False) -> list[tuple[int, int, bytes, bool]]:
    """(start, end, digest of 12 bytes, again) of the text's units of at least min_words words, by start and end, none
    inside of another but from or to the same place.

    again: an equal unit is before it in the text. A unit that overlaps an equal one before it is left out."""
    if not text:
        return []
    if paragraphs:
        atoms = [(s, e, len(w), _normal(" ".join(w))) for s, e in _paragraphs(text) if (w := _WORDS.findall(text, s, e))]
        runs = [(i, i) for i, a in enumerate(atoms) if a[2] >= min_words]
    else:
        atoms = pieces_of(text)
        total = [0, *accumulate(a[2] for a in atoms)]
        line_ends = [j for j, a in enumerate(atoms) if j + 1 == len(atoms) or "\n" in text[a[1] : atoms[j + 1][0]]]
        mark = [(crc32(a[3].encode("utf-8", "surrogatepass")), i) for i, a in enumerate(atoms)]
        starts = {0, *(j + 1 for j in line_ends[:-1])}
        for i in range(len(atoms)):
            if total[i] + NEAR > total[-1]:
                break
            starts.add(min(mark[i : bisect_left(total, total[i] + NEAR)])[1])
        from_some = {(i, bisect_left(total, total[i] + min_words) - 1) for i in starts if total[i] + min_words <= total[-1]}
        runs = sorted(from_some | {(bisect_right(total, total[j + 1] - min_words) - 1, j) for j in line_ends if total[j + 1] >= min_words})
    out, until = [], {}
    for i, j in runs:
        start, end, d = atoms[i][0], atoms[j][1], _digest(" ".join(a[3] for a in atoms[i : j + 1]))
        before = until.get(d)
        if before is None or before <= start:
            until[d] = end
            out.append((start, end, d, before is not None))
    return out


#: A unit: its row's doc_id and variant, its place, the first 8 and the last 4 bytes of its digest.
UNIT = "doc_id long, variant int, start int, end int, high long, low int, again boolean"


def units(docs: DataFrame, min_words: int = MIN_WORDS, paragraphs: bool = False) -> DataFrame:
    """UNIT rows of docs (doc_id, variant, text)."""
    bounded_batches(docs.sparkSession)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
    names = ["doc_id", "variant", "start", "end", "high", "low", "again"]

    def of(batches):
        for b in batches:
            cols = [[] for _ in names]
            for doc, variant, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for s, e, d, again in units_of(text.as_py(), min_words, paragraphs):
                    for c, x in zip(cols, (doc, variant, s, e, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), again)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("variant").cast("int"), "text").mapInArrow(of, UNIT)


def with_variant(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text) plus variant: 0 but where rows share a doc_id and not the text, whose texts are numbered by
    their digests; and whether there are such rows."""
    digest = F.xxhash64("text")
    texts = docs.filter("doc_id is not null").select("doc_id", digest.alias("digest")).distinct()
    several = texts.groupBy("doc_id").agg(F.sort_array(F.collect_set("digest")).alias("digests")).filter(F.size("digests") > 1)
    several = written(several, "several")
    if several.isEmpty():
        return docs.withColumn("variant", F.lit(0)), False
    named = several.withColumnRenamed("doc_id", "named")
    got = docs.join(named, F.col("doc_id") == F.col("named"), "left")
    at = F.when(F.col("digests").isNull(), 0).otherwise(F.array_position("digests", digest) - 1)
    return got.select("doc_id", "text", at.cast("int").alias("variant")), True


def repeats(found: DataFrame, several: bool = False) -> DataFrame:
    """Units that an earlier ranked unit equals: doc_id, variant, start, end, first_doc_id.

    Digests are counted by partial sums; only those that repeat are joined back, and a digest that many
    units have is a skewed side of a sort-merge join, which Spark splits. several: doc_ids have several texts."""
    rank = F.struct("doc_id", "variant") if several else F.col("doc_id")
    first = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    got = found.join(first, ["high", "low"]).filter((rank > F.col("first")) | F.col("again"))
    return got.select("doc_id", "variant", "start", "end", (F.col("first")["doc_id"] if several else F.col("first")).alias("first_doc_id"))


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS, paragraphs: bool = False) -> DataFrame:
    """doc_id, text without the removed units (and the line ends after them), n_removed and removed:
    array of (start, end, first_doc_id) by original offsets, of every row.

    Rows that repeat a doc_id and its text are one document: what is removed from one is removed from all.
    Rows that share a doc_id but not the text are documents of their own, ranked by a digest of their texts.
    Null texts stay null; rows with a null doc_id stay as they are and count for nothing; no rows give no rows."""
    bounded_batches(docs.sparkSession)
    docs, several = with_variant(docs.select(F.col("doc_id").cast("long"), "text"))
    found = written(units(docs.filter("doc_id is not null"), min_words, paragraphs), "units")
    spans = repeats(found, several).groupBy("doc_id", "variant").agg(F.sort_array(F.collect_set(F.struct("start", "end", "first_doc_id"))).alias("removed"))
    both = docs.join(spans, ["doc_id", "variant"], "left").select("doc_id", "text", "removed")
    names = ["doc_id", "text", "n_removed", "removed"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc_id", pa.int64())]))

    def of(batches):
        for b in batches:
            texts, removed = [], [x or [] for x in b.column(2).to_pylist()]
            for text, cut in zip(b.column(1), removed):
                text, at, out = text.as_py(), 0, []
                for r in cut:
                    out.append(text[at : r["start"]])
                    at = max(at, r["end"] + (text[r["end"] : r["end"] + 1] == "\n"))
                texts.append("".join([*out, text[at:]]) if cut else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(r) for r in removed], pa.int32()), pa.array(removed, kind)], names)

    return both.mapInArrow(of, "doc_id long, text string, n_removed int, removed array<struct<start:int,end:int,first_doc_id:bigint>>")


def op9_passages(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages, and what was removed from where; see cleaned()."""
    return cleaned(table(spark, sf_dir, "documents"))

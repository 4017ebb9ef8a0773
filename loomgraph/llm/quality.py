"""Quality rules as a short-circuit cascade.

Every rule is a test of a text's features. What a rule costs beyond the features that every text gets
anyway, and the share of documents that it rejects, are estimated on a bounded random sample, and the
rules run in the order of rejections per cost: what a cheap and selective rule rejects is never shown to
the later ones. The base rules, which need those features only, go first. The order changes the cost
only; a document is kept if no rule rejects it, whatever the order."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._common import WORD, bounded_batches, table

_WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
#: Rows on which costs and selectivities are estimated, and files that they come from at most.
SAMPLE_ROWS, SAMPLE_FILES = 400, 16


class Features:
    """Features of one text, each computed when a rule first asks for it. Null is an empty text."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORDS.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORDS.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text has twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen, reached, total = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                total += i + 3 - max(reached, i)
                reached = i + 3
        return total

    @cached_property
    def commonest(self) -> float:
        """Share of the most frequent word."""
        return max(Counter(self.words).values(), default=0) / max(1, self.n_words)

    @cached_property
    def upper(self) -> float:
        """Share of words in capitals, of those with a letter pair."""
        return sum(x.isupper() for x in self.words if len(x) > 1) / max(1, self.n_words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


BASE = [
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
]
#: Thresholds are far outside of clean prose.
RULES = [
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: f.n_words > 0 and not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("one_word", lambda f: f.commonest > 0.3),
    Rule("capitals", lambda f: f.upper > 0.7),
]


def _output(f: Features) -> tuple:
    """The features of every row of the output."""
    return f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words


def cascade(sample: list[str | None], rules: list[Rule], clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """The rules by rejected documents per second of the sample that the base lets through, best first; ties keep their order.

    A rule's time is what it adds to the output's features, which are there before it runs; the least of three runs."""
    known = [Features(x) for x in sample]
    for f in known:
        _output(f)
    known = [f for f in known if not any(r.rejects(f) for r in BASE)]
    score = []
    for k, r in enumerate(rules):
        best, rejected = float("inf"), 0
        for _ in range(3):
            fresh = [copy(f) for f in known]  # with the output's features, without those of other rules
            start = clock()
            rejected = sum(map(r.rejects, fresh))
            best = min(best, clock() - start)
        score.append((-(rejected + 0.5) / (best + 1e-9), k))
    return [rules[k] for _, k in sorted(score)]


def random_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES, seed: int = 29) -> DataFrame:
    """About `rows` random rows of a table that is read as it is stored, from some random files of it: the rest isn't read."""
    paths = sorted(docs.inputFiles())
    if not paths:
        return docs.limit(0)
    some = docs.sparkSession.read.schema(docs.schema).parquet(*random.Random(seed).sample(paths, min(files, len(paths))))
    n = some.count()  # of the files' footers
    return some.sample(fraction=min(1.0, 1.2 * rows / max(1, n)), seed=seed).limit(rows)


def verdict(f: Features, rules: list[Rule]) -> tuple[bool, bool]:
    """(base failed, kept): the first rule that rejects ends it."""
    failed = any(r.rejects(f) for r in BASE)
    return failed, not failed and not any(r.rejects(f) for r in rules)


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample: DataFrame | None = None) -> DataFrame:
    """doc_id, the base features, base_failed and kept of every row. sample: rows with a text on which the order of
    the rules is estimated, by default a random part of docs.

    Null and empty texts have no words and fail the base; a null doc_id and repeated rows come out as
    they are; other columns aren't read; no rows give no rows."""
    bounded_batches(docs.sparkSession)
    rules = RULES if rules is None else rules
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if sample is None:
        sample = docs.sample(fraction=min(1.0, 1.2 * SAMPLE_ROWS / max(1, docs.count())), seed=29).limit(SAMPLE_ROWS)
    ordered = cascade([r["text"] for r in sample.select("text").limit(SAMPLE_ROWS).toLocalIterator()], rules)
    names = [r.name for r in ordered]  # rules are found by name where the module can be imported
    known = {r.name: r for r in RULES}
    run = names if all(known.get(r.name) is r for r in ordered) else ordered
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    def of(batches):
        chain = [known_rule(r) if isinstance(r, str) else r for r in run]
        for b in batches:
            rows = []
            for text in b.column(1):
                f = Features(text.as_py())
                rows.append((*_output(f), *verdict(f, chain)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], fields)

    return docs.mapInArrow(of, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def known_rule(name: str) -> Rule:
    return next(r for r in RULES if r.name == name)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Base features and the verdict on all documents; see judged()."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, sample=random_rows(docs))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
v AS (SELECT *, lead(word) OVER t AS b, lead(word, 2) OVER t AS c FROM w WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, (c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c) > 1)::INT AS again FROM v),
x AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside, count(*) OVER (PARTITION BY doc_id, word) AS same FROM r),
f AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(inside) AS n_repeat_words, max(same) AS same, count(*) FILTER (length(word) > 1 AND upper(word) = word AND lower(word) <> word) AS caps FROM x GROUP BY 1),
l AS (SELECT doc_id, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM d),
a AS (SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, coalesce(same, 0) AS same, coalesce(caps, 0) AS caps FROM l LEFT JOIN f ON l.doc_id = f.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (10 * n_symbols > n_words OR (n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words)) OR 2 * n_dup_lines > n_lines OR same > 0.3 * n_words OR caps > 0.7 * n_words) AS kept
FROM b
"""

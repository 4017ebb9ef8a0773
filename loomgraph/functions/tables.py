"""Table functions for SQL: SELECT d.id, s.* FROM docs d, LATERAL parse_narrative(d.text) s."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomgraph.functions.text import ABBREVIATIONS

_END = re.compile(r"[.!?][\t\n\f\r ]+|\x01")
_SHORT = re.compile(rf"(?:^|[^A-Za-z0-9_])(?:{'|'.join(ABBREVIATIONS)}|[A-Z])\.$")


def sentences_of(text: str) -> list[str]:
    """The sentences that text.sentences() gives for the normalised text."""
    text, out, at = text.replace("\n", " ").replace("  ", " ").strip(" "), [], 0
    for m in _END.finditer(text):
        if m[0] == "\x01" or not _SHORT.search(text, max(0, m.start() - 12), m.start() + 1):
            out.append(text[at : m.start() + (m[0] != "\x01")])
            at = m.end()
    return [x for x in (s.replace("\x02", "").strip(" ") for s in [*out, text[at:]]) if x]


class ParseNarrative:
    """A narrative's sentences with their offsets, from 1; null and empty texts have none."""

    def eval(self, text: str):
        for k, s in enumerate(sentences_of(text or ""), 1):
            yield k, s


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_narrative", udtf(ParseNarrative, returnType="offset int, text string"))

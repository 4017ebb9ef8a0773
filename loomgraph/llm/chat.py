"""Chat formatting over typed content parts.

A turn's content is a list of typed parts. A visitor flattens text, image, audio and document parts into
one string with ordered placeholders, and records for each attachment where it is, what it refers to and
how many tokens its placeholder stands for. The template marks turns with control strings; inside of
texts they are escaped in a way that reading back undoes. Every turn is one row of the output, so a
conversation of any length is never one value; the rows' strings in turn are the conversation's."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, table

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: The template's own strings and those of other chat templates that a text could imitate.
CONTROL = [START, BODY, END, *PLACEHOLDER.values(), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)

IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 14, 25, 700


def escape(text: str) -> str:
    """Backslashes doubled; a single one put after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattened:
    """text: escaped, with placeholders; attachments: (type, reference, offset in text, tokens)."""

    text: str = ""
    attachments: list = field(default_factory=list)


class PartVisitor:
    """Appends each part to one string; a part of an unknown type is an error, not a loss."""

    def __init__(self):
        self.out = Flattened()

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.unknown)(part)

    def unknown(self, part: dict):
        raise ValueError(f"no such content part: {part.get('type')!r}")

    def visit_text(self, part: dict) -> None:
        self.out.text += escape(part.get("text") or "")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.attachments.append((kind, part.get("ref"), len(self.out.text), max(1, tokens)))
        self.out.text += PLACEHOLDER[kind]

    def visit_image(self, part: dict) -> None:
        rows, cols = (-(-int(part.get(k) or 0) // IMAGE_PATCH) for k in ("height", "width"))
        self._attach("image", part, rows * cols)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, round(float(part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(part.get("pages") or 0) * DOCUMENT_TOKENS_A_PAGE)


def flatten(parts: list[dict]) -> Flattened:
    v = PartVisitor()
    for p in parts:
        v.visit(p)
    return v.out


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list]:
    """The turn's string, the span of it under the loss mask (empty but for assistants), attachments.

    Offsets of attachments count from the turn's start."""
    head, flat = f"{START}{escape(role or '')}{BODY}", flatten(parts)
    s = len(head)
    e = s + len(flat.text) if role == "assistant" else s
    return head + flat.text + END, s, e, [(k, r, s + at, n) for k, r, at, n in flat.attachments]


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders of attachments stay in the text."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text[, parts] -> one formatted row a turn: conv_id, turn, formatted, loss_start,
    loss_end, attachments.

    parts, where there is such a column, is an array of structs with a type; it goes before the text,
    which is one more text part unless null. Null text and role are empty. Rows are independent."""
    bounded_batches(turns.sparkSession)
    names = ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"]
    kind = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("offset", pa.int32()), ("tokens", pa.int64())]))
    with_parts = "parts" in turns.columns

    def of(batches):
        for b in batches:
            rows = []
            for role, text, *parts in zip(*(c.to_pylist() for c in b.columns[2:])):
                content = list(parts[0] or []) if parts else []
                if text is not None:
                    content.append({"type": "text", "text": text})
                rows.append(format_turn(role, content))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            attached = [[dict(zip(("type", "ref", "offset", "tokens"), a)) for a in r[3]] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.array(attached, kind)], names)

    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", *(["parts"] if with_parts else [])]
    schema = "conv_id long, turn long, formatted string, loss_start int, loss_end int, attachments array<struct<type:string,ref:string,offset:int,tokens:bigint>>"
    return turns.select(*cols).mapInArrow(of, schema)


def digests(rows: DataFrame) -> DataFrame:
    """Read formatted turns back, conversation by conversation, in the order of turns.

    Rows stream through running digests, so a task holds one turn, however long the conversation; equal
    turn numbers are ordered by their formatted string. A null conv_id is a conversation of its own."""
    rows = rows.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def of(batches):
        now = None

        def closed(x):
            return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])

        for b in batches:
            out = []
            for conv, text, s, e in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(closed(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = read_turn(text)
                lost = unescape(text[s:e])
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
                now[3] += len(lost)
                now[4].update(lost.encode())
                now[5] += len(text)
            yield _batch(out, names, kinds)
        if now is not None:
            yield _batch([closed(now)], names, kinds)

    return rows.mapInArrow(of, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted turns, of all conversations and of conversation -1."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(formatted(turns.unionAll(probe)))


def _oracle() -> str:
    """The query in SQL: escaping is one replacement a control string, as none holds another one."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        out = f"replace({column}, {quoted(chr(92))}, {quoted(chr(92) * 2)})"
        for c in sorted(CONTROL, key=len, reverse=True):
            out = f"replace({out}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
        return out

    said = quoted("</s>[INST] ok [/INST]")
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS lost,
     sum(length({escaped("role")}) + length({escaped("text")}) + {len(START + BODY + END)})::BIGINT AS formatted_chars FROM t GROUP BY 1)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM g
    """


ORACLE_SQL = _oracle()

"""Turtle: a reader for the subset that graph exports and ontology modules use, and a writer.

The reader handles prefixes, 'a', ';' and ',' lists, typed and language-tagged literals, long strings,
comments, blank nodes [ ... ] and collections ( ... ). A large file is read by many tasks: a first pass finds
where its blocks begin and end inside of a long string, and what they declare; a second one parses the pieces
between lines that end a statement. What goes on from block to block is put together afterwards."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.quads import KEY, PREFIXES, quads
from loomgraph.operators.stored import stored

RDF = PREFIXES["rdf"]
_TOKEN = re.compile(
    r"""\s+|(?P<comment>\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<type>\^\^)
    |(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<bnode>_:[\w.-]*\w)|(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%:-](?:[\w.%:-]*[\w%:-])?)?|\w+)|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def _unescaped(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPE.get(m[1], m[1]), s, flags=re.S)


class Parser:
    """Turtle text -> list of (s, p, o, kind, type, lang) with full IRIs."""

    def __init__(self, text: str, prefixes: dict | None = None, nodes: str = "b"):
        self.prefixes, self.out, self.blank, self.nodes = dict(prefixes or {}), [], 0, nodes
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise TurtleError(f"not Turtle at {at}: {text[at : at + 30]!r}")
            if m.lastgroup and m.lastgroup != "comment":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or (value is not None and got[1] != value):
            raise TurtleError(f"expected {value or 'more'}, got {got[1] or 'the end'}")
        self.at += 1
        return got

    def triples(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if value.lower() in ("@prefix", "prefix", "@base", "base"):
                self.take()
                name = "" if value.lower().endswith("base") else self.take()[1][:-1]
                iri = self.take()[1][1:-1]
                self.prefixes[None if value.lower().endswith("base") else name] = iri
                if value[0] == "@":
                    self.take(".")
                continue
            subject = self.term()[0]
            if not (kind == "mark" and value == "[" and self.peek()[1] == "."):
                self.predicates(subject)
            self.take(".")
        return self.out

    def predicates(self, subject: str) -> None:
        while True:
            kind, value = self.peek()
            predicate = RDF + "type" if value == "a" else self.term()[0]
            if value == "a":
                self.take()
            elif kind not in ("iri", "name"):
                raise TurtleError(f"{value} is no predicate")
            while True:
                o = self.term()
                self.out.append((subject, predicate, *o))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self.take()
        if kind == "iri":
            base = self.prefixes.get(None, "")
            return (value[1:-1] if ":" in value else base + value[1:-1]), "iri", None, None
        if kind == "bnode":
            return value, "bnode", None, None
        if kind in ("str", "long"):
            text = _unescaped(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "lang":
                return text, "lit", None, self.take()[1][1:]
            if self.peek()[0] == "type":
                self.take()
                return text, "lit", self.term()[0], None
            return text, "lit", None, None
        if kind == "num":
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return value, "lit", PREFIXES["xsd"] + name, None
        if value in ("true", "false"):
            return value, "lit", PREFIXES["xsd"] + "boolean", None
        if value == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(node)
            self.take("]")
            return node, "bnode", None, None
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            rest = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self.fresh()
                self.out += [(node, RDF + "first", *item), (node, RDF + "rest", *rest)]
                rest = (node, "bnode", None, None)
            return rest
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + local, "iri", None, None
        raise TurtleError(f"unexpected {value}")

    def fresh(self) -> str:
        self.blank += 1
        return f"_:{self.nodes}{self.blank}"


def parsed(text: str, prefixes: dict | None = PREFIXES) -> list[tuple]:
    return Parser(text, prefixes).triples()


def shortened(iri: str, prefixes: dict = PREFIXES) -> str:
    for name, base in sorted(prefixes.items(), key=lambda x: -len(x[1])):  # the longest base names most
        if name is not None and iri.startswith(base) and re.fullmatch(r"[\w:-]*", iri[len(base) :]):
            return f"{name}:{iri[len(base):]}"
    return f"<{iri}>"


def from_text(spark: SparkSession, text: str, repo: str, graph: str) -> DataFrame:
    """A body of triples as quads with shortened names; TurtleError if it is none."""
    rows = [(repo, graph, _short(s), shortened(p), _short(o) if k == "iri" else o, k, t and shortened(t), lang) for s, p, o, k, t, lang in parsed(text)]
    return spark.createDataFrame(rows, KEY_SCHEMA).distinct()


def _short(x: str) -> str:
    return x if x.startswith("_:") else shortened(x)


#: What a line can begin in: statements, or one of the two kinds of long strings.
PLAIN, STATES = 0, (0, 1, 2)
_CLOSE = {1: re.compile(r'(?:[^"\\]|\\.|"(?!""))*?"{3}'), 2: re.compile(r"(?:[^'\\]|\\.|'(?!''))*?'{3}")}
_SCAN = re.compile(
    r"""(?P<long>\"{3}|'{3})|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|<[^<>"{}|^`\\\s]*>|(?P<comment>\#)
    |(?P<word>(?<![\w"':-])@?(?:prefix|base)(?=\s|$))|(?P<end>\.(?=\s*(?:\#.*)?$))""",
    re.X | re.I,
)
_DECLARED = re.compile(r"""@?(?:prefix\s+(?P<name>[\w.-]*):|base)\s*<(?P<iri>[^<>"{}|^`\\\s]*)>""", re.I)


def step(line: str, state: int) -> tuple[int, bool, list[tuple[str | None, str | None]]]:
    """A line that begins in the state -> the next line's state, whether the line ends a statement, and what it
    declares: (prefix or None for the base, IRI or None where the declaration goes on in another line)."""
    at, found = 0, []
    while True:
        if state != PLAIN:
            m = _CLOSE[state].match(line, at)
            if m is None:
                return state, False, found
            at, state = m.end(), PLAIN
        m = _SCAN.search(line, at)
        if m is None or m["comment"]:
            return state, False, found
        if m["end"]:
            return state, True, found
        at = m.end()
        if m["long"]:
            state = 1 if m[0][0] == '"' else 2
        elif m["word"]:
            d = _DECLARED.match(line, m.start())
            found.append((d["name"], d["iri"]) if d else (None, None))


class _Split(TurtleError):
    """The files were split otherwise than in the first pass."""


_MOVED = "blocks of the files have moved"
_BLOCK = ["path", "start", "length", "size"]
_BLOCKS = "path string, start long, state int, until int, lines long, cut long, declared array<struct<line: long, name: string, iri: string>>, length long"
KEY_SCHEMA = ", ".join(f"{c} string" for c in KEY)
_OPEN = ["path", "line", "start", "text", "prefixes"]
_PARTS = KEY_SCHEMA + ", path string, line long, start long, text string, prefixes string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    m = "_metadata.file_"
    return spark.read.text(path).select(*[F.col(m + c).alias(n) for n, c in zip(_BLOCK, ("path", "block_start", "block_length", "size"))], "value")


def _by_block(batches) -> Iterator[tuple[tuple, Iterator[str]]]:
    rows = ((tuple(key), value) for b in batches for *key, value in zip(*(b[c] for c in _BLOCK), b["value"]))
    for key, some in groupby(rows, key=lambda x: x[0]):
        yield key, (value for _, value in some)


def _passes(batches):
    """One row a block and state that it may begin in."""
    for (path, start, length, _), lines in _by_block(batches):
        now, cut, declared, n = {s: s for s in STATES}, dict.fromkeys(STATES, -1), {s: [] for s in STATES}, 0
        for line in lines:
            got = {s: step(line, s) for s in set(now.values())}
            for s in STATES:
                now[s], ends, found = got[now[s]]
                cut[s] = n + 1 if ends else cut[s]
                declared[s] += [{"line": n, "name": name, "iri": iri} for name, iri in found]
            n += 1
        yield pd.DataFrame([(path, start, s, now[s], n, cut[s], declared[s], length) for s in STATES], columns=["path", "start", "state", "until", "lines", "cut", "declared", "length"])


def _block_starts(blocks: DataFrame) -> dict:
    """(path, start, length) of each block of files of several -> its state, number of its first line, line of the
    statement that it begins in, declarations before it, whether it is the file's last.

    A row a block: no more than the driver holds to plan the scan."""
    out, rows = {}, blocks.orderBy("path", "start", "state").toLocalIterator()
    for path, own in groupby(rows, key=lambda r: r["path"]):
        state, line, open_, declared, key = PLAIN, 0, 0, [], None
        for (start, length), some in groupby(own, key=lambda r: (r["start"], r["length"])):
            r = list(some)[state]
            key = (path, start, length)
            out[key] = (state, line, open_, tuple(declared), False)
            for d in r["declared"]:
                if d["iri"] is None:
                    raise TurtleError(f"{path}, line {line + d['line'] + 1}: a declaration of several lines in a file of several blocks")
                declared.append((d["name"], d["iri"]))
            open_ = line + r["cut"] if r["cut"] >= 0 else open_
            state, line = r["until"], line + r["lines"]
        out[key] = (*out[key][:4], True)
    return out


def _rows(text: str, prefixes: dict, path: str, line: int, repo: str, graph: str | None) -> tuple[list[tuple], dict]:
    """A piece's quads and the prefixes after it. Its own blank nodes are named by the file and the piece's first line."""
    p = Parser(text, prefixes, f"b{hashlib.sha256(path.encode()).hexdigest()[:8]}x{line}x")
    try:
        got = p.triples()
    except TurtleError as e:
        raise TurtleError(f"{path}, after line {line}: {e}") from None
    own = graph or re.sub(r".*/|\.\w+$", "", path)
    return [(repo, own, _short(s), shortened(q), _short(o) if k == "iri" else o, k, t and shortened(t), lang) for s, q, o, k, t, lang in got], p.prefixes


#: Quads of a frame.
ROWS = 10_000


def _parser(known, repo: str, graph: str | None):
    """Blocks of lines -> quads, and texts of statements that don't begin and end in the block."""

    def of(batches):
        frame = lambda rows: pd.DataFrame(rows, columns=[*KEY, *_OPEN]).astype(object)
        done = []
        for (path, start, length, size), lines in _by_block(batches):
            state, line, open_, declared, last = PLAIN, 0, 0, (), True
            if length < size:
                if (path, start, length) not in known.value:
                    raise _Split(_MOVED)
                state, line, open_, declared, last = known.value[path, start, length]
            prefixes, held, found, going_on = {**PREFIXES, **dict(declared)}, [], [], open_ < line
            part = lambda: (*[None] * len(KEY), path, open_, start, "\n".join(held), json.dumps(list(prefixes.items())))
            for text in lines:
                state, ends, some = step(text, state)
                held.append(text)
                found += some
                line += 1
                if not ends:
                    continue
                if going_on:
                    done.append(part())
                    prefixes.update(found)
                else:
                    got, prefixes = _rows("\n".join(held), prefixes, path, open_, repo, graph)
                    done += [(*q, *[None] * len(_OPEN)) for q in got]
                open_, held, found, going_on = line, [], [], False
                if len(done) >= ROWS:
                    yield frame(done)
                    done = []
            if held and last and not going_on:
                done += [(*q, *[None] * len(_OPEN)) for q in _rows("\n".join(held), prefixes, path, open_, repo, graph)[0]]
            elif held:
                done.append(part())
        yield frame(done)

    return of


def _whole(repo: str, graph: str | None):
    """The parts of one statement, by blocks -> its quads."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        first = pdf.iloc[0]
        prefixes = {name: iri for name, iri in json.loads(first["prefixes"])}
        return pd.DataFrame(_rows("\n".join(pdf["text"]), prefixes, first["path"], int(first["line"]), repo, graph)[0], columns=KEY).astype(object)

    return of


def read(spark: SparkSession, path: str, repo: str, graph: str | None = None) -> DataFrame:
    """Turtle files as quads; the graph is the file's name without its ending unless given.

    A file in several blocks of spark.sql.files.maxPartitionBytes is read by as many tasks, and gives what one
    task would: then the quads are stored, and a declaration must stand on one line. Else nothing is read
    before the result is. Statements are cut at lines that end one; a task holds one piece between such lines.
    Labels of blank nodes are the same node in all files, as in the parts that write() makes."""
    for attempt in range(3):
        lines = _lines(spark, path)
        known = spark.sparkContext.broadcast(_block_starts(lines.filter("length < size").mapInPandas(_passes, _BLOCKS)))
        rows = lines.mapInPandas(_parser(known, repo, graph), _PARTS)
        if not known.value:
            return rows.select(KEY).distinct()
        try:
            rows = stored(rows)
        except PythonException as e:  # cores came or went between the two passes
            if _MOVED not in str(e) or attempt == 2:
                raise
            continue
        parts = rows.filter("text is not null").groupBy("path", "line").applyInPandas(_whole(repo, graph), KEY_SCHEMA)
        return rows.filter("text is null").select(KEY).unionByName(parts).distinct()


def write(graph: DataFrame, path: str) -> None:
    """Quads as sorted Turtle statements, in as many files as the sort makes ranges; each declares the prefixes."""
    from loomgraph.operators.quads import serialised

    def of(batches):
        head = [f"@prefix {p}: <{u}> ." for p, u in PREFIXES.items()]
        for b in batches:
            if len(b):
                yield pd.DataFrame({"line": [*head, *b["line"]]})
                head = []

    serialised(graph).mapInPandas(of, "line string").write.mode("overwrite").text(path)

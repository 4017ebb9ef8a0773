"""The quad store: named graphs of a repository as rows (repo, graph, s, p, o, o_kind, o_type, o_lang).

A graph has set semantics. Mutations are functions from quads to quads; QuadTable commits them to files with a
log, so that a reader sees one version or the other."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.commits import Folder, Log

KEY = ["repo", "graph", "s", "p", "o", "o_kind", "o_type", "o_lang"]
SCHEMA = ", ".join(f"{c} string" for c in KEY)
DEFAULT = "default"

BASE = "urn:loomgraph:"
PREFIXES = {
    "": BASE,
    "geo": "urn:loomgraph:geonames:",
    "dc": "http://purl.org/dc/terms/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def graph_name(repo: str | None, graph: str | None = None) -> str:
    """The server's default graph, a repository's default graph, or a narrative's graph."""
    if not repo:
        return DEFAULT
    return f"{repo}_{graph or DEFAULT}"


def quads(df: DataFrame) -> DataFrame:
    """df with all quad columns, absent ones null."""
    return df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in KEY])


def triplify(df: DataFrame, subject: Column, repo: Column, graph: Column, **properties: tuple[Column, str]) -> DataFrame:
    """One quad for each non-null property of each row: name=(column, 'iri' or 'lit' or a literal type).

    One pass over df: rows are exploded in place, nothing is shuffled."""
    facts = [
        F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit("iri" if k == "iri" else "lit").alias("o_kind"), F.lit(None if k in ("iri", "lit") else k).cast("string").alias("o_type"))
        for p, (c, k) in properties.items()
    ]
    rows = df.select(repo.alias("repo"), graph.alias("graph"), subject.cast("string").alias("s"), F.explode(F.array(*facts)).alias("f"))
    return quads(rows.select("repo", "graph", "s", "f.*").filter("o is not null"))


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """Set union: what is there already is not added again."""
    return quads(store).unionByName(quads(new)).dropDuplicates(KEY)


def new_only(store: DataFrame, new: DataFrame) -> DataFrame:
    """The quads of new that an append would add."""
    return _minus(quads(new).dropDuplicates(KEY), store)


def _same() -> Column:
    """Rows of a and b are one quad."""
    out = F.lit(True)
    for c in KEY:
        out &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def _minus(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.alias("a").join(quads(right).alias("b"), _same(), "left_anti")


def removed(store: DataFrame, old: DataFrame) -> DataFrame:
    return _minus(quads(store), old)


def cleared(store: DataFrame, repo: str, graph: str) -> DataFrame:
    return store.filter(~((F.col("repo") == repo) & (F.col("graph") == graph)))


def checked(repo: str, graph: str, new: DataFrame) -> DataFrame:
    """Quads as a graph's content; invalid ones are refused."""
    new = quads(new).withColumn("repo", F.lit(repo)).withColumn("graph", F.lit(graph))
    bad = new.filter("s is null or p is null or o is null or o_kind not in ('iri', 'lit', 'bnode')")
    if not bad.isEmpty():
        raise ValueError("Invalid triples")
    return new.dropDuplicates(KEY)


def replaced(store: DataFrame, repo: str, graph: str, new: DataFrame) -> DataFrame:
    """A graph's new content in one step; invalid quads are refused before anything changes."""
    return cleared(store, repo, graph).unionByName(checked(repo, graph, new))


def subjects(store: DataFrame, **pattern: str) -> DataFrame:
    """Subjects with all of the given predicate=object pairs, e.g. **{'rdf:type': ':Person'}.

    One scan and one partial aggregation instead of a self-join a pattern."""
    checks = [F.max(((F.col("p") == p) & (F.col("o") == o)).cast("int")) for p, o in pattern.items()]
    got = store.groupBy("repo", "graph", "s").agg(*[c.alias(f"c{k}") for k, c in enumerate(checks)])
    for k in range(len(checks)):
        got = got.filter(f"c{k} = 1")
    return got.select("repo", "graph", "s")


def without_subjects(store: DataFrame, gone: DataFrame) -> DataFrame:
    """All triples of the given (repo, graph, s) deleted."""
    return store.join(gone, ["repo", "graph", "s"], "left_anti").select(KEY)


def without_narrative(store: DataFrame, narrative: str) -> DataFrame:
    """A narrative's two metadata subjects deleted, if both are there."""
    both = [f":{narrative}", f":Narrative_{narrative}"]
    there = store.filter(F.col("s").isin(both)).groupBy("repo", "graph").agg(F.countDistinct("s").alias("n")).filter("n = 2")
    return store.join(there.withColumn("hit", F.lit(True)), ["repo", "graph"], "left").filter(~(F.coalesce("hit", F.lit(False)) & F.col("s").isin(both))).select(KEY)


def star(store: DataFrame, **columns: str) -> DataFrame:
    """Subjects that have all predicates, one row each: a star pattern without self-joins.

    column=predicate; where a predicate has several objects the least is taken."""
    wanted = store.filter(F.col("p").isin(list(columns.values())))
    got = wanted.groupBy("repo", "graph", "s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in columns.items()])
    return got.dropna(subset=list(columns))


def triple_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("graph").agg(F.count("*").alias("cnt"))


def repo_graphs(store: DataFrame, repo: str, exact: bool = True) -> DataFrame:
    """Graphs of a repository; exact=False matches any graph whose name contains the string."""
    hit = F.col("repo") == repo if exact else F.col("graph").contains(repo)
    return store.filter(hit).select("graph").distinct()


def escaped(text: Column) -> Column:
    """A literal's characters between double quotes, on one line."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def serialised(store: DataFrame) -> DataFrame:
    """One line a triple, in code point order: the order makes exports comparable."""
    mark = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_type").isNotNull(), F.concat(F.lit("^^"), F.col("o_type"))).otherwise("")
    o = F.when(F.col("o_kind").isin("iri", "bnode"), F.col("o")).otherwise(F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), mark))
    return store.select(F.concat_ws(" ", "s", "p", o, F.lit(".")).alias("line")).orderBy("line")


#: Prefixes that every export declares; others where a line uses them.
DECLARED = ["", "owl", "rdf", "rdfs", "xsd"]


def exported(store: DataFrame, repo: str, graph: str) -> list[str]:
    """Prefix lines, a blank line and the graph's lines, for one narrative's graph."""
    graph_ = store.filter((F.col("repo") == repo) & (F.col("graph") == graph))
    names = F.array_compact(F.array(*[F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", 1)) for c in ("s", "p", "o_type")], F.when(F.col("o_kind") == "iri", F.substring_index("o", ":", 1))))
    used = {r[0] for r in graph_.select(F.explode(names).alias("name")).filter(F.col("name").isin(list(PREFIXES))).distinct().collect()}
    head = [f"@prefix {p}: <{u}> ." for p, u in PREFIXES.items() if p in DECLARED or p in used]
    return [*head, "", *(r["line"] for r in serialised(graph_).toLocalIterator())]


class Conflict(Exception):
    """Other writers kept changing what a commit is about."""


@dataclass
class State:
    """What the commits up to a version say: folders of quads and of deletions, each with the version that it came with,
    and the last batch of each stream."""

    version: int = 0
    added: dict[str, int] = field(default_factory=dict)
    deleted: dict[str, int] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    base: int = 0
    old: list[str] = field(default_factory=list)

    def then(self, version: int, commit: dict) -> State:
        if commit.get("base"):
            return State(version, {commit["add"]: version} if commit["add"] else {}, {}, commit["streams"], version, commit["old"])
        added = self.added | ({commit["add"]: version} if commit["add"] else {})
        deleted = self.deleted | ({commit["delete"]: version} if commit["delete"] else {})
        return State(version, added, deleted, self.streams | commit["streams"], self.base, self.old)


class QuadTable:
    """Quads as Parquet, one folder a repository, in it one a commit, and a log of the commits.

    A commit adds a folder of quads, and one of deletions where it has any: whole graphs and single quads, which
    hold for what older commits added and are merged on reading. So a change costs what it changes, a reader
    sees all of a commit or nothing, and what it read stays the same. Writers commit by number: one that finds
    its number taken looks at the commits between; if they touch its graphs it does its work again on what is
    there now. A commit of a stream carries its batch, which is never applied twice."""

    #: Folders after which the live quads are written anew, as one; attempts of a commit; graphs that a commit names.
    MANY, ATTEMPTS, NAMED = 64, 20, 1000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Folder(spark, self.path)

    @staticmethod
    def _folder(repo: str) -> str:
        return "repo-" + repo.encode().hex()

    def repositories(self) -> list[str]:
        return [bytes.fromhex(x[5:]).decode() for x in self.files.names() if x.startswith("repo-")]

    def _log(self, repo: str) -> Log:
        return Log(self.files, self._folder(repo), "log")

    def state(self, repo: str) -> State:
        out = State()
        for n, commit in self._log(repo).entries():
            out = out.then(n, commit)
        return out

    def _rows(self, repo: str, folders: dict[str, int]) -> DataFrame:
        """The folders' quads, each with the version that it came with."""
        base = f"{self.path}/{self._folder(repo)}/data"
        rows = self.spark.read.schema(f"{SCHEMA}, w string").option("basePath", base).parquet(*[f"{base}/w={w}" for w in folders])
        versions = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
        return rows.withColumn("version", versions[F.col("w")]).drop("w")

    def _live(self, repo: str, state: State, graphs: list[str] | None = None) -> DataFrame:
        """The quads of a state, of some graphs or all: sorted files let the scan leave others out."""
        if not state.added:
            return self.spark.createDataFrame([], SCHEMA)
        some = (lambda q: q) if graphs is None else lambda q: q.filter(F.col("graph").isin(graphs))
        rows = some(self._rows(repo, state.added))
        if state.deleted:
            gone = some(self._rows(repo, state.deleted))
            whole = gone.filter("s is null").groupBy(F.col("graph").alias("gone")).agg(F.max("version").alias("until"))
            rows = rows.join(whole, F.col("graph") == F.col("gone"), "left").filter("until is null or version >= until").drop("gone", "until")
            single = gone.filter("s is not null").groupBy(KEY).agg(F.max("version").alias("until"))
            rows = rows.alias("a").join(single.alias("b"), _same() & (F.col("a.version") < F.col("b.until")), "left_anti")
        return rows.select(KEY)

    def read(self, repo: str | None = None, graphs: list[str] | None = None) -> DataFrame:
        """All quads, or a repository's, or some of its graphs'."""
        if repo is not None:
            return self._live(repo, self.state(repo), graphs)
        parts = [self._live(r, self.state(r), graphs) for r in self.repositories()]
        out = parts[0] if parts else self.spark.createDataFrame([], SCHEMA)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _written(self, repo: str, rows: DataFrame) -> tuple[str | None, int, list[str] | None]:
        """A new folder with the rows (none where there are no rows), their number, their graphs (None: many)."""
        w = uuid.uuid4().hex
        place = f"{self.path}/{self._folder(repo)}/data/w={w}"
        rows.sortWithinPartitions("graph", "p", "s").write.parquet(place)
        there = self.spark.read.schema(SCHEMA).parquet(place)
        n = there.count()
        if not n:
            self._discard(repo, w)
            return None, 0, []
        names = [r["graph"] for r in there.select("graph").distinct().limit(self.NAMED + 1).collect()]
        return w, n, names if len(names) <= self.NAMED else None

    def _discard(self, repo: str, *folders: str | None) -> None:
        for w in folders:
            if w:
                self.files.delete(self._folder(repo), "data", f"w={w}")

    def commit(self, repo: str, add: Rows = None, delete: Rows = None, drop: Iterable[str] = (), graphs: list[str] | None = None, stream: tuple[str, int] | None = None) -> int:
        """One change of a repository: drops graphs, deletes quads, adds those that aren't there then; says how many
        quads it added. add and delete are quads, or functions from the repository's quads to them.

        graphs: all that the change is about, where the caller knows them; only these are read then. stream: a name and
        the number of its batch; a batch that is committed already is not committed again, and adds 0."""
        log, drop = self._log(repo), list(drop)
        for _ in range(self.ATTEMPTS):
            state = self.state(repo)
            if stream and state.streams.get(stream[0], -1) >= stream[1]:
                return 0
            live = self._live(repo, state, graphs)
            rows = lambda x: None if x is None else quads(x(live) if callable(x) else x).filter(F.col("repo") == repo)
            old, new = rows(delete), rows(add)
            dropped = self.spark.createDataFrame([(repo, g) for g in drop], "repo string, graph string")
            gone = quads(dropped) if old is None else quads(dropped).unionByName(old.dropDuplicates(KEY).filter("s is not null"))
            d, nd, touched = self._written(repo, gone) if drop or old is not None else (None, 0, [])
            a, na, more = None, 0, []
            if new is not None:
                left = live.filter(~F.col("graph").isin(drop)) if drop else live
                if d and old is not None:
                    left = _minus(left, self._rows(repo, {d: 0}).filter("s is not null").drop("version"))
                a, na, more = self._written(repo, new_only(left, new))
                if graphs is not None and (more is None or not set(more) <= set(graphs)):
                    self._discard(repo, a, d)
                    raise ValueError("quads of other graphs than the commit is about")
            if not a and not d and not stream:
                return 0
            touched = None if touched is None or more is None else sorted({*touched, *more, *drop, *(graphs or ())})
            entry = {"add": a, "delete": d, "graphs": touched, "streams": dict([stream]) if stream else {}}
            n = state.version + 1
            while not log.put(n, entry):
                other = log.get(n)
                if self._meet(entry, other):
                    break
                n += 1
            else:
                if n - state.base >= self.MANY:
                    self.compact(repo)
                return na
            self._discard(repo, a, d)
        raise Conflict(f"{repo}: {self.ATTEMPTS} attempts met other changes of the same graphs")

    @staticmethod
    def _meet(mine: dict, other: dict) -> bool:
        """Whether another commit changes what mine was made from. A new base changes nothing but where quads lie,
        and the deletions of mine hold for it, too."""
        if other.get("base"):
            return False
        if set(mine["streams"]) & set(other["streams"]) or mine["graphs"] is None or other["graphs"] is None:
            return True
        return bool(set(mine["graphs"]) & set(other["graphs"]))

    def compact(self, repo: str) -> bool:
        """The live quads as one folder, sorted by graph and subject, without deletions; False if others committed meanwhile.
        What the base before this one had replaced is deleted: those who read it have had a base's time."""
        state = self.state(repo)
        rows = self._live(repo, state).repartitionByRange("graph", "s")
        w, _, _ = self._written(repo, rows)
        if not self._log(repo).put(state.version + 1, {"base": True, "add": w, "streams": state.streams, "old": [*state.added, *state.deleted]}):
            self._discard(repo, w)
            return False
        self._discard(repo, *state.old)
        self._log(repo).forget(state.base)
        return True

    def add(self, repo: str, new: DataFrame) -> int:
        """Adds what isn't there, and says how many quads that was."""
        return self.commit(repo, add=new)

    def remove(self, repo: str, old: DataFrame) -> None:
        self.commit(repo, delete=old)

    def clear(self, repo: str, graph: str) -> None:
        self.commit(repo, drop=[graph], graphs=[graph])

    def replace(self, repo: str, graph: str, new: DataFrame) -> None:
        self.commit(repo, drop=[graph], add=checked(repo, graph, new), graphs=[graph])

    def apply(self, repo: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Any change of a repository, as what it takes away and what it adds."""
        self.commit(repo, add=lambda q: _minus(quads(change(q)), q), delete=lambda q: _minus(q, change(q)))

    def query(self, sql: str, repo: str | None = None, **args) -> DataFrame:
        """SQL over the quads as the table {quads}; values go in as named parameters (:name), never into the text."""
        return self.spark.sql(sql, args=args, quads=self.read(repo))

    def drop(self, repo: str) -> None:
        """All of a repository."""
        self.files.delete(self._folder(repo))


#: Quads, or a function from the quads that are there to them.
Rows = DataFrame | Callable[[DataFrame], DataFrame] | None

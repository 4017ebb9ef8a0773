"""Pack tokenised documents into as few sequences as possible by a linear grouping scheme.

The packing depends only on how many pieces there are of each length, a table of at most `capacity`
counts, so it is planned once, on run lengths, whatever the number of documents:

1. pieces over capacity / 8 are sorted and split into groups of equal cardinality, lengths are rounded
   up to the longest of their group;
2. for these few sizes the best sequence configurations are found by a linear programme with generated
   columns, and rounded down;
3. real lengths take the places of the rounded ones, in runs;
4. what is left and the short pieces go, longest first, where they fit best.

Pieces then find their place by their rank among the pieces of the same length."""

from __future__ import annotations

import array
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, table, written

CAPACITY, END_ID, GROUPS, RANK_SLOTS = 4096, 1, 24, 256
TOKENIZER = "word_bpe_49k.json"


class ChunkIds(dict):
    """White-space separated chunk -> its token ids as bytes, kept between calls.

    The tokenizer drops white space and never looks across it, so a text's ids are its chunks' ids in
    turn. Chunks of plain Latin letters, digits and marks are split here as the tokenizer's pattern
    splits them and only the model runs; any other chunk goes through the whole tokenizer."""

    LIMIT = 400_000
    PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.parts = Tokenizer.from_file(path), {}
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            if len(self.parts) > self.LIMIT:
                self.parts.clear()
            mapped = p if p.isascii() else self.level.pre_tokenize_str(p)[0][0]
            got = self.parts[p] = array.array("I", [t.id for t in self.tok.model.tokenize(mapped)]).tobytes()
        return got

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > self.LIMIT:
            self.clear()
        if "<|" not in chunk and self.PLAIN.fullmatch(chunk):
            got = b"".join(map(self.part, self.PARTS.findall(chunk.lower())))
        else:
            got = array.array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """Token ids of a whole text, little-endian unsigned 32-bit, with the end id."""
        flat = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, flat.split(" "))) + END_ID.to_bytes(4, "little")


_made: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    if path not in _made:
        _made[path] = ChunkIds(path)
    return _made[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens; only documents over the
    capacity are cut. A null text is an empty one: its single piece is the end id."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)

    def of(batches):
        ids = chunk_ids(path)
        for b in batches:
            doc, out = [], ([], [], [], [])
            for d, text in zip(b.column(0).to_pylist(), b.column(1)):
                buf = ids.ids(text.as_py())
                n = len(buf) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    e = min(n, s + capacity)
                    doc.append(d)
                    for to, x in zip(out, (k, s, e - s, zlib.crc32(buf[4 * s : 4 * e]))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(counts per size, times) for whole sequences: the linear programme's optimum, rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best, value = _fill(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        x, way = inverse @ demand, inverse @ best
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = best
    x = np.linalg.solve(basis, demand)
    left, found = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        column = np.rint(basis[:, j]).astype(np.int64)
        used = column > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            found.append((column, times))
            left -= column * times
    assert k == len(left) and (left >= 0).all()
    return found


def _fill(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The dearest set of sizes that fits, repeats allowed."""
    best, steps = np.zeros(capacity + 1), []
    for _ in range(int(capacity // sizes.min())):
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            s = int(s)
            with_g = best[: capacity + 1 - s] + price[g]
            better = with_g > more[s:] + 1e-12
            more[s:][better], pick[s:][better] = with_g[better], g
        if (pick < 0).all():
            break
        steps.append(pick)
        best = more
    counts, room = np.zeros(len(sizes)), capacity
    for pick in reversed(steps):
        g = pick[room]
        if g >= 0:
            counts[g] += 1
            room -= int(sizes[g])
    return counts, float(counts @ price)


class Plan:
    """Runs of equal sequences: how many, what they hold (length, times) and the room left."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, {}, 0

    def add(self, times: int, held, room: int) -> None:
        self.by_room.setdefault(room, []).append((times, held))
        self.rooms |= 1 << room

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of a length, each into the sequence with the least room that takes it."""
        while n:
            fit = self.rooms >> length
            if not fit:
                t = self.capacity // length
                if n >= t:
                    self.add(n // t, (None, length, t), self.capacity - t * length)
                if n % t:
                    self.add(1, (None, length, n % t), self.capacity - (n % t) * length)
                return
            room = length + (fit & -fit).bit_length() - 1
            times, held = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
            t = room // length
            whole = min(times, n // t)
            if whole:
                self.add(whole, (held, length, t), room - t * length)
                n, times = n - whole * t, times - whole
            if n and times:
                self.add(1, (held, length, n), room - n * length)
                n, times = 0, times - 1
            if times:
                self.add(times, held, room)

    def runs(self) -> dict[str, np.ndarray]:
        """For each length, in order of ranks: first rank, pieces a sequence, first sequence, offset."""
        rank, base, out = {}, 0, []
        for room in sorted(self.by_room):
            for times, held in self.by_room[room]:
                at, stack = 0, []
                while held is not None:
                    held, length, t = held
                    stack.append((length, t))
                for length, t in reversed(stack):
                    out.append((length, rank.get(length, 0), t, base, at))
                    rank[length] = rank.get(length, 0) + times * t
                    at += length * t
                base += times
        got = np.array(sorted(out), np.int64).reshape(-1, 5)
        return dict(zip(("length", "rank", "each", "sequence", "offset"), got.T))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """counts: pieces of each length. See the module's text."""
    left, p = {int(a): int(b) for a, b in counts.items() if b}, Plan(capacity)
    if capacity in left:
        p.add(left.pop(capacity), (None, capacity, 1), 0)
    large = sorted((x for x in left if x > capacity // 8), reverse=True)
    number = np.array([left[x] for x in large], np.int64)
    if number.sum() > groups:
        edge = np.unique(np.searchsorted(np.cumsum(number), number.sum() * np.arange(1, groups + 1) / groups, side="left"))
        member = np.searchsorted(edge, np.arange(len(large)), side="left")  # a length is never split between groups
        sizes = np.array([large[int(np.flatnonzero(member == g)[0])] for g in range(member.max() + 1)])
        demand = np.bincount(member, weights=number).astype(np.int64)
        queue = [[[x, left[x]] for x, m in zip(large, member) if m == g] for g in range(len(sizes))]
        for column, times in configurations(sizes, demand, capacity):
            slots = [g for g, c in enumerate(column) for _ in range(int(c))]
            runs = []
            for g in slots:  # each place of the configuration takes a run of real lengths
                need, run = times, []
                while need:
                    length, n = queue[g][0]
                    take = min(n, need)
                    run.append([length, take])
                    need -= take
                    left[length] -= take
                    queue[g][0][1] -= take
                    if not queue[g][0][1]:
                        queue[g].pop(0)
                runs.append(run)
            done = 0
            while done < times:
                n = min(r[0][1] for r in runs)
                held = None
                for r in runs:
                    held = (held, r[0][0], 1)
                p.add(n, held, capacity - sum(r[0][0] for r in runs))
                done += n
                for r in runs:
                    r[0][1] -= n
                    if not r[0][1]:
                        r.pop(0)
    for length in sorted(left, reverse=True):
        if left[length]:
            p.best_fit(length, left[length])
    return p.runs()


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with a length column, from 1 to the capacity) plus sequence_id and offset.

    Pieces of one length are told apart by doc_id, piece and ids_crc32; repeated rows have places of their own.
    No rows give no sequences. Ranks among the pieces of one length are counted over hash slots first, so a length that most
    pieces have is not one task. Only the counts of each length reach the driver."""
    cut = written(cut.withColumn("rslot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_SLOTS)).cast("int")), "pieces")
    slots = cut.groupBy("length", "rslot").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    ahead = Window.partitionBy("length").orderBy("rslot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    here = Window.partitionBy("length", "rslot").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(slots, ["length", "rslot"]).withColumn("rank", F.col("first") + F.row_number().over(here) - 1)
    names = [c for c in cut.columns if c != "rslot"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(names).schema) + ", sequence_id long, offset long"

    def of(batches):
        r = runs.value
        wide = np.int64(1) << 44
        keys = r["length"] * wide + r["rank"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            over = rank - r["rank"][at]
            sequence = r["sequence"][at] + over // r["each"][at]
            offset = r["offset"][at] + over % r["each"][at] * length
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(of, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents' pieces; see pieces() and packed()."""
    return packed(pieces(table(spark, sf_dir, "documents")))

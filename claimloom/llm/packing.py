"""Best-fit packing: documents as token ids in as few sequences of a fixed length as can be.

Lengths are whole numbers up to the capacity, so what has to be planned is a histogram of at
most that many entries, however many documents there are.  Linear grouping plans it: large
lengths are cut by rank into groups of equal cardinality (to within one length) and rounded up
to the largest of their group; the few sizes that remain are packed by the configuration program, whose columns
(patterns of sizes that fit a sequence) come from a knapsack table; patterns are taken a whole
number of times.  Then actual documents take the places of their group, and small ones, with
the few large ones that whole numbers leave, go by best fit, the longest first, into what is
left.  Equal sequences are held as runs, so no step takes time in proportion to documents.

Documents get their places by their rank in the order of length: a range shuffle numbers them
within parts, a small table of counts numbers the parts, and every document looks its rank up
in the plan's list of segments, whose length is bounded by lengths, groups and patterns.

Defined cases: a null or empty text is the end id alone; texts of any length are encoded
whole; only a document longer than a sequence is cut, into whole sequences but for its first
piece; null ids come first among pieces of a length; rows that repeat an id are packed each;
an empty table gives no piece; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from .common import drop_table, sized, sliced, write_table
from .token_store import load_tokenizer

#: The rules under which a text may be cut where blanks begin.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class SpacedEncoder(dict):
    """Ids of whole texts under a byte-level model, chunk by chunk where its rules allow it.

    The model's own words never go from a letter or mark into a blank, so a text may be cut
    where a run of blanks begins.  This maps chunks to their ids: as they stand for one with a
    blank before it, after a zero byte for one without, and from its line end on for one after
    a lone line end.  Two generations of at most ``most`` chunks are kept.  A text that may name
    a special token, and every text under another tokenizer, is encoded as it stands.
    """

    MARKS = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27)
    #: Blanks but space and line end, and the zero byte; in UTF-8 the rest begin like these.
    BLANKS = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\0"
    WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
    RUN = re.compile(r"(?<=\S)(?=\s)").split

    def __init__(self, tokenizer: str, kind: str, most: int = 500_000):
        super().__init__()
        self.tokenizer, self.code, self.most = load_tokenizer(tokenizer), "H" if kind == "<u2" else "I", most
        rules = json.loads(self.tokenizer.to_str())
        self.cut = rules["normalizer"] is None and rules["pre_tokenizer"] == _PRE_TOKENIZER and rules["truncation"] is None and rules["model"].get("dropout") is None and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.old: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in printable]
        self.letter = {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(rest)}
        self.line = self._whole("\n")

    def __missing__(self, chunk: bytes) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            ids = self._find(chunk)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _find(self, chunk: bytes) -> bytes:
        first = chunk[0]
        if chunk.isalpha():
            return self._word(self.letter[0x20] + chunk.decode())
        if first == 0x0A:
            return self.line + self[b"\0" + chunk[1:]]
        blank, bare = ("", chunk[1:]) if first == 0 else (self.letter[0x20], chunk)
        word = bare.rstrip(self.MARKS)
        if word.isalpha() or self.latin(word.decode()):
            if len(word) < len(bare):
                return self[chunk[: len(word) - len(bare)]] + self[b"\0" + bare[len(word) :]]
            return self._word(blank + (word.decode() if word.isascii() else "".join([self.letter[x] for x in word])))
        return self._whole((" " if blank else "") + bare.decode())

    def _word(self, form: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(form)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _odd(self, text: bytes) -> bool:
        return len(text.translate(None, self.BLANKS)) < len(text) or not text.isascii() and any(x in text for x in self.WIDE)

    def encode(self, text: bytes) -> bytes:
        """Ids, as unsigned integers of ``kind``, of a UTF-8 text."""
        if not self.cut or b"<|" in text:
            return self._whole(text.decode())
        chunks = text.replace(b"\n", b" \n").split(b" ")
        if b"" in chunks or b"\n" in chunks or self._odd(text):  # runs of blanks, or others than space and line end
            chunks = [c.encode() for c in self.RUN(text.decode())]
            chunks = [c[1:] if c[:1] == b" " and not c[1:].decode()[:1].isspace() and len(c) > 1 else b"\0" + c for c in chunks] if text else []
        else:
            chunks[0] = b"\0" + chunks[0] if chunks[0][:1] != b"\n" else chunks[0]
        return b"".join(map(self.__getitem__, chunks))


_encoders: dict[tuple[str, str], SpacedEncoder] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, *, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of each piece of each document."""
    kind = "<u2" if max(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"
    names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, kind) not in _encoders:
            _encoders[tokenizer, kind] = SpacedEncoder(tokenizer, kind)
        encode, end = _encoders[tokenizer, kind].encode, np.array([end_id], kind)
        for batch in sliced(batches):
            place, rows = [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = np.concatenate([np.frombuffer(encode(text or b""), kind), end]).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    place.append(i)
                    rows.append((piece, a, b - a, zlib.crc32(raw), raw)[: len(names) - 1])
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)] if rows else [pa.array([], t) for t in types[: len(names) - 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *columns], names)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([base.schema["id"]]).add("piece", IntegerType()).add("start", LongType()).add("length", LongType()).add("ids_crc32", LongType())
    return base.mapInArrow(run, schema.add("ids", BinaryType()) if with_ids else schema)


@dataclass
class Plan:
    """Segments of pieces in falling order of length, by first rank: ``per`` pieces go to each of a run of sequences."""

    ranks: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    sequences: int


class _Filling:
    """Runs of equal sequences by what they have left, and the pieces that have been given places."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.used = capacity, 0
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, bool)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.left = dict(counts)
        lengths = sorted(counts, reverse=True)
        self.next = dict(zip(lengths, np.cumsum([0, *(counts[x] for x in lengths)])[:-1].tolist(), strict=True))

    def new(self, count: int) -> tuple[int, int]:
        self.used += count
        return self.used - count, count

    def put(self, room: int, run: tuple[int, int]) -> None:
        if run[1]:
            self.runs[room].append(run)
            self.open[room] = True

    def give(self, length: int, per: int, room: int, first: int, count: int) -> None:
        """``per`` pieces of ``length`` to each of ``count`` sequences that have ``room`` left."""
        self.segments.append((self.next[length], per, first, self.capacity - room, length))
        self.next[length] += per * count
        self.left[length] -= per * count

    def best_fit(self, length: int) -> None:
        """All pieces of ``length`` that are left, each where it leaves the least room."""
        while (count := self.left[length]) > 0:
            fits = self.open[length:]
            room = length + int(fits.argmax())
            if not fits[room - length]:
                room = self.capacity
                self.put(room, self.new(-(-count // (room // length))))
            first, many = self.runs[room].pop()
            self.open[room] = bool(self.runs[room])
            per = min(room // length, count)
            take = min(many, count // per)
            self.give(length, per, room, first, take)
            self.put(room - per * length, (first, take))
            self.put(room, (first + take, many - take))


def _patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 3000) -> list[tuple[float, np.ndarray]]:
    """The configuration program by column generation: how often each pattern (counts by size) is used, in fractions.

    Columns come from a bounded knapsack table over the capacity; after ``most`` of them the
    solution is one that holds all pieces, but perhaps not the least.
    """
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(most):
        duals = inverse.sum(0)
        best = np.zeros(capacity + 1)
        taken = np.zeros((k, capacity + 1), np.int16)
        for j in range(k):
            if duals[j] <= 0:
                continue
            base = best
            best, size = base.copy(), int(sizes[j])
            for t in range(1, capacity // size + 1):
                value = base[: capacity + 1 - t * size] + t * duals[j]
                better = value > best[t * size :] + 1e-12
                best[t * size :][better] = value[better]
                taken[j, t * size :][better] = t
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for j in range(k - 1, -1, -1):
            column[j] = taken[j, room]
            room -= int(column[j]) * int(sizes[j])
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        row = int(ratio.argmin())
        x -= ratio[row] * step
        x[row] = ratio[row]
        np.maximum(x, 0, out=x)
        inverse[row] /= step[row]
        others = np.arange(k) != row
        inverse[others] -= np.outer(step[others], inverse[row])
        columns[:, row] = column
    return [(float(x[j]), columns[:, j].astype(int)) for j in range(k) if x[j] > 0]


def plan_packing(counts: dict[int, int], capacity: int = 2048, *, groups: int = 512, large: float = 0.45) -> Plan:
    """Places for ``counts`` pieces of each length; lengths over ``large`` x capacity are grouped."""
    fill = _Filling(counts, capacity)
    if counts.get(capacity):
        fill.give(capacity, 1, capacity, *fill.new(counts[capacity]))
    grouped = [x for x in sorted(counts, reverse=True) if large * capacity < x < capacity]
    if grouped:
        each = sum(counts[x] for x in grouped) / groups if len(grouped) > groups else 1
        members: dict[int, list[list[int]]] = {}  # by rounded size: [length, count] of each member length
        size, held = 0, 0
        for length in grouped:  # a group closes with the length that fills it, so copies of one length are never rounded up
            if not size or held >= each:
                size, held = length, 0
            members.setdefault(size, []).append([length, counts[length]])
            held += counts[length]
        sizes = np.array(list(members))
        demand = np.array([sum(n for _, n in members[s]) for s in members], float)
        for times, pattern in _patterns(sizes, demand, capacity):
            runs = [(capacity, *fill.new(int(times + 1e-9)))]
            if not runs[0][2]:
                continue
            for j in np.repeat(np.arange(len(sizes)), pattern):
                queue, after = members[int(sizes[j])], []
                for room, first, many in runs:
                    while many and queue:
                        length, there = queue[-1]
                        take = min(many, there)
                        fill.give(length, 1, room, first, take)
                        after.append((room - length, first, take))
                        first, many, queue[-1][1] = first + take, many - take, there - take
                        if take == there:
                            queue.pop()
                    if many:
                        after.append((room, first, many))
                runs = after
            for room, first, many in runs:
                fill.put(room, (first, many))
    for length in sorted(counts, reverse=True):
        fill.best_fit(length)
    table = np.array(sorted(fill.segments), np.int64).reshape(-1, 5)
    return Plan(*table.T, fill.used)


def _numbered(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with their part and place in falling order of length, and the first rank of each part; both written."""
    spark = pieces.sparkSession
    written, path = write_table(pieces, "pieces")  # a range shuffle reads its input twice: texts are encoded once
    order = [F.desc("length"), F.col("id").asc_nulls_first(), F.asc("piece"), F.asc("ids_crc32")]
    ordered = written.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "part", "place"])
            at += n

    schema = StructType(list(pieces.schema.fields)).add("part", IntegerType()).add("place", LongType())
    placed, _ = write_table(ordered.mapInArrow(number, schema), "placed-pieces")
    drop_table(spark, path)
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per part of the shuffle
    parts, parts_path = write_table(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "piece-parts")
    return placed, sized(parts, parts_path)


def pack(pieces: DataFrame, capacity: int = 2048, *, groups: int = 512, large: tuple[float, ...] = (0.4, 0.45, 0.49)) -> DataFrame:
    """``pieces`` (of ``cut_pieces``) with sequence_id and offset; of the plans with each share of ``large``, the one of fewest sequences."""
    placed, parts = _numbered(pieces)
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = min((plan_packing(counts, capacity, groups=groups, large=x) for x in large), key=lambda p: p.sequences)
    names = [c for c in placed.columns if c not in ("part", "place")]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(plan.ranks, rank, side="right") - 1
            nth, within = np.divmod(rank - plan.ranks[at], plan.per[at])
            columns = [pa.array(plan.sequence[at] + nth), pa.array(plan.offset[at] + within * plan.length[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, "sequence_id", "offset"])

    schema = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return placed.join(parts, "part").select(*names, (F.col("before") + F.col("place")).alias("rank")).mapInArrow(seat, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, *, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col)
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, put together from the pieces by their places; a sequence is bounded, so is a group."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))

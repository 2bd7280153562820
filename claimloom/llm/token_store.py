"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding.

Ids are counted over the whole table and replaced by their rank, so frequent ids take
one byte.  Each number takes 1 to 4 data bytes; the lengths, two bits each, four to a
byte, stand apart in control bytes.  A reader looks up the lengths of four numbers per
control byte in a table and gathers all numbers at once with numpy.

A file, or shard, is one binary value, little-endian:

    magic b"FRV1" | documents u32 | numbers u64 | data bytes u64 | n_tokens u32 per document
    | control bytes, ceil(numbers / 4) | data bytes

The rank table (ids by falling frequency, then id) is a table of its own beside the
shards: a folder holds ``shards`` and ``ranks``, and whoever has the folder can read it.
Shards are kept as rows (part, shard, payload) of a Parquet table, because that is what
every store that Spark can reach takes; documents stand in ascending id order over
(part, shard, position).

Defined cases: a null text is empty and has the end id only; texts of any length are
encoded whole, and a shard closes after the text that fills it; null ids come first; rows
that repeat an id stand together, ordered by their token ids, and each gets its own place;
tokens of equal frequency are ranked by id; an empty table gives no shard; further columns
of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, shared_root, sized, sliced, write_table

MAGIC = b"FRV1"
_CASE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HEAD = struct.Struct("<4sIQQ")
_CODES = np.arange(256, dtype=np.uint8)
#: Lengths of the four numbers under each control byte.
_LENGTHS = np.stack([((_CODES >> (2 * j)) & 3) + 1 for j in range(4)], axis=1).astype(np.uint8)


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    numbers = np.asarray(numbers, np.uint32)
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    padded = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    padded[: len(numbers)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    widest = int(size.max(initial=1))
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :widest]
    return control.tobytes(), raw[np.arange(widest) < size[:, None]].tobytes()


def decode_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(count, np.uint32)
    for j in range(int(size.max(initial=0))):
        out |= np.where(size > j, raw[np.minimum(start + j, len(raw) - 1)], 0).astype(np.uint32) << np.uint32(8 * j)
    return out


def pack_shard(documents: list[np.ndarray]) -> bytes:
    numbers = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    control, data = encode_numbers(numbers)
    counts = np.array([len(d) for d in documents], "<u4")
    return _HEAD.pack(MAGIC, len(documents), len(numbers), len(data)) + counts.tobytes() + control + data


def unpack_shard(payload: bytes) -> list[np.ndarray]:
    magic, docs, count, size = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = _HEAD.size
    counts = np.frombuffer(payload, "<u4", docs, at)
    at += 4 * docs
    quads = -(-count // 4)
    numbers = decode_numbers(payload[at : at + quads], payload[at + quads : at + quads + size], count)
    return np.split(numbers, np.cumsum(counts, dtype=np.int64)[:-1]) if docs else []


#: The normaliser and pre-tokenizer that the encoding of single words relies on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(tokenizer) -> bool:
    """Whether a text may be cut at blanks and its words be given to the model: only with the rules that are known to allow it."""
    rules = json.loads(tokenizer.to_str())
    special = all(t["content"].startswith("<|") and not t["normalized"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in rules["added_tokens"])
    return special and rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER and rules["truncation"] is None and rules["model"].get("dropout") is None


class ChunkEncoder(dict):
    """Encodes whole texts, word by word where the tokenizer's rules allow it.

    Texts are cut at ASCII blanks after A-Z are lower-cased.  This maps a chunk to its
    ids, so a frequent word is encoded once, and finds what is missing as it is asked
    for.  Two generations of at most ``most`` chunks are kept; what was not met since the
    last change of generations goes.  A text that may name a special token, and every text
    under a tokenizer with other rules (``by_words``), is encoded as it stands.
    """

    #: A pre-tokenizer cuts exactly between a word and these; an apostrophe may belong to either.
    MARKS = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27)

    def __init__(self, tokenizer: str, kind: str, most: int = 300_000):
        super().__init__()
        self.tokenizer, self.code, self.most = load_tokenizer(tokenizer), "H" if kind == "<u2" else "I", most
        self.old: dict[bytes, bytes] = {}
        self.model, self.cut = self.tokenizer.model, by_words(self.tokenizer)
        self.latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in printable]
        self.letter = {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(rest)}  # byte-level letters

    def __missing__(self, chunk: bytes) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            ids = self._find(chunk)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _find(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(self.MARKS)
        if word.isalpha():
            lower = word
        elif word and not word.isascii() and self.latin(text := word.decode()):
            lower = text.lower().encode()
        else:
            return self._whole(chunk.decode())
        if lower == chunk:
            return self._word(chunk)
        return self[lower] + (self[chunk[len(word) :]] if len(word) < len(chunk) else b"")

    def _word(self, key: bytes) -> bytes:
        """Ids of one lower-case word of Latin-1 letters, as normaliser and pre-tokenizer hand it to the model."""
        form = key.decode() if key.isascii() else "".join([self.letter[x] for x in key])
        return array(self.code, [t.id for t in self.model.tokenize(form)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as unsigned integers of ``kind``."""
        of = self.__getitem__
        return [b"".join(map(of, t.translate(_CASE).split())) if self.cut and b"<|" not in t else self._whole(t.decode()) for t in texts]


def load_tokenizer(name: str):
    """A tokenizer file: a path, or the name of one of the installed public vocabularies."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def _tokenize(tokenizer: str, end_id: int, kind: str):
    """(id, ids, null, null) of each row, and one row (null, null, token, n) of counts per batch."""
    end = np.array([end_id], kind).tobytes()
    types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, kind) not in _encoders:
            _encoders[tokenizer, kind] = ChunkEncoder(tokenizer, kind)
        for batch in sliced(batches):
            ids = [x + end for x in _encoders[tokenizer, kind].encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])]
            total = np.bincount(np.frombuffer(b"".join(ids), kind))
            there = np.flatnonzero(total)
            columns = [batch.column(0).to_pylist() + [None], ids + [None], [None] * len(ids) + [there.astype(np.int32)], [None] * len(ids) + [total[there]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "ids", "token", "n"])

    return run


_RANK = "rank int, token long"
_SHARD = "part int, shard int, tokens long, ids array<long>, payload binary"


def _shards(rank: np.ndarray, kind: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack_shard(held)], pa.binary())],
                ["part", "shard", "tokens", "ids", "payload"],
            )

        for batch in sliced(batches):
            for doc, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(rank[np.frombuffer(tokens, kind)])
                ids.append(doc)
                size += len(held[-1])
                if size >= most:
                    yield closed()
                    shard, held, ids, size = shard + 1, [], [], 0
        if held:
            yield closed()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 18) -> str:
    """Write shards, in ascending id order, and ranks to the new folder ``path``; return it.

    A shard closes once it holds ``shard_tokens`` ids.  Without a path the folder is one of
    the session's shared folder.
    """
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/token-files-{uuid.uuid4().hex}"
    kind = "<u2" if max(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens, tokens_path = write_table(base.mapInArrow(_tokenize(tokenizer, end_id, kind), "id long, ids binary, token array<int>, n array<long>"), "token-ids", "zstd")
    counted = tokens.where("token IS NOT NULL").select(F.inline(F.arrays_zip("token", "n"))).groupBy("token").agg(F.sum("n").alias("n"))
    by_rank = np.array([r[0] for r in counted.orderBy(F.desc("n"), "token").collect()], np.uint32)  # no longer than the vocabulary
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    first = F.col("id").asc_nulls_first()
    ordered = tokens.where("ids IS NOT NULL").select("id", "ids").repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), first).sortWithinPartitions(first, "ids")
    ordered.mapInArrow(_shards(rank, kind, shard_tokens), _SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    spark.createDataFrame([(r, int(t)) for r, t in enumerate(by_rank)], _RANK).coalesce(1).write.parquet(f"{path}/ranks")
    drop_table(spark, tokens_path)
    return path


def read_token_files(spark: SparkSession, path: str, per_document, schema: str) -> DataFrame:
    """(id, start, n_tokens, and what ``per_document`` makes of a document's ids) of each document, from the folder alone.

    ``per_document`` gets one array of ids and returns a value of the type ``schema``
    names, such as "ids_crc32 long".  ``start`` counts the ids of all documents before.
    """
    name, kind = schema.split()
    by_rank = np.array([r["token"] for r in spark.read.schema(_RANK).parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)  # no longer than the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for part, shard, ids, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                documents = [by_rank[x] for x in unpack_shard(payload)]
                n = np.array([len(x) for x in documents], np.int64)
                columns = [[part] * len(n), [shard] * len(n), ids, np.cumsum(n) - n, n]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [pa.array([per_document(x) for x in documents])]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "shard", "id", "inner", "n_tokens", name])

    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    within = Window.partitionBy("part").orderBy("shard")
    place = shards.select("part", "shard", (F.sum("tokens").over(within) - F.col("tokens")).alias("before"))
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("all"))  # one row per range of ids
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    place, place_path = write_table(place.join(parts, "part"), "shard-places")
    read = shards.select("part", "shard", "ids", "payload").mapInArrow(run, f"part int, shard int, id long, inner long, n_tokens long, {name} {kind}")
    return read.join(sized(place, place_path), ["part", "shard"]).select("id", (F.col("base") + F.col("before") + F.col("inner")).alias("start"), "n_tokens", name)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

r"""MinHash near-duplicates with tensored banding, links confirmed on full shingle sets.

Two small collections of ``tables`` hashes each are computed, every hash a tuple of
``rows`` minima.  A table key joins one hash of the first collection with one of the
second, so 2 * tables * rows minima serve tables * tables keys of 2 * rows minima each.
At a similarity of 0.85 a pair misses all 144 keys with probability about
2 * (1 - 0.85 ** 3) ** 12, which is 2e-5.  Two texts are candidates if they share a key.

1. Texts with equal shingle sets form one class; only classes go on.
2. Keys are formed of the hashes that several classes have, since others make no bucket.
3. Each bucket is represented by its smallest class.  Every class is compared with the
   representatives that it meets most, which is linear work; links that hold on the full
   sets are joined to components.
4. In buckets that still hold several components, candidates of different components are
   compared: by a prefix filter, which is exact (of two similar sets, both have one of
   their rarest shingles in common), then by sketches, then on the full sets.  So a large
   bucket of texts just below the threshold does not give all its pairs.
5. Components come from smallest-label passing with pointer jumping.

Of two similar texts the sketches, 256 one-byte minima, agree in so few places as to be
left out with a probability of 3e-7 (five standard deviations).

Words are runs of ``[^\x20\x09-\x0D]`` after A-Z are lower-cased; a set holds the
distinct five-word shingles, or the whole sequence where there are fewer words.

Defined cases: a null or blank text has an empty set and is linked with nothing; texts of
any length are read whole and their sets, compared in full, grow with them; a row with a
null id is linked with nothing (component_id null, kept); rows that repeat an id are each
answered by their own text; of equal texts the smallest id represents all; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, drop_table, sized, sliced, write_table

UP, DOWN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_CASE = bytes.maketrans(UP, DOWN)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    words = text.translate(_CASE).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for j in range(span):
        out = _mixed(out * _STEP + hashed[j : j + len(out)])
    return np.unique(out)


def _multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def signature(shingles: np.ndarray, tables: int, rows: int, seed: int) -> np.ndarray:
    """2 * tables hashes, each of ``rows`` minima."""
    a, b = _multipliers(2 * tables * rows, seed)
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        low = np.minimum(low, (np.multiply.outer(a, shingles[start : start + 4096]) + b[:, None]).min(axis=1))
    low = low.reshape(2 * tables, rows)
    out = np.zeros(2 * tables, np.uint64)
    for j in range(rows):
        out = _mixed(out * _STEP + low[:, j])
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """Of each of 256 ranges of hash values, eight bits of the smallest hash in it; 0 where it is empty."""
    out = np.zeros(256, np.uint8)
    if len(shingles):
        place = (shingles >> np.uint64(56)).astype(np.intp)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        out[place[first]] = (shingles[first] >> np.uint64(24)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _may_link(percent: int):
    """Pairs whose sketches agree as often as the threshold lets expect, less five standard deviations."""
    j = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (2, 3))
            filled = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
            alike = ((a == b) & (a > 0)).sum(axis=1) / filled
            yield batch.select([0, 1]).filter(pa.array(alike >= j - 5 * np.sqrt(j * (1 - j) / filled)))

    return run


def _signatures(tables: int, rows: int, seed: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ns, s1, s2, sigs, sketches = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = shingle_set(text, width)
                ns.append(len(own))
                s1.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                s2.append(int(np.bitwise_xor.reduce(_mixed(own * _STEP)).view(np.int64)) if len(own) else 0)
                sigs.append(signature(own, tables, rows, seed).view(np.int64) if len(own) else None)
                sketches.append(sketch(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "n", "s1", "s2", "sig", "sketch"]
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t, width).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cid", "items"])

    return run


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, label), and where it is written: the smallest node reachable over ``links`` (u, v); nodes without links are absent."""
    both, path = write_table(links.select("u", "v").union(links.select("v", "u")).distinct(), "links")
    labels, old = write_table(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("low"))
        hop = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        hop, hop_path = write_table(hop, "hop")
        there = hop.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        jumped = hop.join(there, hop["label"] == there["at"], "left").select("node", "was", F.least("label", "jump").alias("label"))
        new, new_path = write_table(jumped, "labels")
        drop_table(links.sparkSession, hop_path)
        drop_table(links.sparkSession, old)
        labels, old = new.select("node", "label"), new_path
        if not new.where(F.col("label") != F.col("was")).limit(1).count():
            drop_table(links.sparkSession, path)
            return labels, old


def link_near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    width: int = 5,
    tables: int = 12,
    rows: int = 3,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest linked id), kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows_of, _ = write_table(base.mapInArrow(_signatures(tables, rows, seed, width), "id long, n long, s1 long, s2 long, sig array<long>, sketch binary"), "signatures")
    classes = rows_of.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("n", "s1", "s2").agg(F.min("id").alias("cid"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes, path = write_table(classes, "classes")  # with signatures: never broadcast
    scratch.paths.append(path)

    keys = _keys(classes, tables, scratch)
    links = _confirm(_star(keys, percent, scratch), classes, base, percent, width, tables, scratch)
    labels, labels_path = components(links)
    more = _confirm(_cross_pairs(keys, labels, base, percent, width, scratch), classes, base, percent, width, tables, scratch)
    if more.limit(1).count():
        drop_table(spark, labels_path)
        labels, labels_path = components(links.unionByName(more))

    reached = classes.join(labels, classes["cid"] == labels["node"], "left").select("n", "s1", "s2", F.coalesce("label", "cid").alias("component"))
    reached, path = write_table(reached, "reached")
    scratch.drop()
    drop_table(spark, labels_path)
    linked = rows_of.where(F.col("id").isNotNull()).select("id", "n", "s1", "s2").join(sized(reached, path), ["n", "s1", "s2"], "left")
    linked = linked.select("id", "n", F.coalesce("component", "id").alias("component"))
    alone = rows_of.where(F.col("id").isNull()).select("id", "n", F.lit(None).cast("long").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def _close(n, m, percent: int):
    """Sizes that allow the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _keys(classes: DataFrame, tables: int, scratch: Scratch) -> DataFrame:
    """(key, cid, n): the tensored keys that several classes have."""
    each = classes.select("cid", "n", F.posexplode("sig").alias("at", "val"))
    often = scratch.write(each.groupBy("at", "val").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("at", "val"), "hashes")
    mine = each.join(often, ["at", "val"]).groupBy("cid", "n").agg(F.collect_list(F.struct("at", "val")).alias("hs"))
    first, second = F.filter("hs", lambda h: h["at"] < tables), F.filter("hs", lambda h: h["at"] >= tables)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["at"], x["val"], y["at"], y["val"]))))
    return scratch.write(mine.select("cid", "n", F.explode(keys).alias("key")), "keys")


def _star(keys: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): each class v with the representatives u of its buckets, those that it meets in a quarter as many as in the most."""
    heads = keys.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("key", "head")
    met = keys.join(scratch.write(heads, "heads"), "key").where((F.col("cid") != F.col("head.cid")) & _close(F.col("n"), F.col("head.n"), percent))
    met = met.groupBy(F.col("cid").alias("v"), F.col("head.cid").alias("u")).agg(F.count(F.lit(1)).alias("c"))
    of = met.groupBy("v").agg(F.collect_list(F.struct("u", "c")).alias("us"), F.max("c").alias("top"))  # no more than a class has keys
    return of.select("v", "top", F.inline("us")).where(F.col("c") * 4 >= F.col("top")).select("u", "v")


def _cross_pairs(keys: DataFrame, labels: DataFrame, base: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """(u, v): pairs of different components, of classes in buckets where components meet, that pass the prefix filter.

    Shingles are ordered by the number of these classes that have them, counted exactly.
    A shingle of one class only stands first and makes no pair.
    """
    placed = scratch.write(keys.join(labels, keys["cid"] == labels["node"], "left").select("key", "cid", "n", F.coalesce("label", "cid").alias("comp")), "placed")
    mixed = scratch.write(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("key"), "mixed")
    members = scratch.write(placed.join(mixed, "key").select("cid", "comp", "n").distinct(), "members")
    sets = scratch.write(_full_sets(base, members.select("cid"), width), "member-sets")
    each = sets.select("cid", F.explode("items").alias("item"))
    counted = each.groupBy("item").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1)
    mine = each.join(counted, "item").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("holders", "item"))).alias("shared"))
    # the shingles that no other member has come before the first of these
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = mine.join(members, "cid").select("cid", "comp", "n", (F.col("n") - F.size("shared")).alias("before"), "shared")
    ranked = ranked.where(F.col("before") < prefix).select("cid", "comp", "n", "before", F.posexplode(F.slice("shared", F.lit(1), (prefix - F.col("before")).cast("int"))).alias("at", "s"))
    items, path = write_table(ranked.select("cid", "comp", "n", F.col("s.item").alias("item"), (F.col("before") + F.col("at") + 1).alias("place")), "prefixes")
    scratch.paths.append(path)
    other = items.select(F.col("item").alias("there"), F.col("cid").alias("x"), F.col("n").alias("x_n"), F.col("comp").alias("x_comp"), F.col("place").alias("x_place"))
    # of n and m shingles, at least need are common; the rarest n - need + 1 and m - need + 1 then share one
    need = F.ceil((F.col("n") + F.col("x_n")) * percent / (100 + percent))
    in_both = (F.col("place") <= F.col("n") - need + 1) & (F.col("x_place") <= F.col("x_n") - need + 1)
    apart = (F.col("cid") < F.col("x")) & (F.col("comp") != F.col("x_comp")) & _close(F.col("n"), F.col("x_n"), percent)
    pairs = items.join(other, (F.col("item") == F.col("there")) & apart & in_both)
    return pairs.select(F.col("cid").alias("u"), F.col("x").alias("v"))


def _full_sets(base: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, items) of the classes in ``wanted``."""
    texts = base.join(wanted, base["id"] == wanted["cid"], "left_semi").select("id", "text")
    return texts.mapInArrow(_sets(width), "cid long, items array<long>")


def _beside(pairs: DataFrame, rows: DataFrame, crowd: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with the columns of ``rows`` (u, ...); a u of many pairs is dealt over several salts."""
    dealt = pairs.join(crowd, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1)))).drop("salts")
    spread = rows.join(crowd, "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(spread, ["u", "salt"]).drop("salt")


def _confirm(pairs: DataFrame, classes: DataFrame, base: DataFrame, percent: int, width: int, tables: int, scratch: Scratch, per_salt: int = 500) -> DataFrame:
    """The pairs that share a table key and whose full sets are similar enough; those whose sketches differ too much go first."""
    left = classes.select(F.col("cid").alias("u"), F.col("sig").alias("a_sig"), F.col("sketch").alias("a"))
    right = classes.select(F.col("cid").alias("v"), F.col("sig").alias("b_sig"), F.col("sketch").alias("b"))
    same = F.zip_with("a_sig", "b_sig", lambda x, y: x == y)
    bucket = F.exists(F.slice(same, 1, tables), lambda x: x) & F.exists(F.slice(same, tables + 1, tables), lambda x: x)
    pairs, path = write_table(pairs.distinct(), "pairs")
    scratch.paths.append(path)
    crowd = lambda p: scratch.write(p.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_salt).select("u", F.ceil(F.col("n") / per_salt).cast("long").alias("salts")), "crowds")
    tried = _beside(pairs.join(right, "v"), left, crowd(pairs)).where(bucket).select("u", "v", "a", "b").mapInArrow(_may_link(percent), "u long, v long")
    tried, path = write_table(tried, "tried")
    scratch.paths.append(path)
    wanted = scratch.write(tried.select(F.col("u").alias("cid")).union(tried.select("v")).distinct(), "wanted")
    sets, path = write_table(_full_sets(base, wanted, width), "sets")
    scratch.paths.append(path)
    # rows that repeat an id give its set again: once is enough
    a, b = sets.select(F.col("cid").alias("u"), F.col("items").alias("a")), sets.select(F.col("cid").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    held = _beside(tried.join(b, "v"), a, crowd(tried)).where(both * 100 >= (F.size("a") + F.size("b") - both) * percent)
    return scratch.write(held.select("u", "v").distinct(), "links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns.

    Rows that repeat an id stay or go together.
    """
    id_col = options.get("id_col", "doc_id")
    gone = link_near_duplicates(docs, **options).where(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct()
    gone, path = write_table(gone, "near-duplicates")
    return docs.join(sized(gone, path), docs[id_col] == gone["gone"], "left_anti")

r"""Benchmark decontamination by winnowing, with DataFrame operations only.

A window is ``span`` consecutive words of a benchmark item (an item with fewer words,
but not none, is one window).  Of documents and items alike the minimum k-gram hash of
every run of ``span - k + 1`` k-grams is kept, so every span of ``span`` shared words has
the same minimum on both sides and meets in at least one fingerprint.  Documents that meet
are read again: the windows around each met k-gram are compared in full, word for word.

Each word is hashed once.  Pieces of a text are turned into one row per window, with the
hashes of its words side by side, so that k-grams, minima and the question whether a
minimum is new are plain columns of generated code.  Windows of short items are winnowed
in the same rows, under hashes of their own: documents are read twice whatever the lengths
of the items, once for fingerprints and once, those that met, for the comparison.

Words are the runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased.

Defined cases: a null text has no words; an item without words has no window; texts of any
length are read whole, in pieces of 4096 words that overlap; equal minima of a run are one fingerprint; repeated
rows are each answered; rows with a null id are answered like others; an empty benchmark
leaves every document clean; further columns of either table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, sized, write_table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


_PIECE = 4096


def _own(length: int, span: int) -> int:
    """What the hashes of windows of this length are mixed with."""
    return 0 if length == span else 0x9E3779B97F4A7C15 * length % (1 << 63)


def _k(length: int) -> int:
    return max((length + 1) // 2, length - 5)


def _gram(words_: list[Column], length: int, span: int) -> Column:
    return F.xxhash64(F.lit(_own(length, span)), *words_)


def fingerprints(df: DataFrame, lengths: list[int], span: int) -> DataFrame:
    """Rows of ``df``, but for ``toks``, with ``anchor`` and ``h``: one row with ``anchor`` 1 for each row of ``df``, and one per winnowed hash.

    ``h`` is null in a row that is there as an anchor only.
    """
    keep = [c for c in df.columns if c != "toks"]
    width = max(lengths)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)), F.lit(_PIECE)), lambda c: F.transform(F.slice("toks", c + 1, F.lit(_PIECE + width - 1)), lambda w: F.xxhash64(w)))
    df = df.select(*keep, F.posexplode(pieces).alias("piece", "w"))
    shifted = [F.concat(F.array(F.lit(None).cast("long")), "w").alias("w0")]  # the word before
    shifted += [F.slice("w", F.lit(j), F.greatest(F.size("w") - (j - 1), F.lit(0))).alias(f"w{j}") for j in range(1, width + 1)]
    df = df.select(*keep, "piece", *shifted)
    df = df.select(*keep, "piece", F.posexplode(F.arrays_zip(*[f"w{j}" for j in range(width + 1)])).alias("at", "z")).select(*keep, "piece", "at", "z.*")
    first = (F.col("piece") == 0) & (F.col("at") == 0)
    hashes = []
    for n in lengths:
        k = _k(n)
        grams = [_gram([F.col(f"w{i + j}") for j in range(k)], n, span) for i in range(n - k + 2)]
        low = F.least(*grams[1:]) if len(grams) > 2 else grams[1]
        before = F.least(*grams[:-1]) if len(grams) > 2 else grams[0]
        hashes.append(F.when(F.col(f"w{n}").isNotNull() & ((F.col("at") == 0) | (low != before)), low))
    df = df.select(*keep, first.alias("first"), *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    if len(lengths) == 1:
        return df.select(*keep, F.col("first").cast("int").alias("anchor"), F.col("h0").alias("h")).where("anchor = 1 OR h IS NOT NULL")
    df = df.select(*keep, "first", F.posexplode(F.array(*[f"h{i}" for i in range(len(lengths))])).alias("which", "h"))
    return df.select(*keep, (F.col("first") & (F.col("which") == 0)).cast("int").alias("anchor"), "h").where("anchor = 1 OR h IS NOT NULL")


def find_benchmark_spans(docs: DataFrame, benchmark: DataFrame, *, span: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted array of string), contaminated."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    tokens = base.select("id", "th", words(F.col("text")).alias("toks"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col).cast("string")).alias("toks"))
    items = scratch.write(items.where(F.size("toks") > 0), "benchmark-words")
    shorts = sorted(r[0] for r in items.where(F.size("toks") < span).select(F.size("toks")).distinct().collect())  # fewer than span values
    lengths = [span, *shorts]

    prints = []
    for n in lengths:  # an item is known by windows of its own length, or of the span
        own = items.where(F.size("toks") >= span) if n == span else items.where(F.size("toks") == n)
        prints.append(fingerprints(own, [n], span).select("h").where("h IS NOT NULL"))
    prints = scratch.write(reduce(DataFrame.unionByName, prints).distinct(), "prints")
    tokens = tokens.withColumn("n_words", F.size("toks").cast("long"))
    drawn = fingerprints(tokens, lengths, span).join(prints.withColumn("met", F.lit(True)), "h", "left").where("anchor = 1 OR met")
    drawn = drawn.groupBy("id", "th", "n_words").agg(F.sum("anchor").alias("copies"), F.collect_set(F.when(F.col("met"), F.col("h"))).alias("seeds"))
    drawn, _ = write_table(drawn, "fingerprints")
    met = scratch.write(drawn.where(F.size("seeds") > 0).select(F.col("id").alias("m_id"), F.col("th").alias("m_th"), "seeds"), "met")

    again = base.join(met, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).select("id", "th", "seeds", words(F.col("text")).alias("toks"))
    again = again.withColumn("h", F.transform("toks", lambda w: F.xxhash64(w)))
    windows = scratch.write(_windows(items, span), "windows")
    tried = F.array_distinct(F.concat(*[_around(n, span) for n in lengths]))
    tried = F.transform(tried, lambda w: F.struct(w["at"].alias("at"), w["len"].alias("len"), F.array_join(F.slice("toks", w["at"], w["len"]), " ").alias("window")))
    tried = again.select("id", "th", F.inline(tried))
    hits = tried.join(scratch.write(windows.select("window").distinct(), "window-texts"), "window").select("id", "th", "at", "len", "window")
    hits, path = write_table(hits, "hits")
    scratch.paths.append(path)

    covered = hits.groupBy("id", "th").agg(F.collect_set(F.struct("at", "len")).alias("spans"))
    covered = covered.select("id", "th", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))).alias("n_hit"))
    found = hits.select("id", "th", "window").distinct().join(windows, "window").groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    answer = covered.join(found, (covered["id"].eqNullSafe(found["id"])) & (covered["th"] == found["th"])).select(covered["id"].alias("r_id"), covered["th"].alias("r_th"), "n_hit", "items")
    answer, path = write_table(answer, "answer")
    scratch.drop()
    return drawn.select("id", "th", "n_words", F.explode(F.sequence(F.lit(1), F.col("copies")))).join(sized(answer, path), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _around(length: int, span: int) -> Column:
    """(at, len) of the windows around each k-gram that was met, as far as they lie in the text."""
    k, whole = _k(length), F.size("toks") >= length
    gram = lambda i: _gram([F.element_at("h", i + j) for j in range(k)], length, span)
    at = F.filter(F.sequence(F.lit(1), F.size("toks") - (k - 1)), lambda i: F.array_contains(F.col("seeds"), gram(i)))
    first = lambda i: F.greatest(i - (length - k), F.lit(1))
    last = lambda i: F.least(i, F.size("toks") - (length - 1))
    starts = F.flatten(F.transform(at, lambda i: F.sequence(first(i), last(i))))
    return F.when(whole, F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len")))).otherwise(F.array().cast("array<struct<at: int, len: int>>"))


def _windows(items: DataFrame, span: int) -> DataFrame:
    """(window, item): the words of each window, joined by a space."""
    toks = F.col("toks")
    length = F.least(F.size(toks), F.lit(span))
    each = F.transform(F.sequence(F.lit(1), F.size(toks) - length + 1), lambda i: F.array_join(F.slice(toks, i, length), " "))
    return items.select("item", F.explode(each).alias("window")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = find_benchmark_spans(docs, benchmark, **options).where("contaminated").select(F.col(id_col).alias("bad")).distinct()
    bad, path = write_table(bad, "contaminated")
    # a row goes when its id does: repeated rows share their fate, and texts that differ under one id go together
    return docs.join(sized(bad, path), docs[id_col].eqNullSafe(bad["bad"]), "left_anti").select(*[docs[c] for c in docs.columns])

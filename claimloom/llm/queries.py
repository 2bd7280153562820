"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder
from .decontaminate import find_benchmark_spans
from .jpeg import read_digests, store_texts
from .langid import fit_languages, identify_languages
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dedup import link_near_duplicates
from .packing import pack_documents
from .phrases import mine_phrases
from .pii import pseudonymize
from .quality import fit_quality, score_quality
from .token_store import ids_crc32, read_token_files, write_token_files
from .toxicity import fit_toxicity, score_toxicity
from .whitening import fit_whitening, whitened_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(_table(spark, sf_dir, "documents"), b"registered query")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(_table(spark, sf_dir, "documents"))


def _verdicts(scored: DataFrame, threshold: float, *more: str) -> DataFrame:
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _verdicts(score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels"))), 0.3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _verdicts(score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels"))), 0.5, "passages")


#: The mixture that op5 asks for: shares of tokens by language and by form; sources are damped.
LANG_TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}
FORM_TARGETS = {"prose": 0.75, "notes": 0.15, "table": 0.04, "shout": 0.03, "short": 0.03}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), lang_targets=LANG_TARGETS, topic_targets=FORM_TARGETS)


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(store_texts(_table(spark, sf_dir, "documents")))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"))


def token_files(docs: DataFrame) -> DataFrame:
    path = write_token_files(docs, "word_bpe_49k.json")
    return read_token_files(docs.sparkSession, path, ids_crc32, "ids_crc32 long").withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", with_ids=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return whitened_rows(rows, fit_whitening(rows))


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS t FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS t FROM benchmark),
b1 AS (SELECT item, t, least(10, len(t)) AS n FROM b WHERE len(t) > 0),
b2 AS (SELECT item, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM b1),
win AS (SELECT DISTINCT item, n, array_to_string(t[i : i + n - 1], ' ') AS w FROM b2),
ns AS (SELECT DISTINCT n FROM win),
d1 AS (SELECT rid, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, ns WHERE len(t) >= n),
d2 AS (SELECT rid, n, i, array_to_string(t[i : i + n - 1], ' ') AS w FROM d1),
hit AS (SELECT DISTINCT rid, n, i, item FROM d2 JOIN win USING (n, w)),
pos AS (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM hit)),
cover AS (SELECT rid, count(*) AS n_hit FROM pos GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN found USING (rid)
"""

_OP10 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
rep AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(doc_id <> last_id, FALSE) AS gone FROM k LEFT JOIN rep USING (key))
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

_OP3 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT rid, least(5, len(t)) AS n, t, unnest(range(1, len(t) - least(5, len(t)) + 2)) AS i FROM d WHERE len(t) > 0),
s AS (SELECT DISTINCT rid, array_to_string(t[i : i + n - 1], ' ') AS w FROM g),
c AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b USING (w) WHERE a.rid <> b.rid GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN c cx ON cx.rid = x JOIN c cy ON cy.rid = y WHERE 100 * k >= 85 * (cx.n + cy.n - k)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN c USING (rid) JOIN m USING (rid)
""".replace("WITH d", "WITH RECURSIVE d", 1)


_OP11 = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
t AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
tot AS (SELECT lang, sum(len(w)) AS n FROM t GROUP BY lang),
o AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM t, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
g AS (SELECT lang, m, w[i : i + m - 1] AS ws, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, u AS ws, max(f) AS longer FROM (SELECT lang, f, unnest([ws[1:2], ws[2:3]]) AS u FROM g WHERE m = 3) GROUP BY ALL),
c AS (SELECT g.* FROM g LEFT JOIN inside USING (lang, ws) WHERE m >= 2 AND (longer IS NULL OR 100 * longer < 50 * f)),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.ws, k.f AS a, k.k, x.f AS l, y.f AS r,
      CAST(1000000 AS HUGEINT) * k.f * k.f // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM k JOIN g x ON x.lang = k.lang AND x.ws = k.ws[1 : k.k] JOIN g y ON y.lang = k.lang AND y.ws = k.ws[k.k + 1 : k.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM b),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM f QUALIFY rank <= 2000)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM z JOIN tot USING (lang)
"""


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_decontaminate": op2_decontaminate,
        "op3_near_dedup": op3_near_dedup,
        "op4_quality": op4_quality,
        "op5_mixing": op5_mixing,
        "op6_toxicity": op6_toxicity,
        "op7_jpeg": op7_jpeg,
        "op8_token_store": op8_token_store,
        "op9_langid": op9_langid,
        "op10_line_dedup": op10_line_dedup,
        "op11_phrases": op11_phrases,
        "op12_packing": op12_packing,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op3_near_dedup": _OP3, "op10_line_dedup": _OP10, "op11_phrases": _OP11}

"""What the corpus operators share: the shared folder, names, hashes, size checks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A table is broadcast only when it was written first and holds at most this many bytes.
BROADCAST_BYTES = 48 << 20

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this machine only in local mode, where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own_root.setdefault(app, None) or tempfile.mkdtemp(prefix="shared_")
        _own_root[app] = root
    return root.rstrip("/")


def write_table(df: DataFrame, tag: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder, return it as read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under ``path``, by the file system that Spark uses for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def drop_table(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Written tables that one operator needs on its way; ``drop`` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` as written and read back, with the hint to broadcast it if it is small enough."""
        table, path = write_table(df, tag)
        self.paths.append(path)
        return sized(table, path)

    def drop(self) -> None:
        for path in self.paths:
            drop_table(self.spark, path)
        self.paths = []


def _row_bytes(schema: StructType) -> int:
    """Bytes that a row takes in a broadcast table, its place in the hash table included; texts and arrays count as short ones."""
    return 64 + sum(8 if isinstance(f.dataType, NumericType | BooleanType | DatetimeType) else 64 for f in schema.fields)


def sized(df: DataFrame, path: str, limit: int = BROADCAST_BYTES, grows: int = 4) -> DataFrame:
    """Hint a broadcast if the written table is small enough, by its bytes on disk and by its rows.

    ``grows`` is what a byte on disk takes in memory for texts; sorted numbers shrink far more
    on disk, so the rows are counted too, from the files' footers.
    """
    if table_bytes(df.sparkSession, path) * grows > limit or df.count() * _row_bytes(df.schema) > limit:
        return df
    return F.broadcast(df)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts as Python objects at a time.

    At the end of a task, memory that is free goes back to the system: workers live on.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the shorter way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(col: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(col), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - (1 << 64)), col)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df``, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``most`` labelled documents, by hash order, none of them held out.

    ``most`` is the documented bound of a fit; the same rows come out at every run.
    Null ids, labels and rows with several labels are left out; of rows that repeat an id,
    the smallest text counts.
    """
    marks = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .where(remainder(F.col("id"), mod) != held)
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where(F.col("y") == F.col("top"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    marks, path = write_table(marks.select("id", "y"), "marks")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one row per id, whatever the documents hold; texts meet by their id's hash, partly merged before the shuffle
    return texts.join(sized(marks, path), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")

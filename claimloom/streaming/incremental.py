"""The batch transforms over Structured Streaming: claims and pages that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import last_per_key, new_mappings, upsert


def stream_claims(claims: DataFrame, read_stored: Callable[[], DataFrame], append: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Insert new claims of each micro-batch; a batch that is run again inserts nothing twice."""

    def each(batch: DataFrame, _: int) -> None:
        append(new_mappings(batch, read_stored()))

    return claims.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_articles(articles: DataFrame, read_stored: Callable[[], DataFrame], replace: Callable[[DataFrame], None], checkpoint: str, key: str = "url", sequence: str = "last_update", **trigger) -> StreamingQuery:
    """Merge the last version of each record of a micro-batch into the stored table."""

    def each(batch: DataFrame, _: int) -> None:
        replace(upsert(read_stored(), last_per_key(batch, key, sequence), key))

    return articles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and key, with a watermark that bounds the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), key).agg(F.count(F.lit(1)).alias("n"))

"""Lines that arrive as files: a streaming source whose batches become commits. An addition of ours, not a search feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.books import text_books
from quire.sources.store import Store


def ingest(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Parquet files with whole books (sources.books.BOOK) that land in ``source`` replace those of the same path in the
    store, one commit a batch. The commit holds the batch's number, so a batch that is replayed after a failure is skipped."""

    def apply(batch: DataFrame, number: int) -> None:
        if int(store.table.manifest().meta.get("stream_batch", -1)) >= number:
            return
        store.rollback()
        store.upsert_books(text_books(batch))
        store.commit(stream_batch=number)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key and window of event time; rows later than the watermark are left out once a window is closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), F.col(key)).agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), key, "count")

"""Results in chunks, with counts first where asked, and cancellation by tag."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.search import chunks


@dataclass
class Update:
    """An event of a stream: counts (first event), rows, progress, or the end."""

    total: int | None = None
    truncated: bool | None = None
    rows: list = field(default_factory=list)
    searched: int | None = None
    done: bool = False


def stream(page: DataFrame, size: int) -> Iterator[list]:
    """The ranked rows of a page in chunks of ``size``; ranking is complete before the first chunk."""
    yield from chunks(page, size)


def stream_with_counts(hits: DataFrame, page: DataFrame, size: int, truncated: bool) -> Iterator[Update]:
    """First the number of hits, then the rows of the page in chunks."""
    yield Update(total=hits.count(), truncated=truncated)
    for part in chunks(page, size):
        yield Update(rows=part)


def stream_by_books(hits: DataFrame, size: int, parts: int = 8) -> Iterator[Update]:
    """Hits as they are found, over ``parts`` groups of books one after the other, with progress; the last event is the end."""
    for i in range(parts):
        part = hits.where(F.pmod(F.xxhash64("file_path"), F.lit(parts)) == i)
        for rows in chunks(part, size):
            yield Update(rows=rows, searched=i)
        yield Update(searched=i + 1)
    yield Update(done=True)


@contextmanager
def cancellable(spark: SparkSession, request: str):
    """Jobs started inside can be ended from another thread by cancel(); an unknown request is no error."""
    spark.addTag(request)
    try:
        yield
    finally:
        spark.removeTag(request)


def cancel(spark: SparkSession, request: str) -> None:
    spark.interruptTag(request) if hasattr(spark, "interruptTag") else spark.sparkContext.cancelJobsWithTag(request)

"""Whole books, scanned pages, library batches and external line rows as rows of lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as T
from quire.functions.hashes import content_hash, line_check, line_hash, metadata_hash, text_hash
from quire.operators.corpus import book_number, document_id, facets_of, heading_level, with_edges, with_sections, with_tokens
from quire.session import small

INDEXED, MISSING, UNAVAILABLE, FAILED, CANCELLED = "Indexed", "Missing", "Unavailable", "Failed", "Cancelled"
BOOK = "file_path string, title string, topics string, text string, extra_facets array<string>, source_hash bigint"
PAGE = "file_path string, title string, topics string, reference string, text string, page_index int"
STORED = (
    "id bigint, file_path string, ordinal int, segment bigint, section_ordinal int, title string, topics string, reference string, is_pdf boolean, facets array<string>, "
    "raw string, plain string, vocalized string, is_heading boolean, dl int, first int, last int, line_hash bigint, line_check bigint, content_hash bigint, text_hash bigint, metadata_hash bigint, source_hash bigint"
)
COLUMNS = [x.split()[0] for x in STORED.split(", ")]


def _default(df: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def decode(bytes_column: Column) -> Column:
    """Text of UTF-8 bytes; what is no UTF-8 becomes the replacement character, as a lenient reader has it."""

    @F.pandas_udf(StringType())
    def lossy(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")

    return lossy(bytes_column)


def zstd_text(frame: Column, dictionary: bytes | None = None) -> Column:
    """Text of rows stored as zstd frames, with their shared dictionary if they have one. A broken frame is null."""

    @F.pandas_udf(StringType())
    def unpacked(s: pd.Series) -> pd.Series:
        import zstandard

        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

        def one(b: bytes) -> str | None:
            try:
                return d.decompressobj().decompress(bytes(b)).decode("utf-8", "replace")
            except zstandard.ZstdError:
                return None

        return s.map(one, na_action="ignore")

    return unpacked(frame)


def with_texts(lines: DataFrame) -> DataFrame:
    """Adds plain and vocalized text (null where it is the same as plain) and whether the line is a heading."""
    raw = T.strip_data_uris(F.coalesce("raw", F.lit("")))
    vocalized = T.normalize_vocalized(raw)
    out = lines.withColumn("plain", T.normalize(raw)).withColumn("_v", vocalized)
    return out.withColumn("vocalized", F.when(F.col("_v") != F.col("plain"), F.col("_v"))).withColumn("is_heading", heading_level(F.col("raw")).isNotNull()).drop("_v")


def text_books(books: DataFrame) -> DataFrame:
    """Lines of whole books (see BOOK): one row per piece between line breaks, with section, reference and fingerprints.

    A null or empty text has no lines. Fingerprints stand in every line of the book; a book given twice has its lines
    twice. The text is split in place, so the only shuffle is the one by book for the headings.
    """
    b = _default(books, extra_facets="array<string>", source_hash="bigint", title="string", topics="string").where("text IS NOT NULL AND text <> ''")
    b = b.withColumn("content_hash", content_hash(F.col("text"), F.col("title"), F.col("topics"), F.col("extra_facets"))).withColumn("text_hash", text_hash(F.col("text")))
    b = b.withColumn("metadata_hash", metadata_hash(F.col("title"), F.col("topics"), F.col("extra_facets"))).withColumn("facets", facets_of(F.col("topics"), F.col("extra_facets")))
    lines = b.select("*", F.posexplode(F.split("text", "\r?\n")).alias("ordinal", "raw")).drop("text", "extra_facets")
    lines = with_texts(with_sections(lines))
    return lines.withColumn("segment", F.col("ordinal").cast("long")).withColumn("is_pdf", F.lit(False))


def pdf_books(pages: DataFrame) -> DataFrame:
    """Lines of scanned books (see PAGE), one per page: the page's text lines without the noise, joined by line breaks."""
    p = _default(pages, extra_facets="array<string>", source_hash="bigint", title="string", topics="string", reference="string").where("text IS NOT NULL")
    each = p.withColumn("parts", F.split("text", "\r?\n"))

    def cleaned(how) -> Column:
        kept = F.filter("parts", lambda x: ~T.is_garbage(T.normalize(x)))
        return F.array_join(F.filter(F.transform(kept, how), lambda x: x != ""), "\n")

    out = each.withColumn("plain", cleaned(T.normalize)).withColumn("_v", cleaned(T.normalize_vocalized))
    out = out.withColumn("vocalized", F.when(F.col("_v") != F.col("plain"), F.col("_v"))).withColumn("raw", F.col("text"))
    out = out.withColumn("metadata_hash", metadata_hash(F.col("title"), F.col("topics"), F.col("extra_facets"))).withColumn("facets", facets_of(F.col("topics"), F.col("extra_facets")))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "file_path", "title", "topics", "reference", F.col("page_index").alias("ordinal"), "raw", "plain", "vocalized", F.lit(False).alias("is_heading"), F.col("page_index").cast("long").alias("segment"),
        F.col("page_index").alias("section_ordinal"), F.lit(True).alias("is_pdf"), "facets", zero.alias("content_hash"), zero.alias("text_hash"), "metadata_hash", "source_hash",
    )


def documents(rows: DataFrame) -> DataFrame:
    """Single lines as they are given (see corpus.INPUT), normalized."""
    r = _default(rows, reference="string", topics="string", title="string", text_vocalized="string", segment="bigint", section_ordinal="int", is_pdf="boolean", extra_facets="array<string>", content_hash="bigint", text_hash="bigint", source_hash="bigint")
    r = r.withColumn("raw", F.coalesce("text_vocalized", "text")).withColumn("facets", facets_of(F.col("topics"), F.col("extra_facets")))
    r = with_texts(r).withColumn("plain", T.normalize(F.coalesce("text", F.lit(""))))
    r = r.withColumn("metadata_hash", metadata_hash(F.col("title"), F.col("topics"), F.col("extra_facets")))
    return r.withColumn("alone", F.lit(True)).withColumn("segment", F.coalesce("segment", F.col("ordinal").cast("long"))).withColumn("is_pdf", F.coalesce("is_pdf", F.lit(False)))


def measured(lines: DataFrame) -> DataFrame:
    """Adds what a search needs to know of a line besides its words: number of tokens, edges of its content (null for
    headings and for single documents, which end phrases), the signature of its text, the check sum of its row."""
    out = with_edges(with_tokens(lines))
    open_ = ~F.coalesce(F.col("is_heading"), F.lit(False)) & ~(F.col("alone") if "alone" in lines.columns else F.lit(False))
    out = out.withColumn("dl", F.size("tokens")).withColumn("first", F.when(open_, F.col("first"))).withColumn("last", F.when(open_, F.col("last")))
    return out.withColumn("line_hash", line_hash(F.col("plain"))).withColumn("line_check", line_check(F.col("raw"))).drop("tokens", "pos")


def with_ids(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """Gives lines their ids by the numbers of their books and brings them into the stored layout."""
    out = measured(lines).join(small(numbers), "file_path").withColumn("id", document_id(F.col("book_no"), F.col("ordinal")))
    have = set(out.columns)
    kinds = dict(x.split(None, 1) for x in STORED.split(", "))
    return out.select(*((F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS))


def library_books(requests: DataFrame, rows: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of books from line sources: (lines, statuses).

    ``requests``: position, source, book_id, title, topics, file_path, extra_facets, source_hash. ``rows``: source, book_id,
    line_index, content. ``available``: source. A book of a source that isn't there is Unavailable, one without rows
    Missing, one with a null row Failed; none of these gets any line. Statuses keep the order of the requests.
    """
    per = rows.groupBy("source", "book_id").agg(F.count("*").alias("n"), F.count("content").alias("whole"))
    at = requests.join(small(available.select("source").distinct().withColumn("there", F.lit(True))), "source", "left").join(small(per), ["source", "book_id"], "left")
    status = F.when(F.col("there").isNull(), UNAVAILABLE).when(F.col("n").isNull(), MISSING).when(F.col("whole") < F.col("n"), FAILED).otherwise(INDEXED)
    known = at.withColumn("status", status)
    good = known.where(F.col("status") == INDEXED).drop("n", "whole", "there", "status", "position")
    rank = F.row_number().over(W.partitionBy("source", "book_id").orderBy("line_index")) - 1
    lines = rows.withColumn("ordinal", rank).join(small(good), ["source", "book_id"]).select(*(c for c in good.columns if c not in ("source", "book_id")), "ordinal", F.col("content").alias("raw"), F.col("line_index").cast("long").alias("segment"))
    lines = _default(lines, extra_facets="array<string>", source_hash="bigint", title="string", topics="string")
    lines = lines.withColumn("facets", facets_of(F.col("topics"), F.col("extra_facets"))).withColumn("metadata_hash", metadata_hash(F.col("title"), F.col("topics"), F.col("extra_facets"))).drop("extra_facets")
    return with_texts(with_sections(lines)).withColumn("is_pdf", F.lit(False)), known.select("position", "file_path", "status").orderBy("position")


def displayed(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with the text of an external line source: ``row_text`` and ``text_status``.

    ``hits``: book_id, segment, line_check, line_hash, plain; ``rows``: book_id, line_index, content. The row is the one
    with ``line_index`` = segment, else the segment-th by line_index. ``ok`` if it has the recorded CRC, or the recorded
    signature; ``stale`` if it has neither; ``unavailable`` if there is none (the stored text is shown).
    """
    at = hits.withColumn("_hit", F.monotonically_increasing_id())
    by_index = rows.select("book_id", F.col("line_index").cast("long").alias("segment"), F.col("content").alias("_a"))
    out = at.join(by_index.join(hits.select("book_id", "segment").distinct(), ["book_id", "segment"], "left_semi").groupBy("book_id", "segment").agg(F.min("_a").alias("_a"), F.lit(True).alias("_there")), ["book_id", "segment"], "left")
    # only books with a hit that no index leads to are numbered through
    lost = out.where("_there IS NULL").select("book_id").distinct()
    near = rows.join(lost, "book_id", "left_semi").withColumn("nth", F.row_number().over(W.partitionBy("book_id").orderBy("line_index")) - 1)
    by_rank = near.select("book_id", F.col("nth").cast("long").alias("segment"), F.col("content").alias("_b"))
    out = out.join(by_rank, ["book_id", "segment"], "left").withColumn("row_text", F.when(F.col("_there"), F.col("_a")).otherwise(F.col("_b"))).drop("_there", "_hit")
    same = (line_check(F.col("row_text")) == F.col("line_check")) | ((F.col("line_hash") != 0) & (line_hash(T.normalize(F.col("row_text"))) == F.col("line_hash")))
    status = F.when(F.col("row_text").isNull(), "unavailable").when(same, "ok").otherwise("stale")
    return out.withColumn("text_status", status).withColumn("row_text", F.coalesce("row_text", "plain")).drop("_a", "_b")


def rehydrated(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines with the bodies of their notes put back at their places.

    ``notes``: id, char_pos (UTF-16 units), body. Bodies at one place keep the order of their ``note_no``; a place behind
    the end is the end. Lines without notes stay as they are.
    """
    per = notes.where("body IS NOT NULL AND char_pos IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("char_pos", "note_no", "body"))).alias("notes"))

    @F.pandas_udf(StringType())
    def put(raw: pd.Series, notes: pd.Series) -> pd.Series:
        def one(text, marks):
            if text is None or marks is None:
                return text
            units = text.encode("utf-16-le")
            for m in reversed(list(marks)):
                at = max(0, min(2 * m["char_pos"], len(units)))
                units = units[:at] + f'<i class="footnote">{m["body"]}</i>'.encode("utf-16-le") + units[at:]
            return units.decode("utf-16-le", "replace")

        return pd.Series([one(a, b) for a, b in zip(raw, notes, strict=True)], dtype=object)

    return lines.join(per, "id", "left").withColumn("raw", put("raw", "notes")).drop("notes")


def stamps(lines: DataFrame) -> DataFrame:
    """One row per book: documents and fingerprints; a fingerprint its lines disagree about, or lack, is 0."""
    one = lambda c: F.when(F.count_distinct(F.coalesce(c, F.lit(0))) == 1, F.max(F.coalesce(c, F.lit(0)))).otherwise(F.lit(0)).alias(c)
    return lines.groupBy("file_path").agg(F.count("*").alias("documents"), *(one(c) for c in ("content_hash", "text_hash", "metadata_hash", "source_hash")))


def order_book_numbers(lines: DataFrame) -> DataFrame:
    """(file_path, book_no) of stored lines."""
    return lines.select("file_path", book_number(F.col("id")).alias("book_no")).distinct()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder as books, one file a book."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("text"))

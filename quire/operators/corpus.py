"""Lines of books as rows, and what is derived from them: tokens with positions, sections, edges, terms, postings.

``Corpus.lines`` has one row per line: id, file_path, book_no, ordinal, segment, section_id, title, reference, is_pdf,
facets, plain, vocalized, tokens, pos, first, last, line_hash. A stored corpus has its inverted form besides (``postings``),
sorted by term: a search reads the row groups of its terms and no line; lines are looked up by id for what is displayed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.functions import text as T
from quire.session import small

BOOK_SHIFT = 32
SECTION_MASK = ~0xFFFFFFFF
#: Documents of a batch in the layout of ``lines`` before anything is derived.
INPUT = "file_path string, ordinal int, title string, reference string, topics string, text string, text_vocalized string, segment bigint, section_ordinal int, is_pdf boolean, extra_facets array<string>, content_hash bigint, text_hash bigint, source_hash bigint"


def document_id(book_no: Column, ordinal: Column) -> Column:
    """(book number << 32) + ordinal + 1."""
    return F.shiftleft(book_no.cast("long"), BOOK_SHIFT) + ordinal.cast("long") + 1


def book_number(id_: Column) -> Column:
    return F.shiftright(id_, BOOK_SHIFT)


def number_books(books: DataFrame, known: DataFrame | None = None, high_water: int = 0) -> DataFrame:
    """(file_path, book_no): known books keep their number, new ones get the next ones in order of their path. A number
    once given is never given again, so the high-water mark outlives the books. Books are a small dimension; only the new
    ones are ordered. Null paths get no number."""
    paths = books.select("file_path").where("file_path IS NOT NULL").distinct()
    if known is None:
        known = paths.sparkSession.createDataFrame([], "file_path string, book_no long")
    last = max(high_water, known.agg(F.max("book_no")).first()[0] or 0)
    fresh = paths.join(known, "file_path", "left_anti").withColumn("book_no", F.row_number().over(W.orderBy("file_path")).cast("long") + F.lit(last))
    return known.select("file_path", "book_no").unionByName(fresh)


def heading_level(raw: Column) -> Column:
    """The level of a heading line (``<h2>...`` is 2), null for other lines."""
    return F.regexp_extract(raw, r"^\s*<[hH]([1-6])[\s>]", 1).try_cast("int")


#: Lines of a book that one task sorts; headings before them come from the aggregates of the stretches before.
STRETCH = 1 << 16


def with_sections(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``section_ordinal`` (the ordinal of the heading a line stands under, 0 before the first) and ``reference``
    (the trail of headings above the line, outermost first).

    A heading replaces the entry of its level and ends those below it. Books are dealt with in stretches of ordinals, so one
    that holds a third of all lines is many tasks: each stretch's last heading of a level is aggregated, carried over to the
    stretches behind it (a few rows a book), and joined to their lines. Null paths are one book, null ordinals come first.
    """
    level, title = heading_level(F.col(raw)), T.collapse(T.strip_html(F.col(raw)))
    out = lines.withColumn("_level", level).withColumn("_title", F.when(F.col("_level").isNotNull(), title))
    out = out.withColumn("_b", F.floor(F.coalesce("ordinal", F.lit(-1)) / STRETCH))
    last = lambda k: F.max(F.when(F.col("_level") == k, F.struct("ordinal", "_title")))
    any_ = F.max(F.when(F.col("_level").isNotNull(), F.col("ordinal")))
    before = W.partitionBy("file_path").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = out.groupBy("file_path", "_b").agg(*(last(k).alias(f"_c{k}") for k in range(1, 7)), any_.alias("_c0"))
    carried = ends.select(F.col("file_path").alias("_path"), F.col("_b").alias("_stretch"), *(F.max(f"_c{k}").over(before).alias(f"_c{k}") for k in range(7)))
    carried = carried.where("_c0 IS NOT NULL")
    w = W.partitionBy("file_path", "_b").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    out = out.select("*", *(last(k).over(w).alias(f"_h{k}") for k in range(1, 7)), any_.over(w).alias("_h0"))
    out = out.join(carried, F.col("file_path").eqNullSafe(F.col("_path")) & (F.col("_b") == F.col("_stretch")), "left")
    out = out.select(*(c for c in out.columns if not c.startswith(("_h", "_c"))), *(F.coalesce(f"_h{k}", f"_c{k}").alias(f"_h{k}") for k in range(7)))
    trail = []
    for k in range(1, 7):
        entry = F.col(f"_h{k}")
        open_ = F.col(f"_h{k}").isNotNull()
        for j in range(1, k):
            open_ = open_ & (F.col(f"_h{j}").isNull() | (F.col(f"_h{j}.ordinal") < entry["ordinal"]))
        trail.append(F.when(open_, entry["_title"]))
    out = out.withColumn("section_ordinal", F.coalesce("_h0", F.lit(0))).withColumn("reference", F.concat_ws(", ", *trail))
    return out.drop("_level", "_title", "_b", "_path", "_stretch", *(f"_h{k}" for k in range(7)))


def facets_of(topics: Column, extra: Column) -> Column:
    """All facets of a line: its topics path and the extra ones, without empty or repeated entries."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.when(topics.isNull() | (topics == ""), none).otherwise(F.array(topics)), F.coalesce(extra, none)), lambda f: f.isNotNull() & (f != "")))


def with_tokens(lines: DataFrame, plain: str = "plain") -> DataFrame:
    """Adds tokens and pos of a text; tokens over the length limit are left out, their positions stay taken."""
    kept = F.filter(T.placed_tokens(F.col(plain)), lambda x: F.octet_length(x["t"]) <= T.MAX_TOKEN_BYTES)
    return lines.withColumn("_k", kept).withColumn("tokens", F.col("_k.t")).withColumn("pos", F.col("_k.p")).drop("_k")


def with_edges(lines: DataFrame, plain: str = "plain") -> DataFrame:
    """Adds ``first`` and ``last``, the positions of the first and last word of a line's content, enumerators at its
    ends not counted; null for lines without content."""
    enumerated = F.col(plain).rlike(r"^\s*[(\[{]|[)\]}][\s.:,;]*$")  # most lines have none: their edges are their first and last token
    out = lines.withColumn("_inner", F.when(enumerated, T.content(F.col(plain))))
    lead = F.substring(F.col(plain), F.lit(1), F.greatest(F.instr(F.col(plain), F.col("_inner")) - 1, F.lit(0)))
    before = F.when(F.col("_inner").isNull(), 0).otherwise(T.token_count(lead))
    cut = F.when(F.col("_inner").isNull(), F.size("tokens")).otherwise(T.token_count(F.col("_inner")))
    out = out.withColumn("_before", before).withColumn("_cut", cut)
    ok = (F.size("tokens") > 0) & (F.col("_cut") > 0)
    first = F.when(ok, F.element_at("pos", F.least(F.col("_before") + 1, F.size("pos"))))
    last = F.when(ok, F.element_at("pos", F.least(F.col("_before") + F.col("_cut"), F.size("pos"))))
    return out.withColumn("first", first).withColumn("last", last).drop("_inner", "_before", "_cut")


TERM = "term string, bare string, df bigint"
POSTING = "id bigint, term string, p int, dl int, first int, last int, section_id bigint"


#: Places from here on are those of a scanned page without the enumerators at its inner line breaks.
LAYOUT = 1 << 28


_MARKS = rf"(?:\s*{T._MARKER}[\s.:,;]*)+(?=\n)|(?<=\n)\s*(?:{T._MARKER}\s*)+"


def layout_of(plain: str, tokens: Sequence[str], pos: Sequence[int]) -> list[tuple[str, int]]:
    """The tokens of a page as they follow each other when the enumerators at its inner line breaks don't count, with places
    behind LAYOUT; none for pages without such enumerators, or with tokens that can't be told apart by place.

    A phrase then holds if its words follow each other as they stand, or as they stand here; the two kinds of places are too
    far apart to mix. An enumerator is at the place of the word before it and of the one behind it, so it can be looked for.
    """
    text = plain.translate(T._QUOTES)
    spans = [m.span() for m in re.finditer(_MARKS, text)]
    if not spans:
        return []
    starts, at, skipped, marked = [m.start() for m in T._PY_TOKEN.finditer(text)], 0, [0], []
    for x in starts:
        while at < len(spans) and spans[at][1] <= x:
            at += 1
        marked.append(at < len(spans) and spans[at][0] <= x)
        skipped.append(skipped[-1] + marked[-1])
    if len(set(pos)) != len(pos) or (len(pos) and max(pos) >= len(starts)):
        return []
    out = []
    for t, p in zip(tokens, pos):
        place = int(p) - skipped[p] + LAYOUT
        out += [(t, place - 1), (t, place)] if marked[p] else [(t, place)]
    return out


@F.pandas_udf(ArrayType(StructType([StructField("t", StringType()), StructField("p", IntegerType())])))
def layout_places(plain: pd.Series, tokens: pd.Series, pos: pd.Series) -> pd.Series:
    """layout_of of pages."""
    return pd.Series([[{"t": t, "p": p} for t, p in layout_of(*x)] for x in zip(plain, tokens, pos, strict=True)], dtype=object)


def postings_of(lines: DataFrame) -> DataFrame:
    """(POSTING): one row for each place of a term, with what a search needs to know of its line. No shuffle. Scanned pages
    with enumerators at inner line breaks give their places without these besides; only they reach Python."""
    known = ["id", "first", "last", "section_id", F.size("tokens").alias("dl")]
    rows = lines.select(*known, F.explode(F.arrays_zip(F.col("tokens").alias("t"), F.col("pos").alias("p"))).alias("x"))
    if {"is_pdf", "plain"} <= set(lines.columns):
        pages = lines.where("is_pdf").where(F.col("plain").rlike(r"[)\]}][\s.:,;]*\n|\n\s*[(\[{]"))
        rows = rows.unionByName(pages.select(*known, F.explode(layout_places("plain", "tokens", "pos")).alias("x")))
    return rows.select("id", F.col("x.t").alias("term"), F.col("x.p").alias("p"), "dl", "first", "last", "section_id")


def counts_of(lines: DataFrame, sign: int = 1) -> DataFrame:
    """(TERM): in how many lines each term stands. Only terms are shuffled, counted within tasks first."""
    each = lines.select(F.explode(F.array_distinct("tokens")).alias("term"))
    return each.groupBy("term").agg((F.count("*") * sign).alias("df")).select("term", T.bare(F.col("term")).alias("bare"), "df")


def clustered(postings: DataFrame) -> DataFrame:
    """Postings in the order they are stored in: by range of term and line, so that the statistics of a file tell which
    terms it can hold, and a term that fills a third of the rows lies in many files."""
    return postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


@dataclass
class Corpus:
    """The lines, and for a stored corpus its postings, its counted terms (dictionary), its books with their facets and
    orders, and the number and mean length of its lines. With postings a search never scans the lines."""

    lines: DataFrame
    stored: DataFrame | None = None
    dictionary: DataFrame | None = None
    books: DataFrame | None = None
    size: tuple[int, float] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.lines.sparkSession

    def postings(self) -> DataFrame:
        """(POSTING) of every line."""
        return self.stored if self.stored is not None else postings_of(self.lines)

    def terms(self) -> DataFrame:
        """(term, bare, len, df) of every term of the dictionary; counts of several commits are summed up."""
        each = self.dictionary if self.dictionary is not None else counts_of(self.lines)
        return each.groupBy("term", "bare").agg(F.sum("df").alias("df")).where("df > 0").select("term", "bare", F.length("term").alias("len"), "df")

    def wide(self) -> DataFrame:
        """The lines with the columns of their books."""
        if self.books is None:
            return self.lines
        mine = self.lines.drop(*(c for c in self.books.columns if c in self.lines.columns and c != "book_no"))
        if "book_no" not in mine.columns:
            mine = mine.withColumn("book_no", book_number(F.col("id")))
        return mine.join(self.books, "book_no", "left")

    def write(self, path: str, ranged: bool = False) -> None:
        """Store the lines by id, their postings by term, the counted terms, and the books. Lines that are ``ranged`` by id
        already are not dealt out again, which would make them twice."""
        rows = self.lines if ranged else self.lines.repartitionByRange("id")
        rows.sortWithinPartitions("id").write.parquet(f"{path}/lines")
        lines = self.spark.read.parquet(f"{path}/lines")
        clustered(postings_of(lines)).write.parquet(f"{path}/postings")
        counts_of(lines).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        (self.books if self.books is not None else books_of(lines)).write.parquet(f"{path}/books")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Corpus:
        lines, postings, terms, books = (spark.read.parquet(f"{path}/{x}") for x in ("lines", "postings", "terms", "books"))
        return Corpus(lines, postings, terms, small(books), size_of(lines))


def books_of(lines: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(book_no, file_path, title, facets, catalogue_order, generation_order): the columns that are the same for all lines of
    a book. Facets that lines of a book have differently are joined."""
    number = book_number(F.col("id")).alias("book_no")
    have = lambda c, kind: F.col(c) if c in lines.columns else F.lit(None).cast(kind)
    rows = lines.select(number, "file_path", have("title", "string").alias("title"), F.explode_outer(have("facets", "array<string>")).alias("f"))
    per = rows.groupBy("book_no").agg(F.min("file_path").alias("file_path"), F.min("title").alias("title"), F.array_sort(F.collect_set("f")).alias("facets"))
    return with_order(per, order)


def size_of(lines: DataFrame) -> tuple[int, float]:
    """Number of lines and their mean length in tokens."""
    n, mean = lines.agg(F.count("*"), F.avg("dl" if "dl" in lines.columns else F.size("tokens"))).first()
    return n, mean or 1.0


def build(documents: DataFrame, vocalized: bool = False) -> Corpus:
    """A corpus of rows (id, file_path, ordinal, raw and more): plain text, tokens, edges and signatures derived.

    Rows need ``id`` and ``raw`` (or ``plain``); columns that are missing are filled with nulls. Null texts become lines
    without tokens.
    """
    d = documents
    have = set(d.columns)
    if "plain" not in have:
        d = d.withColumn("plain", T.normalize(F.coalesce("raw", F.lit(""))))
    if vocalized and "vocalized" not in have:
        d = d.withColumn("vocalized", T.normalize_vocalized(F.coalesce("raw", F.lit(""))))
    for name, kind in (("file_path", "string"), ("ordinal", "int"), ("segment", "long"), ("title", "string"), ("reference", "string"), ("is_pdf", "boolean"), ("facets", "array<string>"), ("section_id", "long")):
        if name not in have:
            d = d.withColumn(name, F.lit(None).cast(kind))
    d = with_edges(with_tokens(d))
    if vocalized:
        t, p = T.tokens_and_positions(F.col("vocalized"))
        d = d.withColumn("voc_tokens", t).withColumn("voc_pos", p)
    return Corpus(d.withColumn("book_no", book_number(F.col("id"))))


def with_order(lines: DataFrame, order: DataFrame | None) -> DataFrame:
    """Adds catalogue_order and generation_order by book; of repeated rows of the mapping the smallest count."""
    if order is None:
        return lines.withColumn("catalogue_order", F.lit(None).cast("int")).withColumn("generation_order", F.lit(None).cast("int"))
    per = order.where("file_path IS NOT NULL").groupBy("file_path").agg(F.min("catalogue_order").alias("catalogue_order"), F.min("generation_order").alias("generation_order"))
    return lines.join(small(per), "file_path", "left")

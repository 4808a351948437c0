"""Boolean and positional matching over the lines, and the ranking of what matched.

A query's words are expanded to sets of terms first (at most a few thousand each). Then the places where a term of word i
stands in a line become arrays of positions, ``w0``, ``w1``, ... A stored corpus gives them from the postings of these terms
alone, by one aggregation by line; a corpus without postings is scanned. Phrases, gaps and windows are decided on the arrays
inside the row; sections add one aggregation by section, phrases over a line break one equi-join on the next id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.functions import text as T
from quire.functions.words import EXACT, MAX_TERMS_PHRASE, OTHER, WordPlan, any_order_span, plan_word
from quire.operators.corpus import LAYOUT, Corpus, book_number
from quire.operators.expand import Expansion, expand
from quire.session import cut

WORD_DISTANCE, SAME_PARAGRAPH, SAME_SECTION = "wordDistance", "sameParagraph", "sameSection"
ALL, ANY, MOST, AT_LEAST = "all", "any", "most", "atLeast"
CATALOGUE, GENERATION, RELEVANCE = "catalogue", "generation", "relevance"
SAME_SECTION_GROUPS, IDENTICAL_TEXT = "sameSection", "identicalText"
K1, B = 1.2, 0.75
#: A phrase over a line break counts as half an occurrence in a line of average length.
CROSS_LINE_WEIGHT = 0.5
SIBLINGS = 10


@dataclass
class Query:
    """A planned search. ``gaps`` are the words allowed between neighbours; ``any_order`` is a distance or None."""

    words: list[WordPlan]
    gaps: list[int] = field(default_factory=list)
    any_order: int | None = None
    scope: str = WORD_DISTANCE
    mode: str = ALL
    count: int | None = None
    facets: list[str] = field(default_factory=list)
    negative: Query | None = None
    cross_line: bool = True
    cap: int = MAX_TERMS_PHRASE

    @property
    def vocalized(self) -> bool:
        return any(w.vocalized for w in self.words)

    def needed(self) -> int:
        """How many of the words a line needs."""
        n = len(self.words)
        return {ALL: n, ANY: 1, MOST: n // 2 + 1, AT_LEAST: min(max(self.count or 1, 1), n)}[self.mode]

    def crosses(self) -> bool:
        """Whether phrases may run over a line break: not for vocalized, partial, paragraph, section or unordered searches."""
        return self.cross_line and len(self.words) > 1 and self.scope == WORD_DISTANCE and self.mode == ALL and self.any_order is None and not self.vocalized


# -- facets -------------------------------------------------------------------------------------------------------------

RESERVED = ("author", "era", "base")


def dimension(path: str) -> str:
    """The dimension of a facet path: a reserved root by itself, all other paths together."""
    root = path.strip("/").split("/")[0]
    return root if root in RESERVED else ""


def facet_filter(paths: list[str], column: str = "facets") -> Column | None:
    """OR within a dimension, AND across; a path matches itself and what lies below it. Empty strings are skipped; a path
    that doesn't start with a slash is an error."""
    by: dict[str, list[str]] = {}
    for p in paths:
        if p:
            if not p.startswith("/"):
                raise ValueError(f"not a facet path: {p!r}")
            by.setdefault(dimension(p), []).append(p.rstrip("/"))
    if not by:
        return None
    one = lambda ps: F.exists(column, lambda f: reduce(lambda a, b: a | b, [(f == p) | f.startswith(p + "/") for p in ps]))
    return reduce(lambda a, b: a & b, [one(ps) for ps in by.values()])


def attached(c: Corpus, hits: DataFrame, *columns: str) -> DataFrame:
    """Hits with columns of their lines that the postings don't have: an equi-join by id over just these columns."""
    missing = [x for x in columns if x not in hits.columns]
    return hits.join(c.lines.select("id", *missing), "id") if missing else hits


def next_lines(c: Corpus, hits: DataFrame) -> DataFrame:
    """The lines that follow hits in their books; a line's id is one more than that of the line before it."""
    return c.lines.join(hits.select((F.col("id") + 1).alias("id")), "id", "left_semi")


def facet_counts(hits: DataFrame, prefix: str = "/") -> DataFrame:
    """(path, count): the hits below each direct child of ``prefix``. A hit counts once a child."""
    depth = len([x for x in prefix.split("/") if x])
    base = "/" + "/".join(x for x in prefix.split("/") if x)
    below = F.filter("facets", lambda f: f.startswith(base if base == "/" else base + "/"))
    child = F.transform(below, lambda f: F.concat(F.lit("/"), F.array_join(F.slice(F.split(F.regexp_replace(f, "^/", ""), "/"), 1, depth + 1), "/")))
    return hits.select("id", F.explode(F.array_distinct(child)).alias("path")).groupBy("path").agg(F.count_distinct("id").alias("count"))


# -- matching ------------------------------------------------------------------------------------------------------------


def among(c: Column, values: list) -> Column:
    return c.isin(values) if values else F.lit(False)


def places(e: Expansion, tokens: str, pos: str) -> Column:
    """Where a word's terms stand in a line."""
    terms = list(e.terms)
    if not terms:
        return F.array().cast("array<int>")
    pairs = F.arrays_zip(F.col(tokens).alias("t"), F.col(pos).alias("p"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda x: x["t"].isin(terms)), lambda x: x["p"]))


def tier_of(term: Column, e: Expansion) -> Column:
    """The tier of a term of a word, null for other terms."""
    out = F.lit(None).cast("int")
    for k in sorted({tier for tier, _ in e.terms.values()}, reverse=True):
        out = F.when(among(term, [t for t, (tier, _) in e.terms.items() if tier == k]), F.lit(k)).otherwise(out)
    return out


def _tiers_of(e: Expansion):
    return lambda term: tier_of(term, e)


def _worst(tiers: list[Column]) -> Column:
    """The tier of a line: that of its word farthest from what was typed; words it lacks count as farthest."""
    each = [F.coalesce(t, F.lit(OTHER)) for t in tiers]
    return F.greatest(*each) if len(each) > 1 else each[0] if each else F.lit(OTHER)


def from_postings(c: Corpus, found: list[Expansion]) -> DataFrame:
    """One row per line that holds a term of any word: id, book columns, dl, first, last, section_id, w0, w1, ..., tier.

    Only postings of the terms are read: the filter reaches the scan, and files and row groups of other terms are skipped.
    The shuffle by line moves these postings and nothing else; a line's places are bounded by its length.
    """
    every = sorted({t for e in found for t in e.terms})
    hits = c.stored.where(among(F.col("term"), every))
    at = lambda e: F.when(among(F.col("term"), list(e.terms)), F.col("p"))
    per = hits.groupBy("id").agg(
        *(F.max(x).alias(x) for x in ("dl", "first", "last", "section_id")),
        *(F.array_sort(F.collect_set(at(e))).alias(f"w{i}") for i, e in enumerate(found)),
        *(F.min(tier_of(F.col("term"), e)).alias(f"t{i}") for i, e in enumerate(found)),
    )
    per = per.withColumn("tier", _worst([F.col(f"t{i}") for i in range(len(found))])).drop(*(f"t{i}" for i in range(len(found))))
    per = per.withColumn("book_no", book_number(F.col("id"))).withColumn("ordinal", (F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)) - 1).cast("int"))
    return per.join(c.books, "book_no", "left")


def marked(c: Corpus, q: Query, found: list[Expansion]) -> DataFrame:
    """The lines that hold a term of any word, with w0, w1, ... and ``tier``, facets applied."""
    where = facet_filter(q.facets)
    if c.stored is not None and not q.vocalized:
        rows = from_postings(c, found)
        return rows if where is None else rows.where(where)
    tokens, pos = ("voc_tokens", "voc_pos") if q.vocalized else ("tokens", "pos")
    every = sorted({t for e in found for t in e.terms})
    rows = c.lines.where(F.exists(tokens, lambda t: among(t, every)))
    if where is not None:
        rows = rows.where(where)
    rows = rows.select("*", *(places(e, tokens, pos).alias(f"w{i}") for i, e in enumerate(found)), F.size(tokens).alias("_dl"))
    best = [F.array_min(F.transform(tokens, tiers)) for tiers in (_tiers_of(e) for e in found)]
    return rows.withColumn("dl", F.col("_dl")).withColumn("tier", _worst(best)).drop("_dl")


def has(i: int) -> Column:
    return F.size(f"w{i}") > 0


def chain(words: list[Column], gaps: list[int]) -> Column:
    """The places of the last word that an ordered occurrence ends at: each next place lies behind the one before it with
    at most the gap between. The fold keeps all reachable places, so overlapping occurrences can't hide one another."""
    steps = F.array(*(F.struct(w.alias("at"), F.lit(g).alias("gap")) for w, g in zip(words[1:], gaps, strict=True)))
    return F.aggregate(steps, words[0], lambda reach, x: F.filter(x["at"], lambda q: F.exists(reach, lambda p: (p < q) & (p >= q - x["gap"] - 1))))


def tightest(words: list[list[int]], span: int) -> int | None:
    """The shortest window of at most ``span`` that gives every word a place of its own, None if there is none."""
    best = None
    for lo in sorted({p for w in words for p in w}):
        limit = span if best is None else best - 1
        near = [[p for p in w if lo <= p <= lo + limit] for w in words]
        if not all(near):
            continue
        for width in range(len(words) - 1, limit + 1):
            if _assign([[p for p in w if p <= lo + width] for w in near]):
                best = width
                break
    return best


def _assign(words: list[list[int]]) -> bool:
    """Whether the words can take different places (augmenting paths)."""
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for p in words[i]:
            if p not in seen:
                seen.add(p)
                if p not in owner or place(owner[p], seen):
                    owner[p] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(words)))


def window_width(span: int):
    """A pandas UDF over array<array<int>>: the tightest window, null without one. Only candidates that hold all words reach it."""

    @F.pandas_udf(IntegerType())
    def width(s: pd.Series) -> pd.Series:
        return pd.Series([tightest([list(map(int, w)) for w in x], span) for x in s], dtype="Int32")

    return width


def least_window(words: list[Column], span: int) -> Column:
    """The shortest window of at most ``span`` in which every word stands, null without one; for words that share no place,
    which then all have a place of their own. From each place on, the next place of every word tells how far it reaches."""
    starts = F.array_distinct(F.concat(*words))
    reach = F.transform(starts, lambda p: F.array_max(F.transform(F.array(*words), lambda w: F.coalesce(F.array_min(F.filter(w, lambda x: x >= p)), F.lit(_FAR)))) - p)
    best = F.array_min(reach)
    return F.when(best <= span, best)


_FAR = 1 << 30


def in_line(rows: DataFrame, q: Query) -> DataFrame:
    """The marked lines that match within themselves; adds ``span`` for windows in any order (else null)."""
    n = len(q.words)
    rows = rows.withColumn("span", F.lit(None).cast("int"))
    if q.mode != ALL:
        words = [w.word for w in q.words]
        first = [i for i in range(n) if words.index(words[i]) == i]  # a repeated word counts once
        need = min(q.needed(), len(first))
        return rows.where(reduce(lambda a, b: a + b, [has(i).cast("int") for i in first]) >= need)
    rows = rows.where(reduce(lambda a, b: a & b, [has(i) for i in range(n)]))
    if n == 1 or q.scope != WORD_DISTANCE:
        return rows
    if q.any_order is not None:
        span, w = any_order_span(n, q.any_order), [F.col(f"w{i}") for i in range(n)]
        own = reduce(lambda a, b: a & b, [~F.arrays_overlap(w[i], w[j]) for i in range(n) for j in range(i)])
        apart = rows.where(own).withColumn("span", least_window(w, span))
        # words that share a place (equal words, two readings at one place) are matched to places one by one in Python
        shared = rows.where(~own).withColumn("span", window_width(span)(F.array(*w)))
        return apart.unionByName(shared).where("span IS NOT NULL")
    return rows.where(F.size(chain([F.col(f"w{i}") for i in range(n)], q.gaps)) > 0)


def over_line_break(rows: DataFrame, q: Query) -> DataFrame:
    """Lines whose phrase starts in them and ends in the next line of the book.

    Places of the next line are moved behind those of this one, as if both were one line, and the chain has to straddle
    the seam. Enumerators at the seam don't count. Headings and empty lines block. The join is on id + 1.
    """
    n = len(q.words)
    inside = rows.where("first IS NOT NULL AND NOT coalesce(is_heading, false)") if "is_heading" in rows.columns else rows.where("first IS NOT NULL")
    cut = [F.filter(f"w{i}", lambda p: (p >= F.col("first")) & (p <= F.col("last"))).alias(f"w{i}") for i in range(n)]
    side = inside.select("id", "first", "last", "tier", *cut)
    right = side.select((F.col("id") - 1).alias("id"), F.col("first").alias("next_first"), F.col("tier").alias("next_tier"), *(F.col(f"w{i}").alias(f"n{i}") for i in range(n)))
    # ids of one book follow each other; the first line of a book has no line before it under id - 1
    both = side.where(has(0)).join(right.where(F.size(f"n{n - 1}") > 0), "id").where(book_number(F.col("id")) == book_number(F.col("id") + 1))
    joined = [F.concat(f"w{i}", F.transform(f"n{i}", lambda p: p + F.col("last") + 1 - F.col("next_first"))) for i in range(n)]
    joined[0] = F.col("w0")
    ends = chain(joined, q.gaps)
    return both.where(F.exists(ends, lambda p: p > F.col("last"))).select("id", F.greatest("tier", "next_tier").alias("cross_tier"))


def statistics(c: Corpus, vocalized: bool = False) -> tuple[int, float]:
    """Number of lines and their mean length in tokens; a stored corpus knows them."""
    if c.size is not None:
        return c.size
    n, mean = c.lines.agg(F.count("*"), F.avg(F.size("voc_tokens" if vocalized else "tokens"))).first()
    return n, mean or 1.0


def idf(n: int, df: int) -> float:
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(found: list[Expansion], n: int, mean: float) -> Column:
    """BM25 over the words; a word's frequency in a line is the number of its places there."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(mean))
    tf = [F.size(F.filter(f"w{i}", lambda p: p < LAYOUT)) for i in range(len(found))]
    parts = [F.lit(idf(n, min(e.df, n))) * tf[i] * F.lit(K1 + 1) / (tf[i] + norm) for i, e in enumerate(found)]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


@dataclass
class Hits:
    """Matched lines: the columns of the corpus and ``tier``, ``score``, ``span``, ``crosses``."""

    rows: DataFrame
    truncated: bool
    words: list[Expansion]


def search(c: Corpus, q: Query, terms: DataFrame | None = None, score: bool = False) -> Hits:
    """All lines that match, each once. Queries without words match nothing.

    Null texts never match. The expansion is one small job; everything after it is lazy. ``score`` adds BM25, for which
    the corpus statistics are read; without it the score is 0.
    """
    if not q.words:
        return Hits(_empty(c), False, [])
    if q.vocalized:
        c = c if c.stored is None else _vocalized_part(c, q, terms)
        each = c.lines.select(F.explode(F.array_distinct("voc_tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        dictionary = each.select("term", F.col("term").alias("bare"), F.length("term").alias("len"), "df")
        plans = [w if w.vocalized else _over_marks(w) for w in q.words]
    else:
        dictionary, plans = (terms if terms is not None else c.terms()), q.words
    found = expand(dictionary, plans, q.cap)
    truncated = any(e.truncated for e in found)
    rows = marked(c, q, found)
    if score:
        n, mean = statistics(c, q.vocalized)
        rows = rows.withColumn("score", bm25(found, n, mean))
    else:
        rows = rows.withColumn("score", F.lit(0.0))
    if q.scope == SAME_SECTION:
        hits = _in_sections(rows, q)
    else:
        hits = in_line(rows, q)
    hits = hits.withColumn("crosses", F.lit(False))
    if q.crosses() and all(e.terms for e in found):
        over = over_line_break(rows, q)
        single = CROSS_LINE_WEIGHT * sum(idf(n, min(e.df, n)) * (K1 + 1) / (1 + K1) for e in found) if score else 0.0
        extra = rows.join(over.join(hits.select("id"), "id", "left_anti"), "id")
        extra = extra.withColumn("tier", F.col("cross_tier")).withColumn("score", F.lit(float(single))).withColumn("span", F.lit(None).cast("int")).withColumn("crosses", F.lit(True))
        hits = hits.unionByName(extra.select(*hits.columns))
    if q.negative is not None and q.negative.words:
        hits = without(c, hits, q.negative, terms)
    return Hits(hits, truncated, found)


def _vocalized_part(c: Corpus, q: Query, terms: DataFrame | None) -> Corpus:
    """The lines that hold the plain form of any word, found by postings, with their vocalized tokens: all that a search by
    marks has to look at. A word with marks can only stand where its letters do."""
    plain = [plan_word(w.word) if w.vocalized else w for w in q.words]
    rows = marked(c, Query(plain, facets=q.facets), expand(terms if terms is not None else c.terms(), plain, q.cap))
    if q.mode == ALL and q.scope != SAME_SECTION:
        rows = rows.where(reduce(lambda a, b: a & b, [has(i) for i in range(len(plain))]))
    lines = c.wide().join(rows.select("id"), "id", "left_semi")
    t = F.col("vocalized") if "vocalized" in lines.columns else F.col("plain")
    x = T.placed_tokens(F.coalesce(t, F.col("plain")))
    lines = lines.withColumn("_x", x).withColumn("voc_tokens", F.col("_x.t")).withColumn("voc_pos", F.col("_x.p")).drop("_x")
    return Corpus(cut(lines), size=c.size)


def _over_marks(w: WordPlan) -> WordPlan:
    """A plain word on the vocalized dictionary: any marks may stand in it."""
    from quire.functions.words import Branch, vocalized_pattern

    return WordPlan(w.word, [Branch(vocalized_pattern(w.word, False, False), EXACT, False), *w.branches], True)


def _empty(c: Corpus) -> DataFrame:
    none = F.lit(None)
    rows = c.lines if c.stored is None else from_postings(c, []).drop("tier")
    return rows.limit(0).select("*", none.cast("int").alias("tier"), none.cast("double").alias("score"), none.cast("int").alias("span"), none.cast("boolean").alias("crosses"))


def _in_sections(rows: DataFrame, q: Query) -> DataFrame:
    """Lines with any of the words in sections that cover enough of them. The sections are found with partial sums of one
    bit a word, so the size of a section doesn't matter."""
    n = len(q.words)
    words = [w.word for w in q.words]
    first = [i for i in range(n) if words.index(words[i]) == i]
    need = min(q.needed(), len(first)) if q.mode != ALL else len(first)
    cover = rows.groupBy("section_id").agg(*(F.max(has(i).cast("int")).alias(f"h{i}") for i in first))
    good = cover.where(reduce(lambda a, b: a + b, [F.col(f"h{i}") for i in first]) >= need).select("section_id")
    return rows.join(good, "section_id", "left_semi").withColumn("span", F.lit(None).cast("int"))


def without(c: Corpus, hits: DataFrame, negative: Query, terms: DataFrame | None = None) -> DataFrame:
    """Hits that a second full query doesn't match; with section scope, that lie in no section it covers."""
    other = search(c, Query(**{**negative.__dict__, "cross_line": False}), terms).rows
    key = "section_id" if negative.scope == SAME_SECTION else "id"
    return hits.join(other.select(key).distinct(), key, "left_anti").select(*hits.columns)


# -- order, pages, groups -------------------------------------------------------------------------------------------------


def order_keys(order: str) -> list[Column]:
    """Sort keys; books without a place in the mapping come last, by number. Ties never remain."""
    cat = [F.col("catalogue_order").asc_nulls_last(), F.col("book_no").asc(), F.col("id").asc()]
    if order == CATALOGUE:
        return cat
    if order == GENERATION:
        return [F.col("generation_order").asc_nulls_last(), *cat]
    if order == RELEVANCE:
        return [F.col("tier").asc(), F.round("score", 9).desc(), F.col("span").asc_nulls_last(), *cat]
    raise ValueError(f"unknown order {order!r}")


def page(hits: DataFrame, order: str = CATALOGUE, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of hits: a top-k of each task, merged."""
    return hits.orderBy(*order_keys(order)).offset(offset).limit(limit)


def count_by_book(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_path").agg(F.count("*").alias("count"))


def group_key(grouping: str) -> Column:
    """Lines of one section, or of one text; lines without a signature stay by themselves."""
    if grouping == SAME_SECTION_GROUPS:
        return F.struct(F.lit(0).alias("kind"), F.coalesce("section_id", "id").alias("key"))
    if grouping == IDENTICAL_TEXT:
        return F.struct((F.col("line_hash") == 0).cast("int").alias("kind"), F.when(F.col("line_hash") == 0, F.col("id")).otherwise(F.col("line_hash")).alias("key"))
    raise ValueError(f"unknown grouping {grouping!r}")


def grouped(hits: DataFrame, grouping: str, order: str = CATALOGUE) -> DataFrame:
    """One row per group: the best hit with ``merged_count`` and up to ten ``siblings`` (their ids, best first).

    Counts are partial sums; the best eleven are found by a limit per group before the shuffle, so a group of any size
    sends at most eleven rows a task.
    """
    keyed = hits.withColumn("group_key", group_key(grouping))
    size = keyed.groupBy("group_key").agg(F.count("*").alias("merged_count"))
    top = keyed.withColumn("nth", F.row_number().over(W.partitionBy("group_key").orderBy(*order_keys(order)))).where(F.col("nth") <= SIBLINGS + 1)
    rest = top.where("nth > 1").groupBy("group_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("siblings"))
    best = top.where("nth = 1").drop("nth").join(size, "group_key").join(rest, "group_key", "left")
    return best.withColumn("siblings", F.coalesce("siblings", F.array().cast("array<bigint>"))).drop("group_key")


def chunks(rows: DataFrame, size: int) -> Iterator[list]:
    """Ranked rows in chunks, fetched partition by partition."""
    if size < 1:
        raise ValueError("a chunk has at least one row")
    held = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held

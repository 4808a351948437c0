"""The engine's public face: books in, searches, counts, pages and streams out."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import display
from quire.functions import text as T
from quire.functions.words import EXACT, MAX_TERMS_PLAIN, OTHER, Branch, WordOptions, WordPlan, options_at, plan_word, resolve_gaps, split_words
from quire.operators import lexicons, regexes, vectors
from quire.operators.corpus import BOOK_SHIFT, POSTING, SECTION_MASK, TERM, Corpus, book_number, books_of, clustered, counts_of, postings_of, size_of, with_tokens
from quire.operators.incremental import VersionedTable, process_new
from quire.operators.search import ALL, CATALOGUE, IDENTICAL_TEXT, RELEVANCE, WORD_DISTANCE, Hits, Query, attached, count_by_book, facet_counts, facet_filter, grouped, page, search
from quire.session import BROADCAST_ROWS, cut, small
from quire.sources import books
from quire.sources.store import Store, compatibility, difference
from quire.streaming import results


@dataclass
class Page:
    """A page with the number of all hits, of groups where there are any, and whether a ceiling cut terms off."""

    rows: DataFrame
    total: int
    truncated: bool
    groups: int | None = None


@dataclass
class SemanticSession:
    """A frozen ranking of a semantic search, why its semantic half is missing (if it is), and whether it starts anew
    because the content changed since the session before."""

    engine: SearchEngine
    state: tuple
    ranked: list
    reason: str | None
    restarted: bool

    @property
    def total(self) -> int:
        return len(self.ranked)

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """Rows ``offset`` and on, with the columns of their lines, in order."""
        rows = [(i, r.id, r.score, r.source, r.merged_count, list(r.siblings)) for i, r in enumerate(self.ranked[offset : offset + limit], offset)]
        at = self.engine.spark.createDataFrame(rows, "rank int, id long, score double, source string, merged_count long, siblings array<long>")
        return _by_ids(self.engine.corpus().lines, [r[1] for r in rows]).join(F.broadcast(at), "id").orderBy("rank")


@dataclass
class Count:
    count: int
    truncated: bool


class SearchEngine:
    """Searches over a stored corpus. Results are DataFrames; the query families share their arguments.

    An empty query, or one of signs only, matches nothing. Searches see the last commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store, self.path = spark, Store(spark, path), path
        index = lambda name, ddl, key: VersionedTable(spark, f"{path}/index/{name}", StructType.fromDDL(ddl), key)
        self._postings, self._counts = index("postings", POSTING, "id"), index("terms", TERM, "term")
        self._corpus: tuple[tuple[int, int], Corpus] | None = None
        self._pages: OrderedDict[tuple, _Ranked] = OrderedDict()
        self._morphology = self._translations = self._acronyms = self._blacklist = None
        self._vector_sets = VersionedTable(spark, f"{path}/vectors", StructType.fromDDL("key string, embedding array<double>"), "key")
        self._sessions: OrderedDict[tuple, SemanticSession] = OrderedDict()
        self._sources: dict[str, DataFrame | None] = {}

    # -- books in -------------------------------------------------------------------------------------------------------

    def add_text_books(self, rows: DataFrame) -> int:
        """Stage whole books (sources.books.BOOK); returns how many lines."""
        return self.store.add(books.text_books(rows))

    def add_text_book(self, title: str, topics: str, file_path: str, text: str | bytes, extra_facets: Sequence[str] = (), source_hash: int = 0) -> int:
        body = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
        return self.add_text_books(self.spark.createDataFrame([(file_path, title, topics, body, list(extra_facets), source_hash)], books.BOOK))

    def add_pdf_book(self, title: str, topics: str, file_path: str, pages: Sequence[tuple[str, str, int]], extra_facets: Sequence[str] = ()) -> int:
        """Stage a scanned book of (reference, text, page index); returns how many pages."""
        rows = self.spark.createDataFrame([(file_path, title, topics, r, t, i) for r, t, i in pages], books.PAGE).withColumn("extra_facets", F.array(*map(F.lit, extra_facets)).cast("array<string>"))
        return self.store.add(books.pdf_books(rows))

    def add_pdf_book_bytes(self, title: str, topics: str, file_path: str, data: bytes, offsets: Sequence[int], references: Sequence[str], extra_facets: Sequence[str] = ()) -> int:
        """The same with all pages in one string of bytes; offsets are checked before anything is staged."""
        ends = [*offsets, len(data)]
        if len(offsets) != len(references) or list(ends) != sorted(ends) or (offsets and offsets[0] != 0):
            raise ValueError("page offsets don't fit the data")
        pages = [(r, data[a:b].decode("utf-8", "replace"), i) for i, (r, a, b) in enumerate(zip(references, ends, ends[1:], strict=False))]
        return self.add_pdf_book(title, topics, file_path, pages, extra_facets)

    def add_documents_batch(self, rows: DataFrame) -> int:
        """Stage single lines (corpus.INPUT), as they are."""
        return self.store.add(books.documents(rows))

    add_document = add_documents_batch

    def add_library_books(self, requests: DataFrame, rows: DataFrame, available: DataFrame) -> DataFrame:
        """Stage a batch from line sources; returns the status of each book in the order asked for."""
        lines, status = books.library_books(requests, rows, available)
        self.store.add(lines)
        return status

    def upsert_documents_batch(self, rows: DataFrame) -> int:
        return self.store.upsert(books.documents(rows))

    upsert_document = upsert_documents_batch

    def delete_document_by_id(self, id_: int) -> None:
        self.store.delete(ids=[id_])

    def delete_documents_by_file_paths(self, paths: Sequence[str]) -> None:
        self.store.delete(file_paths=list(paths))

    def delete_documents_by_file_path(self, path: str) -> None:
        self.store.delete(file_paths=[path])

    def remove_documents_by_title(self, title: str) -> None:
        self.store.delete(titles=[title])

    def clear(self) -> None:
        self.store.clear()

    def commit(self) -> int:
        """Publish what is staged, and bring the index up to it: only lines that came or went are read for that."""
        version = self.store.commit()
        self._update_index()
        return version

    def _update_index(self) -> None:
        table = self.store.table
        process_new(table, self._postings, lambda d: (clustered(postings_of(_tokenized(d.added))), d.removed.select("id")))
        process_new(table, self._counts, lambda d: (counts_of(_tokenized(d.added)).unionByName(counts_of(_tokenized(d.removed), -1)).sortWithinPartitions("term"), None))

    def rollback(self) -> None:
        self.store.rollback()

    def optimize(self) -> int:
        return self.store.compact()

    def get_segment_count(self) -> int:
        return self.store.file_count()

    def open_index_writer(self) -> None:
        """Writers need no opening here; nor closing, memory modes or release."""

    close_index_writer = release_memory = set_bulk_indexing = set_economy_indexing = lambda self, *_: None

    def set_book_order(self, order: DataFrame) -> int:
        """Replace the mapping of books to catalogue and generation order; returns its revision, which grows only on a change.
        The mapping is stored; an engine opened later has it."""
        return self.store.set_order(order)

    def book_order_revision(self) -> int:
        return int(self.store.table.manifest().meta.get("order_revision", 0))

    def search_snapshot(self) -> tuple:
        """What identifies results: content, order, dictionaries and line sources."""
        return (*self.store.snapshot(), *map(id, (self._morphology, self._translations, self._acronyms, self._blacklist)), tuple(sorted((k, id(v)) for k, v in self._sources.items())))

    def warm_book_order(self) -> None:
        self.corpus()

    def check_index_compatibility(self) -> str:
        return compatibility(self.spark, self.path)

    # -- what is stored -----------------------------------------------------------------------------------------------------

    def corpus(self) -> Corpus:
        """The committed lines with their index, dictionary and books; opened anew when the snapshot changes."""
        now = self.store.snapshot()
        if self._corpus is None or self._corpus[0] != now:
            self._update_index()
            lines = _with_sections(self.store.lines())
            books = cut(books_of(lines, self.store.order()))
            self._corpus = (now, Corpus(lines, self._postings.read(), self._counts.read(), small(books), size_of(lines)))
        return self._corpus[1]

    def terms(self) -> DataFrame:
        return self.corpus().terms()

    def get_documents_by_ids(self, ids: Sequence[int]) -> DataFrame:
        """The lines with these ids, found by the statistics of the files; unknown ids give none."""
        return _by_ids(self.store.lines(), ids)

    def neighbour(self, id_: int, step: int = 1) -> DataFrame:
        """The line ``step`` places behind (or before) a line in its book."""
        same = (id_ + step) >> BOOK_SHIFT == id_ >> BOOK_SHIFT
        return self.get_documents_by_ids([id_ + step] if same else [])

    def get_document_by_id(self, id_: int) -> DataFrame:
        return self.store.lines().where(F.col("id") == id_)

    def get_document_count(self) -> int:
        return self.store.lines().count()

    def get_indexed_file_paths(self) -> DataFrame:
        return self.store.lines().select("file_path").distinct()

    def count_documents_by_file_path(self) -> DataFrame:
        return count_by_book(self.store.lines())

    def get_book_stamps(self) -> DataFrame:
        return books.stamps(self.store.lines())

    def get_book_fingerprints(self) -> DataFrame:
        return self.get_book_stamps().select("file_path", "content_hash")

    def get_book_text_fingerprints(self) -> DataFrame:
        return self.get_book_stamps().select("file_path", "text_hash")

    def get_book_text_fingerprint(self, file_path: str) -> int:
        r = self.get_book_text_fingerprints().where(F.col("file_path") == file_path).first()
        return r.text_hash if r else 0

    # -- dictionaries and line sources ----------------------------------------------------------------------------------------

    def set_magic_dictionary(self, m: lexicons.Morphology | str | None, blacklist: DataFrame | None = None) -> bool:
        self._morphology = lexicons.load_morphology(self.spark, m) if isinstance(m, str) else m
        self._blacklist = blacklist
        return self._morphology is not None

    def set_translation_dictionary(self, t: DataFrame | str | None) -> bool:
        rows = lexicons.load_json(self.spark, t, "translation") if isinstance(t, str) else t
        self._translations = lexicons.translation_pairs(rows) if rows is not None else None
        return rows is not None

    def set_acronyms_dictionary(self, a: DataFrame | str | None) -> bool:
        self._acronyms = lexicons.load_json(self.spark, a, "acronym") if isinstance(a, str) else a
        return self._acronyms is not None

    def has_magic_dictionary(self) -> bool:
        return self._morphology is not None

    def has_translation_dictionary(self) -> bool:
        return self._translations is not None

    def has_acronyms_dictionary(self) -> bool:
        return self._acronyms is not None

    def configure_line_source(self, name: str, rows: DataFrame) -> None:
        """Rows (book_id, line_index, content) that show the text of hits; names are ``library``, ``user`` or attached slugs."""
        self._sources[name] = rows

    def suspend_line_source(self, name: str) -> None:
        self._sources[name] = None

    def line_source_status(self) -> dict[str, str]:
        return {k: "ready" if v is not None else "suspended" for k, v in self._sources.items()}

    # -- queries ---------------------------------------------------------------------------------------------------------------

    def exact_query(self, query: str, facets: Sequence[str] = (), match_nikud: bool = False, match_taamim: bool = False) -> list[Query]:
        voc = match_nikud or match_taamim
        words = split_words(query, voc)
        plans = [plan_word(w, WordOptions(nikud=match_nikud, taamim=match_taamim)) for w in words]
        return [Query(plans, [0] * (len(words) - 1), facets=list(facets))]

    def fuzzy_query(self, query: str, facets: Sequence[str] = (), max_distance: int = 2, terms: Sequence[str] | None = None) -> list[Query]:
        """Words within an edit distance of 0 to 2, all in the line; quoted ones adjacent, in order, with one word between at most."""
        if not 0 <= max_distance <= 2:
            raise vectors.SearchError("invalidDistance", "the distance is 0, 1 or 2")
        words = list(terms) if terms is not None else split_words(query)
        plans = [WordPlan(w, fuzzy=max_distance) for w in words]
        if self._morphology is not None and words:
            plans = self._with_forms(plans)
        q = Query(plans, [10_000] * (len(words) - 1), scope="sameParagraph", facets=list(facets), cross_line=False)
        return [q]

    def _with_forms(self, plans: list[WordPlan]) -> list[WordPlan]:
        """Words with the forms of the morphology between the typed form and the edit distance, all under one ceiling."""
        forms: dict[str, list[str]] = {}
        for r in self._morphology.forms([p.word for p in plans]).collect():
            forms.setdefault(r.word, []).append(r.form)
        out = []
        for p in plans:
            known = forms.get(p.word, [])
            branches = [Branch(f"(?:{'|'.join(known)})", 1)] if known else []
            # forms are kept without final letters, so terms are compared in that shape too
            branches += [Branch("".join(_final_class(c) for c in f), 1) for f in known]
            out.append(replace(p, branches=branches))
        return out

    def advanced_query(
        self, query: str, negative_query: str = "", facets: Sequence[str] = (), distance: int = 0, negative_distance: int = 0, custom_spacing: dict[str, str] | None = None,
        negative_custom_spacing: dict[str, str] | None = None, alternative_words: dict[int, list[str]] | None = None, negative_alternative_words: dict[int, list[str]] | None = None,
        search_options: dict[str, dict[str, bool]] | None = None, negative_search_options: dict[str, dict[str, bool]] | None = None, match_nikud: bool = False, match_taamim: bool = False,
        scope: str = WORD_DISTANCE, negative_scope: str = WORD_DISTANCE, word_match_mode: str = ALL, word_match_count: int | None = None, any_order: bool = False, **every: bool,
    ) -> list[Query]:
        """The planned query and, for acronyms, its other wordings; ``every`` sets options for all words (prefix, typo, ...)."""
        voc = match_nikud or match_taamim
        words = split_words(query, voc)
        base = {**every, "nikud": match_nikud, "taamim": match_taamim}
        chosen = [options_at(search_options, w, i, alternative_words, **base) for i, w in enumerate(words)]
        if self._translations is not None and any(o.translation for o in chosen):
            more = lexicons.translated(self._translations, [w for w, o in zip(words, chosen, strict=True) if o.translation])
            chosen = [replace(o, alternatives=(*o.alternatives, *more.get(w, ()))) if o.translation else o for w, o in zip(words, chosen, strict=True)]
        negative = None
        if negative_query.strip():
            negative = self.advanced_query(negative_query, distance=negative_distance, custom_spacing=negative_custom_spacing, alternative_words=negative_alternative_words, search_options=negative_search_options, scope=negative_scope)[0]
        order = distance if any_order and not custom_spacing else None
        q = Query([plan_word(w, o) for w, o in zip(words, chosen, strict=True)], resolve_gaps(len(words), distance, custom_spacing), order, scope, word_match_mode, word_match_count, list(facets), negative)
        out = [q]
        for i, o in enumerate(chosen):  # alternatives of several words are wordings of their own
            for other in (split_words(a) for a in o.alternatives):
                if len(other) > 1:
                    out.append(replace(q, words=[*q.words[:i], *map(plan_word, other), *q.words[i + 1 :]], gaps=[*q.gaps[:i], *[0] * (len(other) - 1), *q.gaps[i:]]))
        if self._acronyms is not None and any(o.acronym for o in chosen):
            for other in lexicons.acronym_queries(self._acronyms, words):
                out.append(replace(q, words=[plan_word(w) for w in other], gaps=resolve_gaps(len(other), distance)))
        return out

    def regex_query(self, regex_terms: Sequence[str], facets: Sequence[str] = (), slop: int = 0, max_expansions: int = MAX_TERMS_PLAIN) -> list[Query]:
        """Whole-term patterns, in order with at most ``slop`` words between."""
        return [Query([WordPlan(r, [Branch(r, EXACT)]) for r in regex_terms], [slop] * (len(regex_terms) - 1), facets=list(facets), cap=max_expansions)]

    def smart_query(self, query: str, facets: Sequence[str] = (), fuzzy_max_distance: int = 0) -> list[Query]:
        """Quoted parts are phrases that must stand together; the other words may stand anywhere in the line."""
        parts = quoted(query)
        out = []
        for phrase in parts[0]:
            out.append(Query([plan_word(w) for w in phrase], [0] * (len(phrase) - 1), facets=list(facets), cross_line=False))
        if parts[1]:
            plans = [WordPlan(w, fuzzy=fuzzy_max_distance) if fuzzy_max_distance else _aliased(w) for w in parts[1]]
            out.append(Query(plans, [0] * (len(plans) - 1), scope="sameParagraph", facets=list(facets), cross_line=False))
        return out

    # -- running them ------------------------------------------------------------------------------------------------------------

    def hits(self, queries: list[Query], score: bool = False) -> Hits:
        """All lines that any of the queries matches, each once, with its best tier and score."""
        c, terms = self.corpus(), self.terms()
        found = [search(c, q, terms, score) for q in queries]
        out = found[0]
        for h in found[1:]:
            names = ["id", "tier", "score", "span", "crosses"]
            both = out.rows.select(*names).unionByName(h.rows.select(*names))
            best = both.groupBy("id").agg(F.min("tier").alias("tier"), F.max("score").alias("score"), F.min("span").alias("span"), F.min("crosses").alias("crosses"))
            out = Hits(both_rows(c, best), out.truncated or h.truncated, out.words + h.words)
        return out

    def all_of(self, queries: list[Query], score: bool = False) -> Hits:
        """Lines that every query matches; scores add up."""
        c, terms = self.corpus(), self.terms()
        if not queries:
            return search(c, Query([]), terms)
        found = [search(c, q, terms, score) for q in queries]
        rows = found[0].rows
        for h in found[1:]:
            rows = rows.drop(*[x for x in rows.columns if x.startswith("w") and x[1:].isdigit()]).join(h.rows.select("id", F.col("score").alias("_s"), F.col("tier").alias("_t")), "id")
            rows = rows.withColumn("score", F.col("score") + F.col("_s")).withColumn("tier", F.greatest("tier", "_t")).drop("_s", "_t")
        return Hits(rows, any(h.truncated for h in found), [e for h in found for e in h.words])

    def fuzzy_hits(self, query: str, facets: Sequence[str] = (), max_distance: int = 2, score: bool = False) -> Hits:
        """Fuzzy words all in the line; words inside quotes in their order with at most one word between."""
        phrases, rest = quoted(query)
        if not phrases:
            return self.hits(self.fuzzy_query(query, facets, max_distance), score)
        parts = []
        for p in phrases:
            q = self.fuzzy_query("", facets, max_distance, p)[0]
            parts.append(replace(q, scope=WORD_DISTANCE, gaps=[1] * (len(p) - 1)))
        if rest:
            parts += self.fuzzy_query("", facets, max_distance, rest)
        return self.all_of(parts, score)

    def _run(self, family: str, query, facets: Sequence[str] = (), score: bool = False, **args) -> Hits:
        if family == "exact":
            return self.hits(self.exact_query(query, facets, **args), score)
        if family == "fuzzy":
            return self.fuzzy_hits(query, facets, score=score, **args)
        if family == "fuzzy_terms":
            return self.hits(self.fuzzy_query("", facets, args.get("max_distance", 2), [T.fold_word(t) for t in query]), score)
        if family == "advanced":
            return self.hits(self.advanced_query(query, facets=facets, **args), score)
        if family == "regex":
            return self.hits(self.regex_query(query, facets, **args), score)
        if family == "user_regex":
            return regexes.matched(self.corpus(), query, list(facets), self.terms())
        if family == "smart":
            return self.all_of(self.smart_query(query, facets, args.get("fuzzy_max_distance", 0)), score)
        raise ValueError(f"unknown family {family!r}")

    def search(self, family: str, query, facets: Sequence[str] = (), limit: int = 100, offset: int = 0, order: str = CATALOGUE, grouping: str | None = None, highlight: bool = True, **args) -> Page:
        """A page of a query family: rows in their order, numbered by ``rank``, with ``text`` (the painted snippet), the
        number of all hits, and of groups. Pages of one query share its ranked hits (see _ranked)."""
        key = (family, _frozen(query), tuple(facets), order, grouping, _frozen(args), self.search_snapshot())
        r = self._ranked(key, lambda: self._run(family, query, facets, order == RELEVANCE, **args), order, grouping, offset + limit)
        rows = r.window[offset : offset + limit]
        return Page(self._shown(rows, r.hits, args if highlight else None), r.total, r.hits.truncated, r.groups)

    def _ranked(self, key: tuple, run, order: str, grouping: str | None, need: int) -> _Ranked:
        """The first hits of a query in order and how many there are: the page asked for and three more, at most
        ``WINDOW`` rows (more only where a page lies behind them), kept for the last ``WINDOWS`` queries."""
        got = self._pages.get(key)
        if got is None or len(got.window) < min(need, got.all):
            h = run()
            rows, groups = h.rows, None
            names = [c for c in ("id", "tier", "score", "span", "crosses") if c in rows.columns]
            if grouping:
                if grouping == IDENTICAL_TEXT:
                    rows = attached(self.corpus(), rows, "line_hash")
                rows = grouped(rows, grouping, order)
                names += ["merged_count", "siblings"]
            rows = rows.select(*names, *(c for c in ("book_no", "catalogue_order", "generation_order") if c in rows.columns)).persist()
            try:
                n = rows.count()
                total = int(rows.agg(F.sum("merged_count")).first()[0] or 0) if grouping else n
                groups = n if grouping else None
                window = page(rows, order, max(need, min(need * 4, WINDOW))).select(*names).collect()
            finally:
                rows.unpersist()
            got = _Ranked(h, window, total, groups, n)
            self._pages[key] = got
            while len(self._pages) > WINDOWS:
                self._pages.popitem(last=False)
        self._pages.move_to_end(key)
        return got

    def _shown(self, rows: list, h: Hits, args: dict | None) -> DataFrame:
        """Ranked rows with the columns of their lines, which are looked up by id, in order."""
        c = self.corpus()
        ranked = [(i, r.id, r.tier, float(r.score), r.span, r.crosses, r.merged_count if "merged_count" in r else 1, list(r.siblings) if "siblings" in r else []) for i, r in enumerate(rows)]
        at = F.broadcast(self.spark.createDataFrame(ranked, "rank int, id long, tier int, score double, span int, crosses boolean, merged_count long, siblings array<long>"))
        near = [r.id for r in rows] + [r.id + 1 for r in rows if r.crosses]
        lines = Corpus(_by_ids(c.lines, near), books=c.books).wide()
        out = lines.join(at, "id")
        if args is not None:
            out = self._painted(out, lines, h, args)
        return self._with_source_rows(out).orderBy("rank")

    def _with_source_rows(self, rows: DataFrame) -> DataFrame:
        """Rows of a page with the rows of their line sources: ``row_text``, and ``text_status``: ok, stale or unavailable, null
        where no source is configured. Books of the library are ``id:N``, of users ``uid:N``, attached ones ``db:slug:N``."""
        if not self._sources:
            return rows.withColumn("row_text", F.lit(None).cast("string")).withColumn("text_status", F.lit(None).cast("string"))
        part = F.split("file_path", ":")
        kind = F.when(part[0] == "id", "library").when(part[0] == "uid", "user").when(part[0] == "db", F.get(part, F.lit(1)))
        at = rows.withColumn("_source", kind).withColumn("book_id", F.element_at(part, -1).try_cast("long"))
        live = [k for k, v in self._sources.items() if v is not None]
        away = at.where(~F.coalesce(F.col("_source").isin(live), F.lit(False)))
        out = away.withColumn("row_text", F.col("plain")).withColumn("text_status", F.lit("unavailable"))
        for name in live:
            out = out.unionByName(books.displayed(at.where(F.col("_source") == name), self._sources[name]))
        return out.drop("_source", "book_id")

    def _painted(self, rows: DataFrame, lines: DataFrame, h: Hits, args: dict) -> DataFrame:
        bare = [{re.sub(f"[{T.MARKS}]", "", t) for t in e.terms} for e in h.words]
        words = [frozenset(b) | frozenset(re.sub("['\"]", "", t) for t in b) for b in bare]
        n = len(words)
        flat = args.get("scope", WORD_DISTANCE) != WORD_DISTANCE or args.get("word_match_mode", ALL) != ALL or "max_distance" in args
        gaps = None if flat else resolve_gaps(n, args.get("distance", args.get("slop", 0)), args.get("custom_spacing"))
        paint = display.Paint(words, gaps)
        if args.get("any_order") and not args.get("custom_spacing"):
            paint = display.Paint(words, None, (n - 1) * (args.get("distance", 0) + 1))
        nxt = lines.select((F.col("id") - 1).alias("id"), F.col("plain").alias("_next"))
        both = rows.join(F.broadcast(nxt), "id", "left").withColumn("_next", F.when(F.col("crosses"), F.col("_next")))
        text = display.page_snippets(paint)("plain", "_next", F.coalesce("vocalized", "plain"), F.coalesce("is_pdf", F.lit(False)))
        return both.withColumn("text", text).drop("_next").withColumn("continues_to_next_line", F.col("crosses"))

    def count(self, family: str, query, facets: Sequence[str] = (), **args) -> int:
        return self._run(family, query, facets, **args).rows.count()

    def count_with_status(self, family: str, query, facets: Sequence[str] = (), **args) -> Count:
        h = self._run(family, query, facets, **args)
        return Count(h.rows.count(), h.truncated)

    def count_by_book(self, family: str, query, facets: Sequence[str] = (), **args) -> DataFrame:
        return count_by_book(self._run(family, query, facets, **args).rows)

    def get_facet_counts(self, family: str, query, facet_prefix: str = "/", facets: Sequence[str] = (), **args) -> DataFrame:
        return facet_counts(self._run(family, query, facets, **args).rows, facet_prefix)

    def stream(self, family: str, query, chunk_size: int = 50, **args) -> Iterator[list]:
        return results.stream(self.search(family, query, **args).rows, chunk_size)

    def stream_with_counts(self, family: str, query, chunk_size: int = 50, **args) -> Iterator[results.Update]:
        p = self.search(family, query, **args)
        yield results.Update(total=p.total, truncated=p.truncated)
        for rows in results.stream(p.rows, chunk_size):
            yield results.Update(rows=rows)

    # the families under their own names

    def search_exact(self, query: str, **args) -> Page:
        return self.search("exact", query, **args)

    def search_fuzzy(self, query: str, **args) -> Page:
        return self.search("fuzzy", query, **args)

    def search_fuzzy_terms(self, terms: Sequence[str], **args) -> Page:
        return self.search("fuzzy_terms", terms, **args)

    def search_advanced(self, query: str, **args) -> Page:
        return self.search("advanced", query, **args)

    def search_regex(self, regex_terms: Sequence[str], **args) -> Page:
        return self.search("regex", regex_terms, **args)

    def search_smart_lexical(self, query: str, **args) -> Page:
        return self.search("smart", query, **args)

    def search_user_regex(self, raw: str, **args) -> Page:
        return self.search("user_regex", raw, highlight=False, **args)

    def search_user_regex_stream(self, raw: str, facets: Sequence[str] = (), chunk_size: int = 50) -> Iterator[results.Update]:
        """Every matching line, without a ceiling."""
        return results.stream_by_books(regexes.matched(self.corpus(), raw, list(facets), self.terms()).rows, chunk_size)

    def cancel_lexical_search(self, request: str) -> None:
        results.cancel(self.spark, request)

    # -- semantic search -------------------------------------------------------------------------------------------------------------

    def install_semantic_vectors(self, vectors_: DataFrame, delta: bool = False, tombstones: DataFrame | None = None) -> int:
        """Store a vector set (key, embedding), or a delta over the one that is installed: its keys replace those of the set,
        ``tombstones`` (key) remove some. Of rows that repeat a key one counts. Returns the version; the set before stays and
        can be gone back to."""
        rows = vectors_.select(F.lower("key").alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).where("key IS NOT NULL").dropDuplicates(["key"])
        if not (delta and self._has_vectors()):
            return self._vector_sets.commit(rows, replace=True, meta={"on": True})
        gone = rows.select("key") if tombstones is None else rows.select("key").unionByName(tombstones.select(F.lower("key").alias("key")))
        return self._vector_sets.commit(rows, gone, meta={"on": True})

    def _has_vectors(self) -> bool:
        m = self._vector_sets.manifest()
        return bool(m.meta.get("on") and m.files)

    def _vectors(self) -> DataFrame:
        if not self._has_vectors():
            raise vectors.SearchError("notConfigured", "no vectors are installed")
        return self._vector_sets.read()

    def compact_semantic_vectors(self) -> int:
        """Rewrite the set without its deltas."""
        return self._vector_sets.commit(self._vectors(), rewrite=True)

    def restore_semantic_generation(self, version: int | None = None) -> int:
        """Go back to an earlier set, by default the one before the latest; as a new version, nothing is lost."""
        now = self._vector_sets.manifest()
        back = self._vector_sets.manifest(now.version - 1 if version is None else version)
        return self._vector_sets.publish(replace(back, version=now.version + 1, rewrites=now.rewrites, replaced=[*now.replaced, now.version + 1]))

    def retire_previous_semantic_generation(self) -> int:
        """Delete the stored files that only earlier sets need; they can't be gone back to any more. Returns how many."""
        return self._vector_sets.vacuum()

    def disable_semantic(self) -> None:
        """Switch semantic search off; the stored set stays."""
        if self._has_vectors():
            self._vector_sets.commit(meta={"on": False})

    def enable_semantic(self) -> None:
        if self._vector_sets.manifest().files:
            self._vector_sets.commit(meta={"on": True})

    def reset_semantic_index(self) -> None:
        """Remove all vectors."""
        self._vector_sets.commit(replace=True, meta={"on": False})

    def semantic_vectors_info(self) -> DataFrame | None:
        return vectors.info(self._vectors()) if self._has_vectors() else None

    def verify_semantic_vectors(self, checksum: int) -> bool:
        info = self.semantic_vectors_info()
        return info is not None and info.first().checksum == checksum

    def semantic_status(self) -> str:
        return "ready" if self._has_vectors() else "notConfigured"

    def semantic_coverage(self, keys: DataFrame) -> DataFrame:
        """Per book: lines with a text key (id, file_path, key), and those with a vector."""
        return vectors.coverage(keys, self._vectors())

    def semantic_index_diff(self, keys: DataFrame) -> DataFrame:
        """Keys to embed (``added``) and vectors nothing refers to any more (``removed``)."""
        have = self._vectors().select("key").distinct()
        return difference(have.withColumn("v", F.lit(1)), keys.select("key").where("key IS NOT NULL").distinct().withColumn("v", F.lit(1)), "key", "v")

    def remove_semantic_books(self, keys: DataFrame, file_paths: Sequence[str]) -> None:
        """Drop the vectors whose key stands only in these books."""
        gone = keys.where(F.col("file_path").isin(list(file_paths))).select("key").join(keys.where(~F.col("file_path").isin(list(file_paths))).select("key"), "key", "left_anti")
        self._vector_sets.commit(deleted_keys=gone.distinct())

    def search_semantic(
        self, query: str, vector: Sequence[float] | None, keys: DataFrame, facets: Sequence[str] = (), limit: int = 100, offset: int = 0, mode: str = vectors.HYBRID, ranking: vectors.Ranking | None = None, lexical: str = "exact", candidates: int = 1000,
    ) -> tuple[DataFrame, str | None]:
        """Fused rows and, if the semantic half is missing, the reason; a purely semantic search then is an error."""
        fused, reason = self._fused(query, vector, keys, facets, mode, ranking or vectors.Ranking(), lexical, candidates)
        shown = fused.orderBy(F.col("score").desc(), "id").offset(offset).limit(limit)
        return shown.join(self.corpus().lines.select("id", "file_path", "plain"), "id").orderBy(F.col("score").desc(), "id"), reason

    def _fused(self, query: str, vector: Sequence[float] | None, keys: DataFrame, facets: Sequence[str], mode: str, r: vectors.Ranking, lexical: str, candidates: int) -> tuple[DataFrame, str | None]:
        """The fused ranking of at most ``candidates`` rows of each half. Where foundational books get a bonus, a second search
        among their vectors alone adds candidates, so that the bonus can reach rows that all books' vectors would push out."""
        reason = None if self._has_vectors() and vector is not None else "notConfigured"
        if mode == vectors.SEMANTIC_ONLY and reason:
            raise vectors.SearchError(reason, "semantic search is not available")
        lines = self.corpus().wide()
        where = facet_filter(list(facets))
        if where is not None:
            lines = lines.where(where)
        base = lines.where(F.exists("facets", lambda f: (f == "/base") | f.startswith("/base/"))) if r.foundational_bonus else None
        lex = sem = self.spark.createDataFrame([], "id bigint, score double")
        if mode != vectors.SEMANTIC_ONLY:
            h = self._run("exact" if query.strip()[:1] == '"' else lexical, query, facets, True)
            lex = page(h.rows, RELEVANCE, candidates).select("id", "score")
        if mode != vectors.LEXICAL_ONLY and not reason:
            have, at = self._vectors(), keys.select("id", F.lower("key").alias("key"))
            live = lines.join(at, "id")
            wanted = have if where is None else have.join(live.select("key").distinct(), "key", "left_semi")
            near = vectors.knn(wanted, vector, candidates, threshold=r.threshold)
            if base is not None:
                own = have.join(base.select("id").join(at, "id").select("key").distinct(), "key", "left_semi")
                near = near.unionByName(vectors.knn(own, vector, max(1, int(candidates * vectors.FOUNDATIONAL_SHARE)), threshold=r.threshold)).distinct()
            sem = vectors.resolve(near, live.select("id", "file_path", "key")).select("id", F.col("similarity").alias("score"))
        return vectors.fuse(lex, sem, r, query, base.select("id") if base is not None else None), reason

    def semantic_session(self, query: str, vector: Sequence[float] | None, keys: DataFrame, facets: Sequence[str] = (), mode: str = vectors.HYBRID, ranking: vectors.Ranking | None = None, lexical: str = "exact", candidates: int = 1000, grouping: str | None = None) -> SemanticSession:
        """The fused ranking frozen, so that its pages continue one order; grouped like lexical results if asked. A session of
        the same query is taken up again while the content is the same; else a new one says that it starts anew."""
        r = ranking or vectors.Ranking()
        key = (query, tuple(vector or ()), _frozen(keys), tuple(facets), mode, _frozen(vars(r)), lexical, candidates, grouping)
        now = (self.search_snapshot(), self._vector_sets.latest())
        held = self._sessions.get(key)
        if held is None or held.state != now:
            fused, reason = self._fused(query, vector, keys, facets, mode, r, lexical, candidates)
            rows = fused.select("id", "score", "source")
            if grouping:
                c = self.corpus()
                rows = both_rows(c, rows.withColumn("tier", F.lit(0)).withColumn("span", F.lit(None).cast("int")))
                rows = grouped(attached(c, rows, "line_hash"), grouping, RELEVANCE)
            else:
                rows = rows.withColumn("merged_count", F.lit(1).cast("long")).withColumn("siblings", F.array().cast("array<bigint>"))
            ranked = rows.select("id", "score", "source", "merged_count", "siblings").orderBy(F.col("score").desc(), "id").collect()  # at most two lists of candidates
            held = SemanticSession(self, now, ranked, reason, held is not None)
            self._sessions[key] = held
            while len(self._sessions) > WINDOWS:
                self._sessions.popitem(last=False)
        return held

    def semantic_covered_books(self, keys: DataFrame) -> DataFrame:
        """Books with at least one line whose key has a vector."""
        return self.semantic_coverage(keys).where("covered > 0").select("file_path")

    def semantic_index_books(self, vectors_: DataFrame) -> None:
        """Add the vectors of some books to the installed set."""
        self.install_semantic_vectors(vectors_, delta=self._has_vectors())

    def open_semantic_artifact(self, path: str) -> None:
        """Install a stored vector set (key, embedding)."""
        self.install_semantic_vectors(self.spark.read.parquet(path))

    configure_semantic = install_semantic_vectors

    def semantic_passage_highlights(self, text: str, clause_vectors: Sequence[Sequence[float]], query_vector: Sequence[float]) -> str:
        """A passage with the clause marked whose vector is nearest to the query; the vectors are those of display.clauses()."""
        parts = display.clauses(text)
        if not parts or len(parts) != len(clause_vectors):
            return text
        norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
        best = max(range(len(parts)), key=lambda i: (sum(a * b for a, b in zip(clause_vectors[i], query_vector, strict=True)) / norm(clause_vectors[i]), -i))
        return " ".join(f"<mark>{c}</mark>" if i == best else c for i, c in enumerate(parts))

    def lexical_cancellation_handle(self, request: str):
        """A context in which searches can be cancelled by cancel_lexical_search(request) from another thread."""
        return results.cancellable(self.spark, request)

    # -- display -------------------------------------------------------------------------------------------------------------------------

    def generate_index_highlight_pattern(self, family: str, query, **args) -> list[list[str]]:
        """The terms that matched, word by word; forms on the blacklist are left out."""
        found = self._run(family, query, **args).words
        if self._blacklist is None:
            return [sorted(e.terms) for e in found]
        pairs = self.spark.createDataFrame([(i, e.word, t) for i, e in enumerate(found) for t in e.terms], "at int, word string, form string")
        kept = lexicons.without_blacklisted(pairs, self._blacklist).collect()
        return [sorted(r.form for r in kept if r.at == i) for i in range(len(found))]


def _named(family: str, suffix: str) -> None:
    """The counts, facet counts, pages and streams of one family under their own names."""

    def count(self, query, facets=(), **args):
        return self.count(family, query, facets, **args)

    def with_status(self, query, facets=(), **args):
        return self.count_with_status(family, query, facets, **args)

    def by_book(self, query, facets=(), **args):
        return self.count_by_book(family, query, facets, **args)

    def by_book_with_status(self, query, facets=(), **args):
        h = self._run(family, query, facets, **args)
        return count_by_book(h.rows), h.truncated

    def facet(self, query, facet_prefix="/", facets=(), **args):
        return self.get_facet_counts(family, query, facet_prefix, facets, **args)

    def facet_with_status(self, query, facet_prefix="/", facets=(), **args):
        h = self._run(family, query, facets, **args)
        return facet_counts(h.rows, facet_prefix), h.truncated

    def both(self, query, **args):
        return self.search(family, query, **args)

    def streamed(self, query, chunk_size=50, **args):
        return self.stream(family, query, chunk_size, **args)

    def streamed_with_counts(self, query, chunk_size=50, **args):
        return self.stream_with_counts(family, query, chunk_size, **args)

    def pattern(self, query, **args):
        return self.generate_index_highlight_pattern(family, query, **args)

    names = {
        f"count_{suffix}": count, f"count_{suffix}_with_status": with_status, f"count_by_book_{suffix}": by_book, f"count_by_book_{suffix}_with_status": by_book_with_status,
        f"get_facet_counts_{suffix}": facet, f"get_facet_counts_{suffix}_with_status": facet_with_status, f"search_and_count_{suffix}": both,
        f"search_{suffix}_stream": streamed, f"search_{suffix}_stream_with_counts": streamed_with_counts, f"generate_index_{suffix}_highlight_pattern": pattern,
    }
    for name, f in names.items():
        if not hasattr(SearchEngine, name):
            f.__name__ = name
            setattr(SearchEngine, name, f)


for _family, _suffix in (("exact", "exact"), ("fuzzy", "fuzzy"), ("advanced", "advanced"), ("user_regex", "user_regex"), ("regex", "regex"), ("smart", "smart")):
    _named(_family, _suffix)


#: Ranked rows a query keeps for its next pages, and queries that are kept.
WINDOW, WINDOWS = 20_000, 16
#: Up to so many ids are looked up as a list of values, more by a join.
LISTED = 2_000


@dataclass
class _Ranked:
    """What pages of one query share: its hits, the first of them in order, and the numbers of hits, groups and rows."""

    hits: Hits
    window: list
    total: int
    groups: int | None
    all: int


def _frozen(x):
    """A value that can be a key."""
    if isinstance(x, dict):
        return tuple(sorted((str(k), _frozen(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(_frozen, x))
    return id(x) if isinstance(x, DataFrame) else x


def _with_sections(lines: DataFrame) -> DataFrame:
    return lines.withColumn("section_id", F.col("id").bitwiseAND(F.lit(SECTION_MASK)) + F.coalesce("section_ordinal", F.lit(0)))


def _tokenized(lines: DataFrame) -> DataFrame:
    return with_tokens(_with_sections(lines))


def _by_ids(lines: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The lines with these ids. A list reaches the scan as a filter, which skips files and row groups of other ids; a long
    one does by its range."""
    every = sorted(set(ids))
    if len(every) <= LISTED:
        return lines.where(F.col("id").isin(every) if every else F.lit(False))
    at = lines.sparkSession.createDataFrame([(i,) for i in every], "id long")
    return lines.where(F.col("id").between(every[0], every[-1])).join(F.broadcast(at) if len(every) <= BROADCAST_ROWS else at, "id", "left_semi")


def both_rows(c: Corpus, best: DataFrame) -> DataFrame:
    """Ids with the columns of their books."""
    if c.books is None:
        return c.lines.join(best, "id")
    at = best.withColumn("book_no", book_number(F.col("id"))).withColumn("ordinal", (F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)) - 1).cast("int"))
    return attached(c, at.join(c.books, "book_no", "left"), "section_id")


def _final_class(c: str) -> str:
    from quire.functions.words import FINALS

    back = {v: k for k, v in FINALS.items()}
    return f"[{c}{back[c]}]" if c in back else c


def _aliased(word: str) -> WordPlan:
    """A word of a smart search; a name written with a placeholder letter also matches its canonical spelling."""
    m = re.fullmatch(r"([א-ת]{0,2})י[קד]ו[קד]", word)
    p = plan_word(word)
    if m:
        p.branches.append(Branch(m[1] + "יהוה", OTHER))
    return p


def quoted(query: str) -> tuple[list[list[str]], list[str]]:
    """Phrases in double quotes, and the other words. Quotes inside a word quote nothing, an unpaired one is ignored."""
    q = query.translate(T._QUOTES)
    phrases, at, rest = [], 0, []
    for m in re.finditer(r'(?<![^\s(])"([^"]*?(?:[^\W]"[^\W][^"]*?)*)"(?![^\W])', q):
        rest.append(q[at : m.start()])
        words = split_words(m[1])
        if words:
            phrases.append(words)
        at = m.end()
    rest.append(q[at:])
    return phrases, split_words(re.sub(r'(?<![^\s(])"|"(?![^\W])', " ", " ".join(rest)))


__all__ = ["IDENTICAL_TEXT", "Count", "Page", "SearchEngine", "quoted"]

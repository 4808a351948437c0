"""Search queries over the whole table of lines, each with its SQL.

A line's plain text is its ``semantic_text``; books bring titles and facets, the mapping brings the orders. The SQL says the
same with joins over positions, the slow and plain way, so both sides only share the definition.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.engine import SearchEngine
from quire.functions import text as T
from quire.functions.display import Paint, semantic_parts, snippets
from quire.functions.hashes import content_hash, fnv1a, line_hash, metadata_hash
from quire.functions.words import ENDINGS, EXACT, VERB_ENDINGS, Branch, WordOptions, WordPlan, plan_word, resolve_gaps, spelling_variants
from quire.operators import recipe, regexes
from quire.operators.corpus import Corpus, build, facets_of, heading_level, with_order, with_sections
from quire.operators.lexicons import Morphology
from quire.operators.search import ANY, AT_LEAST, CATALOGUE, GENERATION, IDENTICAL_TEXT, MOST, RELEVANCE, SAME_PARAGRAPH, SAME_SECTION, SAME_SECTION_GROUPS, Hits, Query, attached, chunks, count_by_book, facet_counts, grouped, next_lines, page, search
from quire.session import scratch_dir, small, table
from quire.sources import books
from quire.sources.store import Store, difference
from quire.streaming.ingest import windowed_counts

Q = Callable[[SparkSession, str], DataFrame]


def line_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each line once: id, file_path, ordinal, section, section_id, raw, plain."""
    rows = table(spark, d, "semantic_recipe_v4").groupBy("id").agg(F.min("file_path").alias("file_path"), F.min("ordinal").alias("ordinal"), F.min("section").alias("section"), F.max("raw").alias("raw"), F.max("semantic_text").alias("text"))
    return rows.select("id", "file_path", "ordinal", "section", F.xxhash64("file_path", F.coalesce("section", F.lit(-1))).alias("section_id"), "raw", T.collapse(F.coalesce("text", F.lit(""))).alias("plain"))


def book_facets(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, facets): all facets of a book's rows, sorted."""
    b = table(spark, d, "library_book").where("file_path IS NOT NULL").select("file_path", F.explode_outer(facets_of(F.col("topics"), F.col("extra_facets"))).alias("f"))
    return b.groupBy("file_path").agg(F.array_sort(F.collect_set("f")).alias("facets"))


_OPEN: dict[tuple, Corpus] = {}


def _stamp(spark: SparkSession, d: str, *names: str) -> tuple:
    """What tells one state of some tables from another: name, length and time of each of their files."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = []
    for name in names:
        p = jvm.Path(f"{d}/{name}.parquet")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        at = fs.listFiles(p, True)
        while at.hasNext():
            f = at.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _stored(spark: SparkSession, key: tuple, name: str, make: Callable[[], Corpus]) -> Corpus:
    """A corpus built once and stored in the shared folder, as an index is; later queries over the same tables open it."""
    key = (spark.sparkContext.applicationId, name, *key)
    if key not in _OPEN:
        path = scratch_dir(spark, name)
        make().write(path, ranged=True)
        _OPEN[key] = Corpus.read(spark, path)
    return _OPEN[key]


def corpus(spark: SparkSession, d: str) -> Corpus:
    """The index of the lines: lines with tokens, postings, dictionary, and books with their facets and orders."""

    def make() -> Corpus:
        rows = line_rows(spark, d).repartitionByRange("id")
        c = build(rows)
        kept = c.lines.select("id", "file_path", "book_no", "ordinal", "section_id", "plain", "tokens", "pos", "first", "last", F.size("tokens").alias("dl"), line_hash(F.col("plain")).alias("line_hash"))
        per = rows.select(F.shiftright("id", 32).alias("book_no"), "file_path").distinct().join(small(book_facets(spark, d)), "file_path", "left").withColumn("facets", F.coalesce("facets", F.array().cast("array<string>")))
        return Corpus(kept, books=with_order(per.withColumn("title", F.lit(None).cast("string")), table(spark, d, "book_order")))

    return _stored(spark, (d, _stamp(spark, d, "semantic_recipe_v4", "library_book", "book_order")), "corpus", make)


def document_corpus(spark: SparkSession, d: str) -> Corpus:
    """The index of the documents, each as one line of a book of its own."""

    def make() -> Corpus:
        rows = table(spark, d, "documents").groupBy("doc_id").agg(F.max("text").alias("text")).repartitionByRange("doc_id")
        c = build(rows.select(F.col("doc_id").alias("id"), T.collapse(F.coalesce("text", F.lit(""))).alias("plain")))
        return Corpus(c.lines.select("id", "file_path", "section_id", "plain", "tokens", "pos", "first", "last", F.size("tokens").alias("dl")))

    return _stored(spark, (d, _stamp(spark, d, "documents")), "documents", make)


def engine(spark: SparkSession, d: str) -> SearchEngine:
    """An engine with the lines, committed once; books get numbers of its own, so rows are named by book and ordinal."""
    key = (spark.sparkContext.applicationId, "engine", d, _stamp(spark, d, "semantic_recipe_v4", "book_order", "library_book"))
    if key not in _ENGINES:
        e = SearchEngine(spark, scratch_dir(spark, "engine"))
        facets = small(book_facets(spark, d).select("file_path", F.col("facets").alias("extra_facets")))
        e.add_documents_batch(line_rows(spark, d).select("file_path", "ordinal", F.col("plain").alias("text")).join(facets, "file_path", "left"))
        e.commit()
        e.set_book_order(with_order(table(spark, d, "book_order").select("file_path").where("file_path IS NOT NULL").distinct(), table(spark, d, "book_order")))
        _ENGINES[key] = e
    return _ENGINES[key]


_ENGINES: dict[tuple, SearchEngine] = {}


def words(*ws: str, **o: bool) -> list[WordPlan]:
    return [plan_word(w, WordOptions(**o)) for w in ws]


def whole(h: Hits) -> DataFrame:
    """All hits; a query that met a ceiling has not all, and says so."""
    if h.truncated:
        raise RuntimeError("a ceiling cut terms off")
    return h.rows


def ids(q: Query) -> Q:
    """A query that returns the ids of the hits."""
    return lambda spark, d: whole(search(corpus(spark, d), q)).select("id")


# -- the SQL of lines, tokens and positions ---------------------------------------------------------------------------------

_L = r"[\p{L}\p{N}]"
_TOKEN_SQL = rf"{_L}+(?:(?:''''|''|\"){_L}+)*".replace('\\"', '"')
#: A trailing geresh is turned into a letter first, as this dialect has no look-ahead.
_GERESH = rf"({_L})''([''\"]*)($|[^''\"\p{{L}}\p{{N}}])".replace('\\"', '"')
BASE = rf"""
l AS (SELECT id, min(file_path) AS file_path, min(ordinal) AS ordinal, min(section) AS section, max(raw) AS raw,
             trim(regexp_replace(coalesce(max(semantic_text), ''), '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS plain
      FROM semantic_recipe_v4 GROUP BY id),
t AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(lower(plain), '{_GERESH}', '\1ʹ\2\3', 'g'), '{_TOKEN_SQL}'),
                               lambda x: replace(replace(x, 'ʹ', ''''), '''''', '"')) AS tokens FROM l),
p0 AS (SELECT id, file_path, section, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM t),
p AS (SELECT *, replace(replace(term, '"', ''), '''', '') AS bare FROM p0 WHERE strlen(term) <= 128),
"""


def w(name: str, term: str) -> str:
    """A CTE with the places of a word."""
    return f"{name} AS (SELECT * FROM p WHERE term = '{term}' OR bare = '{term}')"


def sql(*parts: str, select: str) -> str:
    return "WITH " + BASE.strip() + ",\n".join(parts) + "\n" + select


def same_line(*names: str) -> str:
    return " AND ".join(f"{names[0]}.id = {x}.id" for x in names[1:])


# -- the queries --------------------------------------------------------------------------------------------------------------

A, B, C, D = "זה", "את", "לא", "כי"
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def add(name: str, q: Q, s: str | None = None) -> None:
    QUERIES[name] = q
    if s is not None:
        SQL[name] = s


# text and dictionary

add("index_build", lambda s, d: corpus(s, d).lines.agg(F.count("*").alias("lines"), F.sum("dl").alias("tokens")), sql("x AS (SELECT 1)", select="SELECT (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM p)::BIGINT AS tokens"))

add(
    "tokenize_stats",
    lambda s, d: corpus(s, d).lines.groupBy("file_path").agg(F.count("*").alias("lines"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.aggregate("tokens", F.lit(0), lambda a, x: a + F.length(x))).alias("letters")),
    sql("n AS (SELECT file_path, count(*) AS lines FROM t GROUP BY 1)", "m AS (SELECT file_path, count(*) AS tokens, sum(length(term)) AS letters FROM p GROUP BY 1)", select="SELECT file_path, lines, coalesce(tokens, 0) AS tokens, coalesce(letters, 0)::BIGINT AS letters FROM n LEFT JOIN m USING (file_path)"),
)
add("term_df", lambda s, d: corpus(s, d).terms(), sql("x AS (SELECT 1)", select="SELECT term, min(bare) AS bare, length(term) AS len, count(DISTINCT id) AS df FROM p GROUP BY term"))
add(
    "postings",
    lambda s, d: corpus(s, d).postings().groupBy("term", "id").agg(F.count("*").alias("n"), F.sum("p").alias("p")).groupBy("term").agg(F.count("*").alias("lines"), F.sum("n").alias("places"), F.sum("p").alias("position_sum")),
    sql("x AS (SELECT 1)", select="SELECT term, count(DISTINCT id) AS lines, count(*) AS places, sum(pos)::BIGINT AS position_sum FROM p GROUP BY term"),
)
_MK = r"(?:\([א-ת0-9''\"*]{1,5}\)|\[[א-ת0-9''\"*]{1,5}\]|\{[א-ת0-9''\"*]{1,5}\})".replace('\\"', '"')
_CONTENT = rf"regexp_replace(regexp_replace(plain, '^\s*(?:{_MK}\s*)+', ''), '(?:\s*{_MK}[\s.:,;]*)+$', '')"


def _tokens_sql(x: str, whole: bool = False) -> str:
    every = f"list_transform(regexp_extract_all(regexp_replace(lower({x}), '{_GERESH}', '\\1ʹ\\2\\3', 'g'), '{_TOKEN_SQL}'), lambda y: replace(replace(y, 'ʹ', chr(39)), chr(39) || chr(39), '\"'))"
    return every if whole else f"len({every})"


@F.pandas_udf(ArrayType(StringType()))
def query_words(s: pd.Series) -> pd.Series:
    """The words of typed queries."""
    return s.map(lambda q: T.split_words(q), na_action="ignore")


add(
    "line_edges",
    lambda s, d: corpus(s, d).lines.select("id", "first", "last").where("first IS NOT NULL"),
    sql(
        f"c AS (SELECT *, {_CONTENT} AS inner_text FROM t)",
        f"e AS (SELECT id, {_tokens_sql('inner_text')} AS cut, {_tokens_sql('substr(plain, 1, greatest(instr(plain, inner_text) - 1, 0))')} AS before, list_filter(list_zip(tokens, range(len(tokens))), lambda x: strlen(x[1]) <= 128) AS kept FROM c)",
        select="SELECT id, kept[least(before + 1, len(kept))][2]::INTEGER AS first, kept[least(before + cut, len(kept))][2]::INTEGER AS last FROM e WHERE len(kept) > 0 AND cut > 0",
    ),
)
_SANE = "translate(translate(translate(text, '״“”„׳‘’', repeat(chr(34), 4) || repeat(chr(39), 3)), '־-|,;:!?(){}', repeat(' ', 12)), '*[]^$\\+.~`', '')"
_SANE = f"regexp_replace({_SANE}, '[\\x{{591}}-\\x{{5bd}}\\x{{5bf}}\\x{{5c1}}\\x{{5c2}}\\x{{5c4}}\\x{{5c5}}\\x{{5c7}}]', '', 'g')"
add("sanitize_split", lambda s, d: table(s, d, "eval_item").select("item_id", query_words("text").alias("words")).select("item_id", F.size("words").alias("words"), F.md5(F.array_join("words", " ")).alias("digest")), f"WITH w AS (SELECT item_id, {_tokens_sql(_SANE, True)} AS w FROM eval_item) SELECT item_id, len(w)::INTEGER AS words, md5(array_to_string(w, ' ')) AS digest FROM w")
add("strip_html_lines", lambda s, d: line_rows(s, d).select("id", T.normalize("raw").alias("plain")))
add(
    "heading_sections",
    lambda s, d: with_sections(line_rows(s, d).drop("section_id")).select("id", "section_ordinal", heading_level(F.col("raw")).alias("level")),
    sql("h AS (SELECT id, file_path, ordinal, try_cast(regexp_extract(raw, '^\\s*<[hH]([1-6])[\\s>]', 1) AS INTEGER) AS level FROM l)", select="SELECT id, coalesce(max(CASE WHEN level IS NOT NULL THEN ordinal END) OVER (PARTITION BY file_path ORDER BY ordinal ROWS UNBOUNDED PRECEDING), 0) AS section_ordinal, level FROM h"),
)
add("heading_trails", lambda s, d: with_sections(line_rows(s, d).drop("section_id")).select("id", "reference"))
add("dedup_text", lambda s, d: line_rows(s, d).select("id", F.md5(T.dedup_text(F.col("plain"))).alias("digest")), sql("x AS (SELECT 1)", select="SELECT id, CASE WHEN length(regexp_replace(plain, '[^א-ת]', '', 'g')) >= 12 THEN md5(regexp_replace(lower(plain), '[^\\p{L}\\p{N}]', '', 'g')) END AS digest FROM l"))
add("line_hashes", lambda s, d: line_rows(s, d).select("id", line_hash(F.col("plain")).alias("line_hash"), F.crc32(F.encode("plain", "UTF-8")).alias("line_check")))
add(
    "garbage_lines",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "c")).where(T.is_garbage(F.col("c"))).select("doc_id", "ordinal"),
    "WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS ordinal FROM documents), g AS (SELECT doc_id, ordinal, length(regexp_replace(c, '\\s', '', 'g')) AS n, length(regexp_replace(c, '[^\\p{L}]', '', 'g')) AS k FROM x) SELECT doc_id, ordinal FROM g WHERE k = 0 OR (n >= 50 AND k / n < 0.1) OR (n >= 20 AND k / n < 0.2 AND n - k > k)",
)

add(
    "semantic_notes",
    lambda s, d: table(s, d, "semantic_recipe_v4").where("raw IS NOT NULL AND semantic_notes IS NOT NULL").groupBy("id").agg(F.max("raw").alias("raw")).select("id", semantic_parts("raw").alias("x")).select("id", F.size("x.notes").alias("notes")),
    "SELECT id, max(len(semantic_notes))::INTEGER AS notes FROM semantic_recipe_v4 WHERE raw IS NOT NULL AND semantic_notes IS NOT NULL GROUP BY id",
)

# boolean and positional matching

add("exact_term", ids(Query(words(A))), sql(w("a", A), select="SELECT DISTINCT id FROM a"))
add("exact_phrase", ids(Query(words(A, B), [0], cross_line=False)), sql(w("a", A), w("b", B), select="SELECT DISTINCT a.id FROM a, b WHERE a.id = b.id AND b.pos = a.pos + 1"))
add("exact_count", lambda s, d: search(corpus(s, d), Query(words(A))).rows.agg(F.count("*").alias("count")), sql(w("a", A), select="SELECT count(DISTINCT id) AS count FROM a"))
add("count_by_book", lambda s, d: count_by_book(search(corpus(s, d), Query(words(A))).rows), sql(w("a", A), select="SELECT file_path, count(DISTINCT id) AS count FROM a GROUP BY file_path"))
add("and_words", ids(Query(words(A, B, C), scope=SAME_PARAGRAPH)), sql(w("a", A), w("b", B), w("c", C), select="SELECT id FROM a INTERSECT SELECT id FROM b INTERSECT SELECT id FROM c"))
add("any_words", ids(Query(words(A, B), mode=ANY)), sql(w("a", A), w("b", B), select="SELECT id FROM a UNION SELECT id FROM b"))
_EACH = "u AS (SELECT id, 1 AS k FROM a UNION SELECT id, 2 FROM b UNION SELECT id, 3 FROM c)"
add("most_words", ids(Query(words(A, B, C), mode=MOST)), sql(w("a", A), w("b", B), w("c", C), _EACH, select="SELECT id FROM u GROUP BY id HAVING count(*) >= 2"))
add("at_least", ids(Query(words(A, B, C), mode=AT_LEAST, count=3)), sql(w("a", A), w("b", B), w("c", C), _EACH, select="SELECT id FROM u GROUP BY id HAVING count(*) >= 3"))
add("gap_phrase_d2", ids(Query(words(A, B), [2], cross_line=False)), sql(w("a", A), w("b", B), select="SELECT DISTINCT a.id FROM a, b WHERE a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3"))
add("custom_spacing", ids(Query(words(A, B, C), resolve_gaps(3, 0, {"0-1": "5", "1-2": "20"}), cross_line=False)), sql(w("a", A), w("b", B), w("c", C), select="SELECT DISTINCT a.id FROM a, b, c WHERE a.id = b.id AND b.id = c.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 6 AND c.pos BETWEEN b.pos + 1 AND b.pos + 21"))
add("any_order_window", ids(Query(words(A, B, C), [3, 3], any_order=3)), sql(w("a", A), w("b", B), w("c", C), select="SELECT DISTINCT a.id FROM a, b, c WHERE a.id = b.id AND b.id = c.id AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 8"))


def cross_line(spark: SparkSession, d: str) -> DataFrame:
    q = Query(words(A, B), [3])
    return search(corpus(spark, d), q).rows.where("crosses").select("id")


_EDGES = SQL["line_edges"][5:].replace("\nSELECT id, kept", ",\ned AS (SELECT id, kept", 1) + ")"
add(
    "cross_line_phrase",
    cross_line,
    f"WITH {_EDGES}, {w('a', A)}, {w('b', B)}, inside AS (SELECT DISTINCT a.id FROM a, b WHERE a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4) "
    "SELECT DISTINCT a.id FROM a JOIN b ON b.id = a.id + 1 AND a.file_path IS NOT DISTINCT FROM b.file_path JOIN ed x ON x.id = a.id JOIN ed y ON y.id = b.id "
    "WHERE a.pos BETWEEN x.first AND x.last AND b.pos BETWEEN y.first AND y.last AND b.pos + x.last + 1 - y.first BETWEEN a.pos + 1 AND a.pos + 4 AND a.id NOT IN (SELECT id FROM inside)",
)
add("negative", ids(Query(words(A), negative=Query(words(B, C), scope=SAME_PARAGRAPH))), sql(w("a", A), w("b", B), w("c", C), select="SELECT id FROM a EXCEPT (SELECT id FROM b INTERSECT SELECT id FROM c)"))
_SEC = "SELECT file_path, section FROM {}"
add("section_scope", ids(Query(words("קמע", "אשר"), scope=SAME_SECTION)), sql(w("a", "קמע"), w("b", "אשר"), "s AS (SELECT DISTINCT a.file_path, a.section FROM a JOIN b ON a.file_path IS NOT DISTINCT FROM b.file_path AND a.section IS NOT DISTINCT FROM b.section)", "u AS (SELECT id, file_path, section FROM a UNION SELECT id, file_path, section FROM b)", select="SELECT id FROM u WHERE EXISTS (SELECT 1 FROM s WHERE s.file_path IS NOT DISTINCT FROM u.file_path AND s.section IS NOT DISTINCT FROM u.section)"))
add("section_negative", ids(Query(words(A), negative=Query(words("קמע"), scope=SAME_SECTION))), sql(w("a", A), w("b", "קמע"), select="SELECT DISTINCT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.file_path = b.file_path AND a.section = b.section)"))


def quotes_in(spark: SparkSession, d: str) -> DataFrame:
    """Terms with quotes are found with and without them."""
    return search(corpus(spark, d), Query([plan_word("חוה")])).rows.select("id")


add("quote_transparent", quotes_in, sql(w("a", "חוה"), select="SELECT DISTINCT id FROM a"))

# expansion

add("prefix_window", ids(Query(words("הוא", prefix=True))), sql("x AS (SELECT 1)", select="SELECT DISTINCT id FROM p WHERE regexp_full_match(term, '[0-9]*[א-תװ-ײ\"'']{0,3}הוא') OR regexp_full_match(bare, '[0-9]*[א-תװ-ײ\"'']{0,3}הוא')"))
add("suffix_window", ids(Query(words("שהו", suffix=True))), sql("x AS (SELECT 1)", select="SELECT DISTINCT id FROM p WHERE regexp_full_match(term, 'שהו[א-תװ-ײ\"'']{0,5}') OR regexp_full_match(bare, 'שהו[א-תװ-ײ\"'']{0,5}')"))
add("partial_word", ids(Query(words("אבל", partial=True))), sql("x AS (SELECT 1)", select="SELECT DISTINCT id FROM p WHERE regexp_full_match(term, '[0-9]*[א-תװ-ײ\"'']{0,3}אבל[א-תװ-ײ\"'']{0,3}') OR regexp_full_match(bare, '[0-9]*[א-תװ-ײ\"'']{0,3}אבל[א-תװ-ײ\"'']{0,3}')"))


def _one_byte(x: str) -> str:
    """Hebrew letters as capitals: this dialect's distance counts bytes."""
    return f"translate({x}, 'אבגדהוזחטיכךלמםנןסעפףצץקרשת', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_')"


def _either(condition: str) -> str:
    """A condition on ``x`` for a term or its form without quotes."""
    return "(" + " OR ".join(condition.replace("{x}", c) for c in ("term", "bare")) + ")"


def _terms(condition: str) -> str:
    """Lines with a term that meets a condition, which states the rule of an expansion in its own words."""
    return f"WITH {BASE.strip()} hit AS (SELECT term FROM (SELECT DISTINCT term, bare FROM p) WHERE {condition}) SELECT DISTINCT id FROM p WHERE term IN (SELECT term FROM hit)"


_CON, _ART, _END = "ו|מ|דא|כש|כ|ב|ש|ל|ה|ד", "כש|כ|ב|ש|ל|ה|ד", "|".join([*ENDINGS, *VERB_ENDINGS])
_ARAMAIC = "ו|מ|דא|א|כש|כ|ב|ש|ל|ה|ד"
add("grammatical_affixes", ids(Query(words("דבר", gram_prefix=True, gram_suffix=True))), _terms(_either(f"regexp_full_match({{x}}, '(?:{_CON})?(?:{_ART})?ה?דבר(?:{_END})?')")))
add("aramaic_forms", ids(Query(words("הכא", aramaic_prefix=True, aramaic_suffix=True))), _terms(_either(f"regexp_full_match({{x}}, '(?:{_ARAMAIC})?(?:{_ART})?ה?הכ[אה]')")))
add("alternative_words", ids(Query([plan_word(A, WordOptions(alternatives=("הזה", "זו")))])), _terms(_either("{x} IN ('זה', 'הזה', 'זו')")))
# of a word of four letters without Vav or Yod: one of them, or none, in each of its three gaps
add("spelling_variants", ids(Query(words("געמן", spelling=True))), _terms(_either("regexp_full_match({x}, 'ג[וי]?ע[וי]?מ[וי]?ן')")))
_TYPO = "(regexp_full_match({x}, '[א-ת]+') AND damerau_levenshtein(" + _one_byte("{x}") + ", " + _one_byte("'אחרי'") + ") <= 1)"
add("typo_d1", ids(Query(words("אחרי", typo=True))), _terms(_either(_TYPO)))

for _k in (1, 2):
    add(f"fuzzy_d{_k}", ids(Query([WordPlan("שהוא", fuzzy=_k)])), sql("hit AS (SELECT term FROM (SELECT DISTINCT term, bare FROM p) WHERE least(levenshtein(" + _one_byte("term") + ", " + _one_byte("'שהוא'") + "), levenshtein(" + _one_byte("bare") + ", " + _one_byte("'שהוא'") + ")) <= " + str(_k) + ")", select="SELECT DISTINCT id FROM p WHERE term IN (SELECT term FROM hit)"))


def capped(spark: SparkSession, d: str) -> DataFrame:
    """The terms of a pattern under a ceiling of ten: by branch, length, frequency, term."""
    from quire.operators.expand import ranked

    p = WordPlan("x", [Branch("ש.*", EXACT), Branch("ה.*", EXACT)])
    return ranked(corpus(spark, d).terms(), p).orderBy("branch", "len", F.col("df").desc(), "term").limit(10).select("term", "df")


add("ranked_terms", capped, sql("d AS (SELECT term, min(bare) AS bare, length(term) AS len, count(DISTINCT id) AS df FROM p GROUP BY term)", select="SELECT term, df FROM d WHERE regexp_full_match(term, '[שה].*') OR regexp_full_match(bare, '[שה].*') ORDER BY CASE WHEN regexp_full_match(term, 'ש.*') OR regexp_full_match(bare, 'ש.*') THEN 0 ELSE 1 END, len, df DESC, term LIMIT 10"))
add("regex_word", lambda s, d: whole(regexes.matched(corpus(s, d), "של[אוה]?")).select("id"), sql("x AS (SELECT 1)", select="SELECT DISTINCT id FROM p WHERE regexp_full_match(term, 'של[אוה]?') OR regexp_full_match(bare, 'של[אוה]?')"))
add("regex_sequence", lambda s, d: regexes.matched(corpus(s, d), "זה (?:את|לא)").rows.where("NOT crosses").select("id"), sql(w("a", A), "b AS (SELECT * FROM p WHERE term IN ('את', 'לא') OR bare IN ('את', 'לא'))", select="SELECT DISTINCT a.id FROM a, b WHERE a.id = b.id AND b.pos = a.pos + 1"))
_FOLD = "regexp_replace(lower(plain), '[\\x{ad}\\x{34f}\\x{61c}\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{2066}-\\x{206f}\\x{feff}\\x{300}-\\x{36f}\\x{fb1e}]', '', 'g')"
add("regex_line", lambda s, d: regexes.matched(corpus(s, d), "זה .{2,6} את").rows.select("id"), sql("x AS (SELECT 1)", select=f"SELECT id FROM l WHERE regexp_matches({_FOLD}, '(?:^|[^\\p{{L}}\\p{{N}}])זה .{{2,6}} את(?:[^\\p{{L}}\\p{{N}}]|$)')"))
add("regex_anchored", lambda s, d: regexes.matched(corpus(s, d), "^גם .*").rows.select("id"), sql(f"c AS (SELECT id, {_FOLD} AS f FROM l)", select=f"SELECT id FROM c WHERE regexp_matches(f, '^\\s*גם .*') OR regexp_matches(trim({_CONTENT.replace('plain', 'f')}), '^\\s*גם .*')"))

# facets, orders, pages, groups

_FAC = "bf AS (SELECT file_path, list_distinct(flatten(list(list_filter(list_concat([topics], coalesce(extra_facets, [])), lambda x: x IS NOT NULL AND x <> '')))) AS facets FROM library_book WHERE file_path IS NOT NULL GROUP BY file_path)"


def some_facet(spark: SparkSession, d: str) -> DataFrame:
    return search(corpus(spark, d), Query(words(A), facets=["/era/0", "/era/1"])).rows.select("id")


add("facet_filter", some_facet, sql(w("a", A), _FAC, select="SELECT DISTINCT id FROM a JOIN bf USING (file_path) WHERE len(list_filter(facets, lambda f: f IN ('/era/0', '/era/1') OR starts_with(f, '/era/0/') OR starts_with(f, '/era/1/'))) > 0"))
add("facet_counts", lambda s, d: facet_counts(search(corpus(s, d), Query(words(A))).rows), sql(w("a", A), _FAC, "f AS (SELECT DISTINCT id, '/' || split_part(unnest(facets), '/', 2) AS path FROM a JOIN bf USING (file_path))", select="SELECT path, count(*) AS count FROM f GROUP BY path"))
add("facet_children", lambda s, d: facet_counts(search(corpus(s, d), Query(words(A))).rows, "/era"), sql(w("a", A), _FAC, "f0 AS (SELECT id, unnest(facets) AS f FROM a JOIN bf USING (file_path))", "f AS (SELECT DISTINCT id, '/era/' || split_part(f, '/', 3) AS path FROM f0 WHERE starts_with(f, '/era/'))", select="SELECT path, count(*) AS count FROM f GROUP BY path"))
_ORD = "bo AS (SELECT file_path, min(catalogue_order) AS cat, min(generation_order) AS gen FROM book_order WHERE file_path IS NOT NULL GROUP BY file_path)"
add("order_catalogue", lambda s, d: page(search(corpus(s, d), Query(words(A))).rows, CATALOGUE, 50, 10).select("id"), sql(w("a", A), _ORD, select="SELECT id FROM (SELECT DISTINCT id, file_path FROM a) LEFT JOIN bo USING (file_path) ORDER BY cat NULLS LAST, id >> 32, id LIMIT 50 OFFSET 10"))
add("order_generation", lambda s, d: page(search(corpus(s, d), Query(words(A))).rows, GENERATION, 50).select("id"), sql(w("a", A), _ORD, select="SELECT id FROM (SELECT DISTINCT id, file_path FROM a) LEFT JOIN bo USING (file_path) ORDER BY gen NULLS LAST, cat NULLS LAST, id >> 32, id LIMIT 50"))
_BM = (
    "st AS (SELECT count(*) AS n, avg(k) AS mean FROM (SELECT t.id, count(p.pos) AS k FROM t LEFT JOIN p USING (id) GROUP BY t.id))",
    "len AS (SELECT id, count(*) AS dl FROM p GROUP BY id)",
    "wa AS (SELECT id, count(*) AS tf FROM a GROUP BY id)",
    "da AS (SELECT sum(df) AS df FROM (SELECT term, count(DISTINCT id) AS df FROM a GROUP BY term))",
)
_BM_SCORE = "ln(1 + (n - least(da.df, n) + 0.5) / (least(da.df, n) + 0.5)) * wa.tf * 2.2 / (wa.tf + 1.2 * (0.25 + 0.75 * dl / mean))"


def best(spark: SparkSession, d: str) -> DataFrame:
    rows = search(corpus(spark, d), Query(words(A)), score=True).rows
    return rows.select("id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(100)


add("bm25_topk", best, sql(w("a", A), *_BM, select=f"SELECT id, round({_BM_SCORE}, 6) AS score FROM wa JOIN len USING (id), st, da ORDER BY score DESC, id LIMIT 100"))
add(
    "relevance_tiers",
    lambda s, d: whole(search(corpus(s, d), Query(words("שהוא", gram_prefix=True, typo=True)))).groupBy("tier").agg(F.count("*").alias("lines")),
    f"WITH {BASE.strip()} hit AS (SELECT term, CASE WHEN {_either("{x} = 'שהוא'")} THEN 0 WHEN {_either(f"regexp_full_match({{x}}, '(?:{_CON})?(?:{_ART})?ה?שהוא')")} THEN 1 WHEN {_either(_TYPO.replace('אחרי', 'שהוא'))} THEN 3 END AS tier FROM (SELECT DISTINCT term, bare FROM p)), "
    "m AS (SELECT id, min(tier) AS tier FROM p JOIN hit USING (term) WHERE hit.tier IS NOT NULL GROUP BY id) SELECT tier, count(*) AS lines FROM m GROUP BY tier",
)
add("page_by_relevance", lambda s, d: page(search(corpus(s, d), Query(words(A, B), [2]), score=True).rows, RELEVANCE, 20).select("id", "crosses"))


def by_section(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return grouped(search(c, Query(words(A))).rows, SAME_SECTION_GROUPS).select("id", "merged_count", F.size("siblings").alias("siblings"))


_GROUP = "g AS (SELECT DISTINCT id, file_path, section FROM a)"
add("group_same_section", by_section, sql(w("a", A), _GROUP, _ORD, "r AS (SELECT id, row_number() OVER (PARTITION BY file_path, section ORDER BY cat NULLS LAST, id >> 32, id) AS k, count(*) OVER (PARTITION BY file_path, section) AS n FROM g LEFT JOIN bo USING (file_path))", select="SELECT id, n AS merged_count, least(n - 1, 10)::INTEGER AS siblings FROM r WHERE k = 1"))


def by_text(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return grouped(attached(c, search(c, Query(words(A))).rows, "line_hash"), IDENTICAL_TEXT).select("id", "merged_count")


_TEXT_KEY = "CASE WHEN length(regexp_replace(plain, '[^א-ת]', '', 'g')) >= 12 THEN regexp_replace(lower(plain), '[^\\p{L}\\p{N}]', '', 'g') ELSE 'id' || id END"
add("group_identical_text", by_text, sql(w("a", A), _ORD, f"g AS (SELECT id, file_path, {_TEXT_KEY} AS k FROM l WHERE id IN (SELECT id FROM a))", "r AS (SELECT id, row_number() OVER (PARTITION BY k ORDER BY cat NULLS LAST, id >> 32, id) AS i, count(*) OVER (PARTITION BY k) AS n FROM g LEFT JOIN bo USING (file_path))", select="SELECT id, n AS merged_count FROM r WHERE i = 1"))


def page_and_count(spark: SparkSession, d: str) -> DataFrame:
    """A page of the engine in its order, each row with the number of all hits."""
    p = engine(spark, d).search_and_count_exact(A, limit=30, offset=5)
    return p.rows.select((F.col("rank") + 5).cast("long").alias("rank"), "file_path", "ordinal", F.lit(p.total).cast("long").alias("total"))


add("search_and_count", page_and_count, sql(w("a", A), _ORD, "h AS (SELECT DISTINCT a.id, a.file_path, t.ordinal FROM a JOIN t USING (id))", "r AS (SELECT *, row_number() OVER (ORDER BY cat NULLS LAST, file_path, ordinal) - 1 AS rank, count(*) OVER () AS total FROM h LEFT JOIN bo USING (file_path))", select="SELECT rank, file_path, ordinal, total FROM r WHERE rank BETWEEN 5 AND 34"))


def with_forms(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a fuzzy search with a morphology that knows a form of the word."""
    base = spark.createDataFrame([(1, "שהוא")], "id long, value string")
    surface = spark.createDataFrame([(1, "אחרי", 1)], "id long, value string, base_id long")
    e = engine(spark, d)
    e.set_magic_dictionary(Morphology(base, surface))
    try:
        return whole(e.fuzzy_hits("שהוא", max_distance=1)).select("file_path", "ordinal")
    finally:
        e.set_magic_dictionary(None)


add("fuzzy_with_forms", with_forms, sql("hit AS (SELECT term FROM (SELECT DISTINCT term, bare FROM p) WHERE term = 'אחרי' OR bare = 'אחרי' OR least(levenshtein(" + _one_byte("term") + ", " + _one_byte("'שהוא'") + "), levenshtein(" + _one_byte("bare") + ", " + _one_byte("'שהוא'") + ")) <= 1)", select="SELECT DISTINCT t.file_path, t.ordinal FROM p JOIN t USING (id) WHERE term IN (SELECT term FROM hit)"))


def capped_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty lines of a line pattern in catalogue order, and whether more were cut off."""
    h = regexes.matched(corpus(spark, d), "זה .{2,6} את", limit=20)
    return h.rows.select("id", F.lit(h.truncated).alias("truncated"))


add("regex_capped", capped_lines, sql(f"f AS (SELECT id, file_path FROM l WHERE regexp_matches({_FOLD}, '(?:^|[^\\p{{L}}\\p{{N}}])זה .{{2,6}} את(?:[^\\p{{L}}\\p{{N}}]|$)'))", _ORD, select="SELECT id, (SELECT count(*) > 20 FROM f) AS truncated FROM f LEFT JOIN bo USING (file_path) ORDER BY cat NULLS LAST, id >> 32, id LIMIT 20"))


def counted_under_a_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """The number of hits under a ceiling of three terms, and that it cut terms off."""
    c = engine(spark, d).count_regex_with_status(["ש.*"], max_expansions=3)
    return spark.createDataFrame([(c.count, c.truncated)], "count long, truncated boolean")


add("count_with_status", counted_under_a_ceiling, sql("d AS (SELECT term, length(term) AS len, count(DISTINCT id) AS df FROM p WHERE regexp_full_match(term, 'ש.*') OR regexp_full_match(bare, 'ש.*') GROUP BY term)", "k AS (SELECT term FROM d ORDER BY len, df DESC, term LIMIT 3)", select="SELECT count(DISTINCT id) AS count, (SELECT count(*) > 3 FROM d) AS truncated FROM p WHERE term IN (SELECT term FROM k)"))
add("documents_by_book", lambda s, d: engine(s, d).count_documents_by_file_path(), "SELECT file_path, count(DISTINCT id) AS count FROM semantic_recipe_v4 GROUP BY file_path")
add("neighbours", lambda s, d: next_lines(corpus(s, d), search(corpus(s, d), Query(words("קמע"))).rows).select("id"), sql(w("a", "קמע"), select="SELECT id FROM l WHERE id IN (SELECT id + 1 FROM a)"))

# books



def stamped(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of books: here of the rows of the library's table, with lengths and numbers in the place of other fingerprints."""
    rows = table(spark, d, "library_book").select("file_path", F.length("topics").cast("long").alias("content_hash"), F.length("title").cast("long").alias("text_hash"), F.col("book_id").alias("metadata_hash"), "source_hash")
    return books.stamps(rows)


def _agreed(x: str, name: str) -> str:
    return f"CASE WHEN count(DISTINCT coalesce({x}, 0)) = 1 THEN max(coalesce({x}, 0)) ELSE 0 END AS {name}"


add("book_stamps", stamped, f"SELECT file_path, count(*) AS documents, {_agreed('length(topics)', 'content_hash')}, {_agreed('length(title)', 'text_hash')}, {_agreed('book_id', 'metadata_hash')}, {_agreed('source_hash', 'source_hash')} FROM library_book GROUP BY file_path")
add("book_fingerprints", lambda s, d: table(s, d, "library_book").select("file_path", content_hash(F.coalesce("db_title", F.lit("")), F.col("title"), F.col("topics"), F.col("extra_facets")).alias("content_hash"), metadata_hash(F.col("title"), F.col("topics"), F.col("extra_facets")).alias("metadata_hash")).distinct())
add("text_fingerprints", lambda s, d: table(s, d, "documents").select("doc_id", fnv1a("text").alias("text_hash")))


def library_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The library's books as a batch from two of the three sources; attached ones are away."""
    asked = table(spark, d, "library_book").groupBy("source", "book_id").agg(*(F.min(c).alias(c) for c in ("title", "topics", "file_path", "source_hash")), F.min("extra_facets").alias("extra_facets"))
    asked = asked.withColumn("position", F.col("book_id"))
    rows = line_rows(spark, d).select("file_path", F.col("ordinal").alias("line_index"), F.col("raw").alias("content")).join(small(asked.select("file_path", "source", "book_id")), "file_path").drop("file_path")
    return books.library_books(asked, rows, spark.createDataFrame([("library",), ("user",)], "source string"))


add(
    "library_status",
    lambda s, d: library_batch(s, d)[1].select("file_path", "status"),
    "WITH b AS (SELECT source, min(file_path) AS file_path FROM library_book GROUP BY source, book_id), n AS (SELECT file_path, count(*) AS n, count(raw) AS k FROM (SELECT id, min(file_path) AS file_path, max(raw) AS raw FROM semantic_recipe_v4 GROUP BY id) GROUP BY file_path) "
    "SELECT b.file_path, CASE WHEN source = 'attached' THEN 'Unavailable' WHEN n IS NULL THEN 'Missing' WHEN k < n THEN 'Failed' ELSE 'Indexed' END AS status FROM b LEFT JOIN n USING (file_path)",
)
add(
    "library_lines",
    lambda s, d: library_batch(s, d)[0].groupBy("file_path").agg(F.count("*").alias("lines"), F.max("ordinal").alias("last"), F.sum("segment").alias("segments")),
    "WITH b AS (SELECT source, min(file_path) AS file_path FROM library_book GROUP BY source, book_id), r AS (SELECT id, min(file_path) AS file_path, min(ordinal) AS ordinal, max(raw) AS raw FROM semantic_recipe_v4 GROUP BY id) "
    "SELECT r.file_path, count(*) AS lines, (count(*) - 1)::INTEGER AS last, sum(ordinal)::BIGINT AS segments FROM r JOIN b USING (file_path) WHERE source <> 'attached' GROUP BY r.file_path HAVING count(*) = count(raw)",
)

# maintenance: the state after an operation


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """Each line with the number of its batch, in the layout of single documents."""
    rows = table(spark, d, "semantic_recipe_v4").groupBy("id").agg(F.min("file_path").alias("file_path"), F.min("ordinal").alias("ordinal"), F.max("semantic_text").alias("text"), F.max("batch_no").cast("long").alias("segment"))
    return rows.select("file_path", "ordinal", "text", "segment")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """The store after all lines of batches up to 6 came, and then those of later ones and, once more and shortened, of batch 6."""
    rows, store = _batches(spark, d), Store(spark, scratch_dir(spark, "store"))
    store.add(books.documents(rows.where("segment <= 6")))
    store.commit()
    store.upsert(books.documents(rows.where("segment >= 6").withColumn("text", F.substring("text", 1, 9))))
    store.commit()
    return store.lines().select("file_path", "ordinal", F.col("segment").alias("batch_no"), (F.length("plain") > 9).alias("whole"))


add("upsert", upserted, sql("n AS (SELECT id, max(batch_no)::BIGINT AS batch_no FROM semantic_recipe_v4 GROUP BY id)", select="SELECT file_path, ordinal, batch_no, batch_no < 6 AND length(plain) > 9 AS whole FROM l JOIN n USING (id)"))


def without_books(spark: SparkSession, d: str) -> DataFrame:
    """Lines a book that are left in the store after two books were deleted."""
    store = Store(spark, scratch_dir(spark, "store"))
    store.add(books.documents(_batches(spark, d)))
    store.commit()
    store.delete(file_paths=["id:1", "uid:2"])
    store.commit()
    return count_by_book(store.lines()).withColumnRenamed("count", "left")


add("delete_by_book", without_books, "SELECT file_path, count(DISTINCT id) AS \"left\" FROM semantic_recipe_v4 WHERE file_path IS NULL OR file_path NOT IN ('id:1', 'uid:2') GROUP BY file_path")


def diff_batches(spark: SparkSession, d: str) -> DataFrame:
    """Lines that came or changed between two states of the table: up to batch 6, and all."""
    rows = table(spark, d, "semantic_recipe_v4").groupBy("id").agg(F.min("batch_no").alias("batch_no"), F.max("indexed_text").alias("text"))
    return difference(rows.where("batch_no <= 6"), rows, "id", "text")


add("diff_versions", diff_batches, "SELECT id, 'added' AS change FROM semantic_recipe_v4 GROUP BY id HAVING min(batch_no) > 6")

# vectors and export


def plan_records(spark: SparkSession, d: str) -> DataFrame:
    """What an export writes down: the place of every window."""
    return table(spark, d, "semantic_recipe_v4").select("file_path", "ordinal", F.explode("windows").alias("x")).select(F.lower("x.key").alias("key"), "file_path", "ordinal", F.col("x.ordinal").alias("window_no")).distinct()


add("plan_records", plan_records, "SELECT DISTINCT lower(x.key) AS key, file_path, ordinal, x.ordinal AS window_no FROM (SELECT file_path, ordinal, unnest(windows) AS x FROM semantic_recipe_v4)")


def covered(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.vectors import coverage

    have = table(spark, d, "vector_record").where("action = 'put'").select(F.lower("key").alias("key"))
    return coverage(plan_records(spark, d), have)


add("semantic_coverage", covered, f"WITH r AS ({SQL['plan_records']}), v AS (SELECT DISTINCT lower(key) AS key FROM vector_record WHERE action = 'put') SELECT file_path, count(*) AS embeddable, sum(CASE WHEN key IN (SELECT key FROM v) THEN 1 ELSE 0 END)::BIGINT AS covered FROM r WHERE key IS NOT NULL GROUP BY file_path")
_COS = "(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1) / 2"


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").first().embedding


def nearest(spark: SparkSession, d: str, where: Column | None = None, k: int = 20) -> DataFrame:
    from quire.operators.vectors import knn

    e = table(spark, d, "embeddings")
    return knn(e if where is None else e.where(where), query_vector(spark, d), k, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


_QV = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
add("knn_cosine", nearest, f"WITH {_QV}, s AS (SELECT vec_id, {_COS} AS x FROM embeddings e, q) SELECT vec_id, round(x, 6) AS similarity FROM s ORDER BY x DESC, vec_id LIMIT 20")
add("filtered_knn", lambda s, d: nearest(s, d, F.col("label") == 1), f"WITH {_QV}, s AS (SELECT vec_id, {_COS} AS x FROM embeddings e, q WHERE label = 1) SELECT vec_id, round(x, 6) AS similarity FROM s ORDER BY x DESC, vec_id LIMIT 20")


def nearest_of_all(spark: SparkSession, d: str, where: Column | None = None, k: int = 20) -> DataFrame:
    """The same for every hundredth id as a query."""
    from quire.operators.vectors import knn_all

    e = table(spark, d, "embeddings")
    return knn_all(e if where is None else e.where(where), e.where("vec_id % 100 = 0"), k, "vec_id").withColumn("similarity", F.round("similarity", 6))


def _nearest_of_all_sql(where: str) -> str:
    return f"WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query, e.vec_id, {_COS} AS x FROM embeddings e, q WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(x, 12) DESC, vec_id)::INTEGER AS rank FROM s) SELECT query, vec_id, round(x, 6) AS similarity, rank FROM r WHERE rank <= 20"


add("knn_cosine_all", nearest_of_all, _nearest_of_all_sql("true"))
add("filtered_knn_all", lambda s, d: nearest_of_all(s, d, F.col("label") == 1), _nearest_of_all_sql("label = 1"))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks of the nearest vectors and of the best texts by BM25; a vector and a document of one number are one item."""
    from quire.operators.vectors import Ranking, fuse

    sem = nearest(spark, d).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    rows = search(document_corpus(spark, d), Query(words(B)), score=True).rows
    lex = rows.select("id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(20)
    return fuse(lex, sem, Ranking()).select("id", F.round("score", 8).alias("score"), "source")


_DOC = BASE[: BASE.index("l AS (")] + f"""
l AS (SELECT doc_id AS id, {BASE[BASE.index("trim("):BASE.index("FROM semantic_recipe_v4")].replace("semantic_text", "text")}, NULL AS file_path, NULL AS section FROM documents GROUP BY doc_id),
""" + BASE[BASE.index("t AS (") :]
add("document_index_build", lambda s, d: document_corpus(s, d).lines.agg(F.count("*").alias("lines"), F.sum(F.length("plain")).alias("characters")), "WITH " + _DOC.strip() + "x AS (SELECT 1) SELECT count(*) AS lines, sum(length(plain))::BIGINT AS characters FROM l")
add("hybrid_rrf", hybrid, "WITH " + _DOC.strip() + f"{w('a', B)}, {', '.join(_BM)}, {_QV}, s AS (SELECT vec_id, {_COS} AS x FROM embeddings e, q), k AS (SELECT vec_id AS id, round(x, 6) AS score FROM s ORDER BY x DESC, vec_id LIMIT 20), sr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM k), ls AS (SELECT id, round({_BM_SCORE}, 6) AS score FROM wa JOIN len USING (id), st, da), lr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ls QUALIFY r <= 20) SELECT coalesce(sr.id, lr.id) AS id, round(coalesce(1.0::DOUBLE / (60 + lr.r), 0) + coalesce(1.0::DOUBLE / (60 + sr.r), 0), 8) AS score, CASE WHEN sr.id IS NULL THEN 'lexical' WHEN lr.id IS NULL THEN 'semantic' ELSE 'both' END AS source FROM sr FULL JOIN lr ON sr.id = lr.id")


def recipe_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line once with what its embedded texts are made of."""
    return table(spark, d, "semantic_recipe_v4").groupBy("id").agg(F.min("file_path").alias("file_path"), F.min("ordinal").alias("ordinal"), F.min("section").alias("section"), F.max("semantic_text").alias("text"), F.max("semantic_notes").alias("notes"))


_SAME = "({0}.section IS NOT DISTINCT FROM x.section)"
_SIDES = [f"CASE WHEN {' AND '.join(_SAME.format(n) for n in need)} THEN coalesce({need[-1]}.t, '') END" for need in (["b1", "b2"], ["b1"], ["a1"], ["a1", "a2"])]
add(
    "context_windows",
    lambda s, d: recipe.with_context(recipe_lines(s, d)).select("id", F.md5("context").alias("digest")),
    "WITH r AS (SELECT id, min(file_path) AS f, min(section) AS section, max(semantic_text) AS t, min(ordinal) AS o FROM semantic_recipe_v4 GROUP BY id), n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY o) AS k FROM r), "
    f"j AS (SELECT x.id, x.t, {', '.join(f'{c} AS s{i}' for i, c in enumerate(_SIDES))} FROM n x "
    + " ".join(f"LEFT JOIN n {v} ON {v}.f = x.f AND {v}.k = x.k {k}" for v, k in (("b1", "- 1"), ("b2", "- 2"), ("a1", "+ 1"), ("a2", "+ 2")))
    + " ) SELECT id, md5(CASE WHEN length(trim(t)) < 5 THEN NULL WHEN length(trim(t)) < 20 THEN substr(trim(concat_ws(' ', s0, s1, coalesce(t, ''), s2, s3)), 1, 512) ELSE t END) AS digest FROM j",
)
add("embedding_records", lambda s, d: recipe.embedded(recipe_lines(s, d)).drop("text"))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of an export: what it wrote, held against the keys that any run has put."""
    have = table(spark, d, "vector_record").where("action = 'put'").select("key")
    path = scratch_dir(spark, "plan") + "/plan"
    out = recipe.plan(recipe_lines(spark, d), have, path)
    if wrong := recipe.faults(spark, path):
        raise RuntimeError("; ".join(wrong))
    return spark.createDataFrame([(k, v["rows"]) for k, v in out.items()], "part string, rows long")


add("plan_export", exported)

# display and delivery


def snippet_page(spark: SparkSession, d: str) -> DataFrame:
    p = Paint([frozenset([A])])
    c = corpus(spark, d)
    return attached(c, page(search(c, Query(words(A))).rows, CATALOGUE, 50), "plain").select("id", snippets(p)("plain").alias("text"))


add("snippet_html", snippet_page)


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A page delivered in chunks of 16: the sizes of the chunks."""
    rows = page(search(corpus(spark, d), Query(words(A))).rows, CATALOGUE, 50).select("id")
    return spark.createDataFrame([(i, len(c)) for i, c in enumerate(chunks(rows, 16))], "chunk long, rows long")


add("chunked_page", chunk_sizes, sql(w("a", A), "r AS (SELECT row_number() OVER () - 1 AS i FROM (SELECT DISTINCT id FROM a ORDER BY id LIMIT 50))", select="SELECT i // 16 AS chunk, count(*) AS rows FROM r GROUP BY 1"))
add("event_windows", lambda s, d: windowed_counts(table(s, d, "events"), "ts", "event_type"), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2")
add("spelling_list", lambda s, d: s.createDataFrame([(x,) for x in spelling_variants("קדוש")], "variant string"))


def pattern_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How typed patterns are classified."""
    rows = ["זה", "זה את", "זה.*את", "^גם", "a(?=b)", "(a+)+", "", "x" * 301, r"\bזה\b", "[א-ת]+ה"]
    return spark.createDataFrame([(r[:20], regexes.parse(r).kind) for r in rows], "pattern string, kind string")


add("parse_user_regex", pattern_kinds)

"""Queries of the problems tagged llm, and their SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.leakage import leaks
from quire.llm.lookalikes import canonical_text, lookalike_members, lookalike_pairs
from quire.llm.markup import converted
from quire.llm.near_duplicates import NearDuplicates
from quire.llm.packing import CAPACITY, packed
from quire.llm.quality import STATS, classified
from quire.llm.shared_spans import shared_spans
from quire.llm.splitting import oversized, windows
from quire.session import table


def plain_snippet(text: str):
    """A result snippet without its painting: ``font`` tags deleted, ``<br>`` read as a space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)</?font\b[^>]*>", ""), r"(?i)<br\s*/?>", " ")


def alike(spark: SparkSession, d: str) -> NearDuplicates:
    """The near-duplicate relation over lines and snippets."""
    lines = table(spark, d, "semantic_recipe_v4").select(F.lit("semantic_recipe_v4").alias("tbl"), F.col("id").alias("key"), F.col("semantic_text").alias("body"))
    hits = table(spark, d, "expected_results").select(F.lit("expected_results").alias("tbl"), F.col("result_id").alias("key"), plain_snippet("text").alias("body"))
    return NearDuplicates(lines.unionByName(hits), "key", "body", F.col("tbl"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose texts share at least 0.8 of their words."""
    return alike(spark, d).pairs().withColumnRenamed("part", "tbl")


def p1_linked(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its class of equal texts and the number of records it is alike to."""
    return alike(spark, d).linked().select(F.col("part").alias("tbl"), F.col("key").alias("id"), F.col("rep").alias("class_id"), "links")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Records that are alike, directly or over others, under one group id."""
    return alike(spark, d).groups().select(F.col("part").alias("tbl"), F.col("key").alias("id"), "group_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages longer than a window, found by cutting them."""
    return oversized(table(spark, d, "semantic_recipe_v4"), "id", "semantic_text", "semantic_notes")


def p2_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of every line with such a passage."""
    return windows(table(spark, d, "semantic_recipe_v4"), "id", "semantic_text", "semantic_notes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lines whose raw or indexed texts look the same but differ in their characters."""
    return lookalike_pairs(table(spark, d, "semantic_recipe_v4"), "id", ["raw", "indexed_text"])


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each such line with the class of its skeleton, named by the smallest id in it."""
    rows = lookalike_members(table(spark, d, "semantic_recipe_v4"), "id", ["raw", "indexed_text"])
    first = rows.groupBy("field", "low", "high").agg(F.min("id").alias("class_id"), F.count_distinct("own").alias("spellings"))
    return rows.join(first, ["field", "low", "high"]).select("field", "id", "class_id", "spellings")


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of both texts of every line."""
    rows = table(spark, d, "semantic_recipe_v4").select("id", canonical_text("raw").alias("raw"), canonical_text("indexed_text").alias("indexed_text"))
    return rows.groupBy("id").agg(F.max("raw").alias("raw"), F.max("indexed_text").alias("indexed_text"))


def lines_sharing(spark: SparkSession, d: str) -> DataFrame:
    """Shared spans of the indexed texts."""
    return shared_spans(table(spark, d, "semantic_recipe_v4"), "id", "indexed_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that share a span with another line, and whether it makes up most of them."""
    return lines_sharing(spark, d).select("id", F.when(F.col("covered") * 2 >= F.col("chars"), "most").otherwise("some").alias("extent"))


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """The maximal shared intervals of each line, and the share of the line they make up together."""
    rows = lines_sharing(spark, d)
    return rows.select("id", F.explode("spans").alias("s"), (F.col("covered") / F.col("chars")).alias("share")).select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "share")


def leaking(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation passages in the documents, with places and lengths."""
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items they contain passages of."""
    return leaking(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items that leaked: in how many documents, and the longest passage."""
    return leaking(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that remain when those with evaluation passages are removed."""
    return table(spark, d, "documents").select("doc_id").distinct().join(leaking(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one, with its container."""
    return packed(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be divided, being larger than a container."""
    return p7_packed(spark, d).where("piece = 1").select("doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, and the share of their room that is used."""
    per = p7_packed(spark, d).groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * CAPACITY)).alias("fill"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its statistics, distance from prose and kind."""
    return classified(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_word"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return judged(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document, its distance from prose, and the statistic that contributes most to it."""
    return judged(spark, d).select("doc_id", "language", "words", *STATS, "distance", "far", "parts", "main", "kind")


def p5_converted(spark: SparkSession, d: str) -> DataFrame:
    """The clean text, kinds of markup and labelled blocks of every raw text."""
    return converted(table(spark, d, "semantic_recipe_v4"), "id", "raw", table(spark, d, "common_word"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose raw text has markup, one row for each kind that its blocks have, kept ones and residue alike."""
    return p5_converted(spark, d).select("id", F.explode("blocks.kinds").alias("kinds")).select("id", F.explode("kinds").alias("kind")).distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every raw text, each line once."""
    return p5_converted(spark, d).groupBy("id").agg(F.max("text").alias("text"))


QUERIES = {"p1_found": p1_found, "p1_linked": p1_linked, "p1_groups": p1_groups, "p2_found": p2_found, "p2_windows": p2_windows, "p4_found": p4_found, "p4_classes": p4_classes, "p4_canonical": p4_canonical, "p5_found": p5_found, "p5_clean": p5_clean, "p5_converted": p5_converted, "p6_found": p6_found, "p6_spans": p6_spans, "p8_found": p8_found, "p8_items": p8_items, "p8_clean": p8_clean, "p7_found": p7_found, "p7_packed": p7_packed, "p7_fill": p7_fill, "p9_found": p9_found, "p9_statistics": p9_statistics}
_SPACES = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS = r"regexp_extract_all(regexp_replace({}, '[^\p{{L}}\p{{N}}" + _SPACES.replace("{", "{{").replace("}", "}}") + r"]', '', 'g'), '[\p{{L}}\p{{N}}]+')"

SQL: dict[str, str] = {
    "p1_found": rf"""
        WITH r AS (SELECT DISTINCT 'semantic_recipe_v4' AS tbl, id, semantic_text AS t FROM semantic_recipe_v4
                   UNION ALL SELECT DISTINCT 'expected_results', result_id, regexp_replace(regexp_replace(text, '(?i)</?font\b[^>]*>', '', 'g'), '(?i)<br\s*/?>', ' ', 'g') FROM expected_results),
        w AS (SELECT tbl, id, unnest({_WORDS.format('t')}) AS w FROM r),
        c AS (SELECT tbl, id, w, count(*) AS n FROM w GROUP BY ALL),
        s AS (SELECT tbl, id, sum(n) AS s FROM c GROUP BY ALL HAVING sum(n) >= 12),
        e AS (SELECT tbl, id, w, unnest(range(n)) AS k FROM c JOIN s USING (tbl, id)),
        j AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS c FROM e a JOIN e b ON a.tbl = b.tbl AND a.w = b.w AND a.k = b.k AND a.id < b.id GROUP BY ALL)
        SELECT j.tbl, id_a, id_b FROM j JOIN s x ON x.tbl = j.tbl AND x.id = id_a JOIN s y ON y.tbl = j.tbl AND y.id = id_b WHERE 9 * c >= 4 * (x.s + y.s)""",
    "p6_found": """
        WITH l AS (SELECT DISTINCT id, indexed_text AS t FROM semantic_recipe_v4 WHERE length(indexed_text) >= 60),
        w AS (SELECT id, length(t) AS n, t, unnest(range(1, length(t) - 58)) AS p FROM l),
        s AS (SELECT id, n, p, substr(t, p, 60) AS s FROM w),
        h AS (SELECT id, n, p FROM s WHERE s IN (SELECT s FROM s GROUP BY s HAVING min(id) <> max(id))),
        q AS (SELECT id, n, p, lag(p) OVER (PARTITION BY id ORDER BY p) AS b FROM h)
        SELECT id, CASE WHEN 2 * sum(CASE WHEN b IS NULL THEN 60 ELSE least(60, p - b) END) >= n THEN 'most' ELSE 'some' END AS extent FROM q GROUP BY id, n""",
    "p8_found": rf"""
        WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format('lower(nfc_normalize(text))')} AS w FROM documents),
        i AS (SELECT DISTINCT item_id, {_WORDS.format('lower(nfc_normalize(text))')} AS w FROM eval_item),
        x AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d),
        y AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)
        SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM x) JOIN (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM y) USING (g)""",
    "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 8192",
    "p2_found": """
        WITH p AS (SELECT id, unnest(list_concat([semantic_text], coalesce(semantic_notes, []))) AS t,
                          generate_subscripts(list_concat([semantic_text], coalesce(semantic_notes, [])), 1) - 1 AS passage FROM semantic_recipe_v4)
        SELECT DISTINCT id, CAST(passage AS INTEGER) AS passage FROM p WHERE length(t) > 512""",
}

SQL["p8_clean"] = f"SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({SQL['p8_found']}))"
# consecutive windows of twelve words on one diagonal are one passage
SQL["p8_items"] = rf"""
    WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format('lower(nfc_normalize(text))')} AS w FROM documents),
    i AS (SELECT DISTINCT item_id, {_WORDS.format('lower(nfc_normalize(text))')} AS w FROM eval_item),
    x AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d),
    y AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS q FROM i),
    m AS (SELECT DISTINCT doc_id, item_id, p, q FROM (SELECT doc_id, p, array_to_string(w[p:p + 11], ' ') AS g FROM x) JOIN (SELECT item_id, q, array_to_string(w[q:q + 11], ' ') AS g FROM y) USING (g)),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM m),
    n AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, p - q, run)
    SELECT item_id, count(DISTINCT doc_id) AS documents, max(words)::INTEGER AS longest FROM n GROUP BY item_id"""
SQL["p6_spans"] = SQL["p6_found"][: SQL["p6_found"].index("SELECT id, CASE")].rstrip() + """,
    b AS (SELECT *, sum(CASE WHEN b IS NULL OR p - b > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS span FROM q),
    z AS (SELECT id, n, min(p) - 1 AS first, max(p) + 59 AS last FROM b GROUP BY id, n, span)
    SELECT id, first::INTEGER AS start, last::INTEGER AS "end", sum(last - first) OVER (PARTITION BY id) / n AS share FROM z"""
SQL["p1_linked"] = rf"""
    WITH pairs AS ({SQL['p1_found']}),
    r AS (SELECT DISTINCT 'semantic_recipe_v4' AS tbl, id, semantic_text AS t FROM semantic_recipe_v4
          UNION ALL SELECT DISTINCT 'expected_results', result_id, regexp_replace(regexp_replace(text, '(?i)</?font\b[^>]*>', '', 'g'), '(?i)<br\s*/?>', ' ', 'g') FROM expected_results),
    w AS (SELECT tbl, id, list_sort({_WORDS.format('t')}) AS w FROM r),
    c AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, w) AS class_id FROM w WHERE len(w) >= 12),
    e AS (SELECT tbl, id_a AS id FROM pairs UNION ALL SELECT tbl, id_b FROM pairs),
    n AS (SELECT tbl, id, count(*) AS links FROM e GROUP BY ALL)
    SELECT tbl, id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN n USING (tbl, id)"""

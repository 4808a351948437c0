"""Dictionaries that widen a word: forms of one base, translations, acronyms, and what highlighting must not paint."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.words import FINALS, fold_word, split_words

#: How many forms a word gains by each way through the morphology, and in all.
BY_BASE, BY_SURFACE, BY_VARIANT, IN_ALL = 24, 8, 4, 32
TRANSLATIONS = 16
ACRONYM = "acronym string, expansion string"
TRANSLATION = "dictionary string, headword string, gloss string"


def key_of(word: str) -> str:
    """A word as the morphology has it: no quotes, no marks, final letters in their usual form."""
    return "".join(FINALS.get(c, c) for c in re.sub("['\"]", "", fold_word(word)))


class Morphology:
    """base(id, value), surface(id, value, base_id), variant(id, value), surface_variant(surface_id, variant_id)."""

    def __init__(self, base: DataFrame, surface: DataFrame, variant: DataFrame | None = None, surface_variant: DataFrame | None = None):
        self.base, self.surface, self.variant, self.surface_variant = base, surface, variant, surface_variant

    def forms(self, words: list[str]) -> DataFrame:
        """(word, form, route): the forms of each word, at most 24 over its base, 8 as a surface form of it, 4 over a
        variant spelling, 32 in all; nearest length first. Words the dictionary doesn't know have none."""
        spark = self.base.sparkSession
        asked = spark.createDataFrame([(w, key_of(w)) for w in dict.fromkeys(words)], "word string, k string")
        s = self.surface.select(F.col("id").alias("sid"), F.col("value").alias("form"), "base_id")
        b = self.base.select(F.col("id").alias("base_id"), F.col("value").alias("base"))
        own = asked.join(s, F.col("k") == F.col("form")).select("word", "k", "base_id")
        over_base = asked.join(b, F.col("k") == F.col("base")).select("word", "k", "base_id")
        routes = [(own.unionByName(over_base).distinct().join(s, "base_id").select("word", "k", "form"), 0, BY_BASE), (own.join(b, "base_id").select("word", "k", F.col("base").alias("form")), 1, BY_SURFACE)]
        if self.variant is not None and self.surface_variant is not None:
            v = self.variant.select(F.col("id").alias("vid"), F.col("value").alias("spelling"))
            link = self.surface_variant.select(F.col("surface_id").alias("sid"), F.col("variant_id").alias("vid"))
            by_variant = asked.join(v, F.col("k") == F.col("spelling")).join(link, "vid").join(s, "sid").where(F.col("form").substr(1, 1) == F.col("k").substr(1, 1)).select("word", "k", "form")
            routes.append((by_variant, 2, BY_VARIANT))
        out = None
        for df, route, cap in routes:
            ranked = df.where("form <> k").distinct().withColumn("n", F.row_number().over(W.partitionBy("word").orderBy(F.abs(F.length("form") - F.length("k")), "form"))).where(F.col("n") <= cap)
            part = ranked.select("word", "form", F.lit(route).alias("route"), "n")
            out = part if out is None else out.unionByName(part)
        once = out.groupBy("word", "form").agg(F.min("route").alias("route"), F.min("n").alias("n"))
        return once.withColumn("m", F.row_number().over(W.partitionBy("word").orderBy("route", "n", "form"))).where(F.col("m") <= IN_ALL).select("word", "form", "route")


def without_blacklisted(forms: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Forms less the (token, base) pairs that highlighting must not paint; recall keeps them."""
    return forms.join(blacklist.select(F.col("token").alias("form"), F.col("base").alias("word")).distinct(), ["form", "word"], "left_anti").select(*forms.columns)


def glosses(gloss: str) -> list[str]:
    """The single words of a gloss: parted at commas, semicolons and slashes, bracketed remarks left out."""
    plain = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", gloss or "")
    return list(dict.fromkeys(w[0] for part in re.split(r"[,;/]", plain) if len(w := split_words(part)) == 1))


def translation_pairs(translations: DataFrame) -> DataFrame:
    """(word, other) in both directions, single words only."""
    part = F.split(F.regexp_replace(F.coalesce("gloss", F.lit("")), r"\([^()]*\)|\[[^\[\]]*\]", " "), "[,;/]")
    one = translations.select(F.trim("headword").alias("a"), F.explode(part).alias("b")).select("a", F.trim(F.regexp_replace("b", r"[.!?:]", "")).alias("b")).where("a <> '' AND b <> '' AND NOT a LIKE '% %' AND NOT b LIKE '% %'")
    return one.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(one.select(F.col("b").alias("word"), F.col("a").alias("other"))).distinct()


def translated(pairs: DataFrame, words: list[str]) -> dict[str, list[str]]:
    """Up to sixteen translations of each word, shortest first."""
    rows = pairs.where(F.col("word").isin(words)).withColumn("n", F.row_number().over(W.partitionBy("word").orderBy(F.length("other"), "other"))).where(F.col("n") <= TRANSLATIONS).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r.n):
        out.setdefault(r.word, []).append(r.other)
    return out


def acronym_queries(acronyms: DataFrame, words: list[str]) -> list[list[str]]:
    """The other wordings of a query by its acronyms, each a list of words: a word that is an acronym written out, and a run
    of words that some acronym stands for replaced by it. Expansions of a single word are skipped."""
    rows = acronyms.where(F.col("acronym").isin(words) | F.lit(" ".join(words)).contains(F.trim("expansion"))).select("acronym", "expansion").distinct().orderBy("acronym", "expansion").collect()
    out = []
    for r in rows:
        full, short = split_words(r.expansion), split_words(r.acronym)
        if len(full) < 2 or len(short) != 1:
            continue
        for i, w in enumerate(words):
            if w == short[0]:
                out.append(words[:i] + full + words[i + 1 :])
        for i in range(len(words) - len(full) + 1):
            if words[i : i + len(full)] == full:
                out.append(words[:i] + short + words[i + len(full) :])
    return [list(x) for x in dict.fromkeys(map(tuple, out))]


def load_json(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """A lexicon file: acronyms {acronym: [expansion]} or translations {dictionary: [{headword: gloss}]}. A file that is
    missing or broken is no dictionary."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if kind == "acronym":
            rows = [(a, e) for a, many in data.items() for e in many]
            return spark.createDataFrame(rows, ACRONYM)
        rows = [(d, h, g) for d, entries in data.items() for entry in entries for h, g in entry.items()]
        return spark.createDataFrame(rows, TRANSLATION)
    except (OSError, ValueError, AttributeError, TypeError):
        return None


def load_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """(token, base) of a tab-separated file with ``#`` comments."""
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT value LIKE '#%'")
    return rows.select(F.trim(F.split("value", "\t")[0]).alias("token"), F.trim(F.get(F.split("value", "\t"), F.lit(1))).alias("base")).where("base IS NOT NULL")


def load_morphology(spark: SparkSession, path: str) -> Morphology | None:
    """The four tables of a dictionary database, read on the driver (they are a dictionary, not data). A file in which one
    of the needed tables or columns is missing is no dictionary."""
    import sqlite3

    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            get = lambda sql, ddl: spark.createDataFrame(db.execute(sql).fetchall(), ddl)
            return Morphology(get("SELECT id, value FROM base", "id long, value string"), get("SELECT id, value, base_id FROM surface", "id long, value string, base_id long"), get("SELECT id, value FROM variant", "id long, value string"), get("SELECT surface_id, variant_id FROM surface_variant", "surface_id long, variant_id long"))
    except sqlite3.Error:
        return None

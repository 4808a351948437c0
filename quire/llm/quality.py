"""Per-document text statistics, and how far they lie from running prose of the document's language.

Every document gets a vector of statistics. Per language (told by its frequent words, not by the delivered code), the
centre and covariance of prose are estimated robustly from the documents that are no lists, tables or junk by their lines,
copies counted once: medians and median deviations first, then means and covariances over the documents that lie near,
twice. The Mahalanobis distance to that centre says how unusual a document is, and splits into one contribution a
statistic. Documents beyond the threshold are outliers; those whose lines of a list, of a table or of no readable language
add to the distance are candidates for that kind, and an exact count (more than half of the lines) decides on them. The
sift loses none: the spread of a share of lines is that of prose near the centre, where half of all lines is far off.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import list_array
from quire.session import cut

STATS = ["log_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "distinct_words", "single_letters", "digit_ratio", "list_lines", "table_lines", "unreadable_lines"]
#: The least spread of a statistic: shares that are constant in prose would make any deviation infinite.
FLOOR = [0.3, 0.3, 0.02, 0.10, 0.05, 0.05, 0.02, 0.02, 0.05, 0.05, 0.05]
#: Squared distances beyond this are outliers: the 0.999 quantile of chi squared with 11 degrees of freedom.
FAR = 31.26
#: Frequent-word lists hold a few hundred words a language; more than this and they are no such lists.
MAX_COMMON = 20_000
UNKNOWN = "und"

_LIST_START = re.compile(r"\s*(?:[-*+•·▪◦‣●○]|\(?\d{1,3}[.)]|\([^\W\d_]{1,3}['\"׳״]?[^\W\d_]?\)|[^\W\d_]['׳]?[.)])\s+\S")
_LIST_END = re.compile(r"(?:\.{4,}|…{2,}|(?:\s\.){4,})\s*\d+\s*$|[^\W\d_].*?(?:,\s*\d{1,4}(?:[-–]\d{1,4})?)+\s*$")
_GAPS = re.compile(r"(?<=\S) {2,}(?=\S)")
_SEMICOLONS = re.compile(r"\S[^;]*(?:;[^\s;][^;]*){2,}$")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"’‘“”׳״׃()\[\]–—\-־|│*•/]")
_NOT_TEXT = re.compile(r"[^\w\s]")
_MARKS = re.compile("[\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7\u0300-\u036f]+")
_DIGIT = re.compile(r"\d")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„–—…׃׳״־•·│□�†‡§¶"
_END = tuple(".?!:;׃…")
_CLOSING = "\"'”’״׳)]"


def is_table_row(line: str) -> bool:
    """Whether a line is cells with separators: bars, tabs, semicolons without space, or columns parted by spaces."""
    body = line.strip()
    if "│" in body or "┃" in body:
        cells = body.replace("┃", "│").split("│")
    elif body[:1] == body[-1:] == "|" and len(body) > 2:
        cells = body[1:-1].split("|")
    elif "\t" in body:
        cells = body.split("\t")
    elif "  " in body and len(wide := _GAPS.split(body)) > 2:
        cells = wide
    elif ";" in body and _SEMICOLONS.match(body):
        cells = body.split(";")
    else:
        return False
    cells = [c.strip() for c in cells if c.strip()]
    if len(cells) < 2:
        return False
    good = sum(1 for c in cells if c.count(" ") < 4 and len(_NOT_TEXT.findall(c)) * 2 < len(c))
    return good >= 0.8 * len(cells)


def is_unreadable(tokens: Sequence[str], line: str, hits: int) -> bool:
    """Whether a line is no language: mostly signs, single letters, codes, one word again and again, or letters at random."""
    n, letters = len(tokens), sum(map(len, tokens))
    ink = sum(map(len, line.split()))
    if ink >= 8 and len(_NOT_TEXT.findall(line)) > 0.4 * ink:
        return True
    if not n:
        return ink >= 8
    if n >= 3 and sum(1 for t in tokens if len(t) == 1) > 0.6 * n:
        return True
    if n >= 6 and len(set(tokens)) <= min(10, max(1, n // 5)):
        return True
    if hits:
        return False
    if n >= 6 and letters <= 3 * n and sum(1 for t in tokens if not t.isalpha() and not t.isdigit()) > 0.2 * n:
        return True
    return letters > 22 * n or (n >= 2 and letters > 10.5 * n)


class Common:
    """Frequent words: word -> the languages that have it."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.langs: dict[str, tuple[str, ...]] = {}
        for lang, word in sorted(pairs):
            w = _MARKS.sub("", word).lower()
            self.langs[w] = (*self.langs.get(w, ()), lang)


def measure(text: str, common: Common) -> tuple[str, int, list[float]]:
    """The language, the number of words and STATS of one text."""
    get = common.langs.get
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    clean = _MARKS.sub("", text).lower() if not text.isascii() else text.lower()
    words, hits, as_list, as_table, unreadable, ended = [], Counter(), 0, 0, 0, 0
    for line in clean.split("\n"):
        if not line or line.isspace():
            continue
        found = [w for t in line.split() if (w := t.strip(_STRIP))]
        words += found
        known = 0
        for w in found:
            if (langs := get(w)) is not None:
                known += 1
                for lang in langs:
                    hits[lang] += 1
        line = line.rstrip()
        ended += line.rstrip(_CLOSING).endswith(_END)
        bad = is_unreadable(found, line, known)
        if is_table_row(line):
            as_table += 1
        elif (not bad and _LIST_START.match(line)) or (line[-1].isdigit() and _LIST_END.search(line)):
            as_list += 1
        elif bad:
            unreadable += 1
    n = len(words)
    lang = min(hits, key=lambda x: (-hits[x], x)) if hits else UNKNOWN
    ink, k = sum(map(len, text.split())) or 1, len(lines) or 1
    letters = sum(map(len, words))
    symbols = len(_SYMBOL.findall(clean))
    stats = [math.log1p(n), letters / n if n else 0.0, symbols / ink, ended / k, hits[lang] / n if n else 0.0, len(set(words)) / n if n else 0.0, sum(1 for w in words if len(w) == 1) / n if n else 0.0, len(_DIGIT.findall(text)) / ink, as_list / k, as_table / k, unreadable / k]
    return lang, n, stats


def _measured(common: Common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [measure(t, common) for t in batch.column(1).to_pylist()]
            x = np.array([s for _, _, s in out], dtype=np.float64).reshape(len(out), len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), *(pa.array(x[:, i]) for i in range(len(STATS)))], ["doc_id", "language", "words", *STATS])

    return run


def statistics(df: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    """(doc_id, language, words, *STATS) of every document with a text.

    Null keys and texts are left out; an empty text has zeros everywhere and no language; rows that repeat a key and its
    text come out once. ``common`` (lang, word) is read by the driver after a check of its size.
    """
    rows = common.select("lang", "word").where("lang IS NOT NULL AND word IS NOT NULL").distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} frequent words")
    known = Common((lang, word) for lang, word in rows)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return docs.mapInArrow(_measured(known), "doc_id long, language string, words long, " + ", ".join(f"{s} double" for s in STATS)).distinct()


def of_prose(stats: DataFrame) -> DataFrame:
    """(language, *STATS) of the documents of a language of which no more than half of the lines are entries of a list, rows
    of a table or unreadable, taken together. Documents with the same statistics throughout, as copies have, come out once."""
    known = stats.where((F.col("language") != UNKNOWN) & (F.col("list_lines") + F.col("table_lines") + F.col("unreadable_lines") <= 0.5))
    return known.select("language", *STATS).distinct()


class Prose:
    """Centre and inverse covariance of prose for each language; a few numbers a language, held by the driver."""

    def __init__(self, stats: DataFrame, rounds: int = 2):
        known = cut(of_prose(stats)).withColumn("doc_id", F.lit(None).cast("long")).withColumn("words", F.lit(None).cast("long"))
        stats = known.unionByName(known.withColumn("language", F.lit(UNKNOWN)))  # texts of no language are held against all prose
        mid = self._medians(stats)
        off = stats.select("doc_id", "language", "words", *STATS).mapInArrow(_with_model(mid, lambda x, m: np.abs(x - m)), "language string, " + ", ".join(f"{s} double" for s in STATS))
        dev = self._medians(off)
        floor = np.array(FLOOR)
        self.models = {lang: (m, np.diag(1 / np.maximum(1.4826 * dev[lang], floor) ** 2)) for lang, m in mid.items()}
        k = len(STATS)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        for _ in range(rounds):  # the documents near the centre give the next centre
            near = self.distances(stats).where(F.col("distance") <= FAR)
            products = (F.avg(F.col(STATS[i]) * F.col(STATS[j])) for i, j in pairs)
            for r in near.groupBy("language").agg(*(F.avg(s) for s in STATS), *products).collect():
                mean, cov = np.array(r[1 : 1 + k], dtype=float), np.zeros((k, k))
                for (i, j), v in zip(pairs, r[1 + k :], strict=True):
                    cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
                self.models[r[0]] = (mean, np.linalg.inv(cov + np.diag(floor**2)))

    @staticmethod
    def _medians(stats: DataFrame) -> dict[str, np.ndarray]:
        rows = stats.groupBy("language").agg(*(F.percentile_approx(s, 0.5, 1000) for s in STATS)).collect()
        return {r[0]: np.array(r[1:], dtype=float) for r in rows}

    def distances(self, stats: DataFrame) -> DataFrame:
        """``stats`` with ``parts``, the contribution of each statistic, and ``distance``, the squared Mahalanobis distance.

        With S the inverse covariance and x the deviation, statistic i contributes x_i * (S x)_i; the parts add up to the
        distance. A part can be slightly negative where correlated statistics explain each other. Documents of a language
        without prose are held against all prose; where there is no prose at all, no document has a distance.
        """
        schema = "doc_id long, language string, words long, " + ", ".join(f"{s} double" for s in STATS) + ", parts array<double>, distance double"
        return stats.select("doc_id", "language", "words", *STATS).mapInArrow(_distances(self.models), schema)


def _with_model(models: dict[str, np.ndarray], make):
    """mapInArrow: (doc_id, language, words, *STATS) -> (language, *STATS), the values made from each row and its language's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_pylist()
            if langs:
                x = make(_values(b), np.array([models[lang] for lang in langs]))
                yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, i]) for i in range(len(STATS)))], ["language", *STATS])

    return run


def _values(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))])


def _distances(models: dict[str, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, langs = _values(b), np.array(b.column(1).to_pylist(), dtype=object)
            parts = np.full(x.shape, np.nan)
            for lang in set(langs):
                if (model := models.get(lang, models.get(UNKNOWN))) is not None:
                    at = langs == lang
                    d = x[at] - model[0]
                    parts[at] = d * (d @ model[1])
            total, known = parts.sum(axis=1), ~np.isnan(parts[:, 0]) if len(parts) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, list_array(np.arange(len(x) + 1) * len(STATS), parts.ravel()), pa.array(total, mask=~known)], [*b.schema.names, "parts", "distance"]
            )

    return run


KINDS = {"list": "list_lines", "table": "table_lines", "junk": "unreadable_lines"}


def outliers(stats: DataFrame, prose: Prose | None = None) -> DataFrame:
    """Each document with its distance, the statistic that contributes most, and its kind: (doc_id, language, words,
    distance, far, parts, main, kind, *STATS).

    ``far`` documents lie beyond the threshold (or there is no prose to hold them against). Of these, one is of the kind
    ``list``, ``table`` or ``junk`` if its lines of that kind add to the distance and are more than half of its lines; all
    others are ``prose``: unusual, but running text.
    """
    scored = (prose or Prose(stats)).distances(stats).withColumn("far", F.coalesce(F.col("distance") > FAR, F.lit(True)))
    largest = F.array_position("parts", F.array_max("parts"))
    kind = F.lit("prose")
    for name, share in KINDS.items():
        adds = F.coalesce(F.get("parts", F.lit(STATS.index(share))) > 0, F.lit(True)) | F.col("distance").isNull()
        kind = F.when(F.col("far") & adds & (F.col(share) > 0.5), name).otherwise(kind)
    return scored.select("doc_id", "language", "words", "distance", "far", "parts", F.element_at(F.array(*map(F.lit, STATS)), largest.cast("int")).alias("main"), kind.alias("kind"), *STATS)


def classified(df: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    """statistics() and outliers() in one, the statistics written once."""
    return outliers(cut(statistics(df, key, text, common)))

"""Regular expressions typed by users: told apart by shape, each kind matched in its own way.

A pattern without white space is matched against whole terms of the dictionary; one whose parts are parted by spaces is a
phrase of such patterns; one in which a space can be matched inside a construct runs over the folded line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quire.functions import text as T
from quire.functions.words import EXACT, Branch, WordPlan, is_plain_word
from quire.operators.corpus import Corpus
from quire.operators.expand import Expansion
from quire.operators.search import CATALOGUE, Hits, Query, facet_filter, from_postings, order_keys, search
from quire.session import cut

MAX_CHARS = 300
INVALID, SINGLE_WORD, WORD_SEQUENCE, CROSS_SPACE = "invalid", "singleWord", "wordSequence", "crossSpace"
#: What Java reads otherwise than a linear-time engine, or not at all: look-around, back-references, possessive and
#: atomic groups, lazy repeats, inline comments.
_FOREIGN = re.compile(r"\(\?(?!:)|\\[1-9kgAzZGKQE]|[*+?}][+?]|\[\[:|&&")
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[*+](?:[^()\\]|\\.)*\)(?:[*+]|\{\d+,\d*\})")


@dataclass
class UserRegex:
    """A parsed pattern: its kind, the parts of a sequence, what a line pattern is anchored to, or why it is invalid."""

    kind: str
    parts: list[str] = field(default_factory=list)
    at_start: bool = False
    at_end: bool = False
    reason: str = ""
    words: list[str] = field(default_factory=list)


def fold_pattern(raw: str) -> str:
    """The pattern as the index has text: no marks, ASCII quotes, lower case outside escapes."""
    out, i = [], 0
    folded = raw.translate(T._QUOTES)
    while i < len(folded):
        if folded[i] == "\\" and i + 1 < len(folded):
            out.append(folded[i : i + 2])
            i += 2
        else:
            out.append(T.fold_word(folded[i]) if folded[i] not in "''" else folded[i])
            i += 1
    return "".join(out)


def _spaces_outside(p: str) -> list[int] | None:
    """Places of spaces that stand by themselves; None if a space can be matched inside a construct."""
    depth, in_class, i, out = 0, False, 0, []
    while i < len(p):
        c = p[i]
        if c == "\\":
            if i + 1 < len(p) and p[i + 1] in "sSWDn":
                return None
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c.isspace() or c == "^" and p[i - 1] == "[":
                return None  # a class that holds a space, or a negated one, which matches it
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == ".":
            return None
        elif c.isspace():
            if depth or (i + 1 < len(p) and p[i + 1] in "*+?{"):
                return None
            out.append(i)
        i += 1
    return out


def parse(raw: str) -> UserRegex:
    """Classify a typed pattern. Edge spaces and word boundaries are dropped; anchors on the wrong side, look-around,
    back-references, nested repeats and patterns over 300 characters are invalid."""
    if len(raw) > MAX_CHARS:
        return UserRegex(INVALID, reason="too long")
    p = fold_pattern(raw.strip())
    start = p.startswith("^")
    end = p.endswith("$") and not p.endswith("\\$")
    p = (p[1:] if start else p)
    p = (p[:-1] if end else p)
    p = re.sub(r"^(?:\\b|\s)+|(?:\\b|\s)+$", "", p)
    if not p:
        return UserRegex(INVALID, reason="empty")
    plain = re.sub(r"\\.|\[\^?[^\]]*\]", "", p)
    if "^" in plain or "$" in plain:
        return UserRegex(INVALID, reason="anchor inside")
    if _FOREIGN.search(p):
        return UserRegex(INVALID, reason="unsupported construct")
    if _NESTED.search(p):
        return UserRegex(INVALID, reason="nested repeat")
    try:
        re.compile(p)
    except re.error as e:
        return UserRegex(INVALID, reason=str(e))
    if re.fullmatch(p, ""):
        return UserRegex(INVALID, reason="matches nothing")
    spaces = _spaces_outside(p)
    top_or = "|" in re.sub(r"\\.|\[[^\]]*\]|\((?:[^()\\]|\\.)*\)", "", p)
    if spaces is None or start or end or (spaces and top_or):
        return UserRegex(CROSS_SPACE, [p], start, end, words=required_words(p))
    parts = [x for x in re.split(r"\s+", p) if x]
    parts = [re.sub(r"^(?:\\b)+|(?:\\b)+$", "", x) for x in parts]
    return UserRegex(SINGLE_WORD if len(parts) == 1 else WORD_SEQUENCE, parts)


def required_words(p: str) -> list[str]:
    """Whole words that every match of a line pattern must hold: literal runs between literal spaces at top level."""
    if "|" in re.sub(r"\\.|\[[^\]]*\]|\((?:[^()\\]|\\.)*\)", "", p):
        return []
    flat = re.sub(r"\((?:[^()\\]|\\.)*\)(?:[*+?]|\{[^}]*\})?|\[[^\]]*\](?:[*+?]|\{[^}]*\})?|\\.(?:[*+?]|\{[^}]*\})?|.(?:[*+?]|\{[^}]*\})", "\0", p)
    pieces = flat.split(" ")
    return [w for w in pieces[1:-1] if is_plain_word(w)]


def plan(r: UserRegex) -> Query:
    """The word query of a single-word or sequence pattern."""
    return Query([WordPlan(x, [Branch(x, EXACT)]) for x in r.parts], [0] * (len(r.parts) - 1))


_EDGE = r"(?<![\p{L}\p{N}])"
_EDGE_END = r"(?![\p{L}\p{N}])"


def line_pattern(r: UserRegex) -> str:
    """The Java pattern of a line expression; it begins and ends at word boundaries where it has letters there."""
    first = _EDGE if re.match(r"[^\W_]|\(|\[", r.parts[0]) else ""
    last = _EDGE_END if re.search(r"[^\W_)\]*+?}]$|[)\]]$", r.parts[0]) else ""
    body = f"{first}(?:{r.parts[0]}){last}"
    return (r"^\s*" if r.at_start else "") + body + (r"\s*$" if r.at_end else "")


def matched(c: Corpus, raw: str, facets: list[str] | None = None, terms: DataFrame | None = None, limit: int | None = None) -> Hits:
    """The lines a typed pattern matches; an invalid pattern is an error. A line pattern never crosses a line; its anchors
    also hold behind and before enumerators. Words that every match must hold narrow the lines before the pattern runs.
    Of more than ``limit`` lines the first in catalogue order are kept, chosen once, and the result is marked truncated."""
    r = parse(raw)
    if r.kind == INVALID:
        raise ValueError(f"invalid pattern: {r.reason}")
    if r.kind != CROSS_SPACE:
        q = plan(r)
        q.facets = facets or []
        return search(c, q, terms)
    rows = c.wide()
    where = facet_filter(facets or [])
    if where is not None:
        rows = rows.where(where)
    if r.words and c.stored is not None:  # lines without these words are never read for their text
        holds = from_postings(c, [Expansion(w, {w: (EXACT, 0)}) for w in r.words]).where(" AND ".join(f"size(w{i}) > 0" for i in range(len(r.words))))
        rows = rows.join(holds.select("id"), "id", "left_semi")
    elif r.words:
        rows = rows.where(F.forall(F.array(*map(F.lit, r.words)), lambda w: F.array_contains("tokens", w)))
    folded = T.foldable(F.col("plain"))
    pattern = line_pattern(r)
    hit = folded.rlike(pattern)
    if r.at_start or r.at_end:
        hit = hit | F.trim(T.content(folded)).rlike(pattern)
    zero = (F.lit(0).alias("tier"), F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("span"), F.lit(False).alias("crosses"))
    found = rows.where(hit).select("*", *zero)
    if limit is None:
        return Hits(found, False, [])
    first = cut(found.orderBy(*order_keys(CATALOGUE)).limit(limit + 1))
    truncated = first.count() > limit
    return Hits(cut(first.orderBy(*order_keys(CATALOGUE)).limit(limit)) if truncated else first, truncated, [])


_RANGE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def range_udf(raw: str):
    """A pandas UDF: the places a pattern matches in a text, in UTF-16 units; a sequence gives one range a word."""
    r = parse(raw)
    if r.kind == INVALID:
        raise ValueError(f"invalid pattern: {r.reason}")
    word = r"[^\W_]"
    body = r"[\s]+".join(f"({x})" for x in r.parts)
    compiled = re.compile(f"(?<!{word})(?:{body})(?!{word})")

    @F.pandas_udf(ArrayType(_RANGE))
    def ranges(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return []
            at = [0]
            for ch in text:
                at.append(at[-1] + (2 if ord(ch) > 0xFFFF else 1))
            return [{"start": at[m.start(g)], "end": at[m.end(g)]} for m in compiled.finditer(text.translate(T._QUOTES).lower()) for g in range(1, len(r.parts) + 1)]

        return s.map(one)

    return ranges

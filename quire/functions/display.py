"""What a hit looks like: painted snippets, highlight patterns for a display, and notes marked in a text.

These are pandas UDFs over the few rows of a page, never part of a search. Offsets given to a display are UTF-16 units.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.functions.text import COMBINING, INVISIBLE, MARKS, _PY_TOKEN, _QUOTES
from quire.functions.words import WordPlan, any_order_span, options_at, plan_word, resolve_gaps, split_words

OPEN, CLOSE, LENGTH = "<font color=red>", "</font>", 800
SEAM = "<br>"
MAX_WINDOWS, JOINER = 8, " … "
_NOTHING = re.compile(f"[{INVISIBLE}{COMBINING}]")


@dataclass
class Paint:
    """What to paint: for each word the terms it matched; gaps of an ordered phrase, or the span of a window."""

    words: list[frozenset[str]]
    gaps: list[int] | None = None
    span: int | None = None

    @property
    def phrase(self) -> bool:
        return len(self.words) > 1 and (self.gaps is not None or self.span is not None)


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """The tokens of a text as the index has them, each with its place."""
    return [(_NOTHING.sub("", re.sub(f"[{MARKS}]", "", m[0])).replace("''", '"'), m.start(), m.end()) for m in _PY_TOKEN.finditer(text.translate(_QUOTES).lower())] if len(text.lower()) == len(text) else [(m[0].lower().replace("''", '"'), m.start(), m.end()) for m in _PY_TOKEN.finditer(text.translate(_QUOTES))]


def _known(token: str, terms: frozenset[str]) -> bool:
    return token in terms


def occurrences(tokens: Sequence[str], p: Paint) -> list[list[int]]:
    """Complete occurrences as token numbers. One word occurs wherever it stands; a phrase only in order within its gaps,
    or with all words in a window; words may be shared by overlapping occurrences."""
    at = [[i for i, t in enumerate(tokens) if _known(t, w)] for w in p.words]
    if not p.phrase:
        return [[i] for i in sorted({i for w in at for i in w})]
    if not all(at):
        return []
    if p.span is not None:
        from quire.operators.search import _assign

        out = []
        for lo in sorted({i for w in at for i in w}):
            near = [[i for i in w if lo <= i <= lo + p.span] for w in at]
            if all(near) and any(lo in w for w in near) and _assign(near):
                out.append(sorted({i for w in near for i in w}))
        return out
    out = []
    for first in at[0]:
        paths = [[first]]
        for w, gap in zip(at[1:], p.gaps or [0] * (len(at) - 1), strict=True):
            paths = [[*path, i] for path in paths for i in w if path[-1] < i <= path[-1] + gap + 1][:64]
        out += paths[:1]
    return out


def _crop(text: str, first: tuple[int, int], length: int) -> tuple[int, int]:
    """A stretch of at most ``length`` characters around an occurrence, at white space or the ends of words."""
    if len(text) <= length:
        return 0, len(text)
    a, b = first
    room = max(0, length - (b - a))
    lo, hi = max(0, a - room // 2), min(len(text), b + room - room // 2)
    lo, hi = max(0, min(lo, len(text) - length)), min(len(text), max(hi, length))
    hi = min(hi, lo + length)
    word = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    while lo < a and (word(lo) or (lo and not text[lo].isalnum() and not text[lo].isspace())):
        lo += 1
    while hi > b and word(hi):
        hi -= 1
    while lo < a and text[lo].isspace():
        lo += 1
    while hi > b and text[hi - 1].isspace():
        hi -= 1
    return lo, hi


def snippet_html(text: str, p: Paint, length: int = LENGTH, open_: str = OPEN, close: str = CLOSE) -> str:
    """The text around the first occurrence, escaped, with the words of complete occurrences painted."""
    spans = token_spans(text)
    found = occurrences([t for t, _, _ in spans], p)
    lo, hi = (0, min(len(text), length)) if not found else _crop(text, (spans[found[0][0]][1], spans[found[0][-1]][2]), length)
    inside = {i for o in found if all(lo <= spans[j][1] and spans[j][2] <= hi for j in o) for i in o}
    out, at = [], lo
    for i in sorted(inside):
        _, a, b = spans[i]
        out.append(html.escape(text[at:a], quote=False) + open_ + html.escape(text[a:b], quote=False) + close)
        at = b
    return "".join(out) + html.escape(text[at:hi], quote=False)


def page_snippet_html(text: str, p: Paint, length: int = LENGTH) -> str:
    """A long page as up to eight painted stretches."""
    spans = token_spans(text)
    found = occurrences([t for t, _, _ in spans], p)
    if len(text) <= length or not found:
        return snippet_html(text, p, length)
    out, end = [], -1
    for o in found:
        a, b = spans[o[0]][1], spans[o[-1]][2]
        if a >= end and len(out) < MAX_WINDOWS:
            lo, hi = _crop(text, (a, b), max(b - a, length // MAX_WINDOWS))
            out.append(snippet_html(text[lo:hi], p, length))
            end = hi
    return JOINER.join(out)


def snippets(p: Paint, length: int = LENGTH):
    """A pandas UDF of snippet_html; null stays null."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippet_html(t, p, length), na_action="ignore")

    return run


def vocalize_snippet(plain_html: str, marked: str, plain: str | None = None, open_: str = OPEN, close: str = CLOSE) -> str:
    """A painted snippet of a plain text carried over to the text with its marks: the same letters are shown and painted.

    ``plain`` is the whole text that the snippet was cropped from; it tells at which letter the snippet begins (without it,
    at the first). A snippet that isn't found in it, or a text whose letters differ, is returned as it is.
    """
    letters, painted, on = [], set(), False
    for part in re.split(f"({re.escape(open_)}|{re.escape(close)})", plain_html):
        if part in (open_, close):
            on = part == open_
            continue
        for c in html.unescape(part):
            if on:
                painted.add(len(letters))
            letters.append(c)
    shown = "".join(letters)
    is_mark = re.compile(f"[{MARKS}]").match
    begin = (plain if plain is not None else shown).find(shown)
    if begin < 0 or (plain is not None and "".join(c for c in marked if not is_mark(c)) != plain):
        return plain_html
    out, n, on = [], -1, False
    for c in marked:
        n += not is_mark(c)
        if not begin <= n < begin + len(shown):
            continue
        if not is_mark(c) and (n - begin in painted) != on:
            out.append(close if on else open_)
            on = not on
        out.append(html.escape(c, quote=False))
    return "".join(out) + (close if on else "")


def page_snippets(p: Paint, length: int = LENGTH):
    """A pandas UDF over (line, next line, line with marks, whether it is a scanned page): the snippet of each. Two lines are
    joined by a break and painted over the seam, long pages come as several stretches, other lines show their marks. A null
    line stays null."""

    def one(a: str | None, b: str | None, voc: str | None, scanned: bool) -> str | None:
        if a is None:
            return None
        if b is not None:
            return snippet_html(f"{a}\n{b}", p, length).replace("\n", SEAM)
        out = page_snippet_html(a, p, length) if scanned else snippet_html(a, p, length)
        return vocalize_snippet(out, voc, a) if voc is not None and voc != a and JOINER not in out else out

    @F.pandas_udf(StringType())
    def run(a: pd.Series, b: pd.Series, voc: pd.Series, scanned: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(a, b, voc, scanned, strict=True)], dtype=object)

    return run


@dataclass
class HighlightPattern:
    """What a display needs to find a query in any text: a pattern for each word, and how words may lie to each other."""

    words: list[str]
    gaps: list[int]
    span: int | None = None


def free_marks(pattern: str) -> str:
    """A pattern whose letters may carry marks."""
    return re.sub(r"([א-ת])", rf"\1[{MARKS}]*", pattern)


def highlight_pattern(query: str, distance: int = 0, custom: dict[str, str] | None = None, alternatives: dict[int, list[str]] | None = None, options: dict[str, dict[str, bool]] | None = None, any_order: bool = False) -> HighlightPattern | None:
    """The pattern of a planned query; None for a query without words."""
    words = split_words(query)
    if not words:
        return None
    plans = [plan_word(w, options_at(options, w, i, alternatives)) for i, w in enumerate(words)]
    return HighlightPattern([_any(p) for p in plans], resolve_gaps(len(words), distance, custom), any_order_span(len(words), distance) if any_order and not custom else None)


def literal_pattern(query: str) -> HighlightPattern | None:
    """The phrase as it was typed, marks in the text allowed."""
    words = split_words(query)
    return HighlightPattern([free_marks(re.escape(w)) for w in words], [0] * (len(words) - 1)) if words else None


def _any(p: WordPlan) -> str:
    return "|".join(free_marks(b.pattern) for b in p.branches)


def find_matches(text: str, h: HighlightPattern) -> list[list[tuple[int, int]]]:
    """Complete occurrences in a text, each as the places of its words in UTF-16 units."""
    at = [0]
    for c in text:
        at.append(at[-1] + (2 if ord(c) > 0xFFFF else 1))
    spans = [(m[0].replace("''", '"'), m.start(), m.end()) for m in _PY_TOKEN.finditer(text.translate(_QUOTES))]
    compiled = [re.compile(f"(?:{w})") for w in h.words]
    sets = []
    for c in compiled:
        sets.append(frozenset(t for t, _, _ in spans if c.fullmatch(t) or c.fullmatch(re.sub("['\"]", "", t))))
    found = occurrences([t for t, _, _ in spans], Paint(sets, h.gaps, h.span))
    return [[(at[spans[i][1]], at[spans[i][2]]) for i in o] for o in found]


# -- notes ------------------------------------------------------------------------------------------------------------------

NOTE, MARKER = "note", "marker"
_MARKUP = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)/?>|&#?\w+;")
NOTE_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])


def note_parts(raw: str) -> tuple[str, list[str], list[tuple[int, int, str]]]:
    """The main text of a line without its notes and markers, the texts of the notes, and where notes and markers stand in
    the text that has all of them (without tags). A note inside a note is a passage of its own, after the outer one; a note
    that is never closed ends with the line."""
    main: list[str] = []
    notes: list[list[str]] = []
    spans: list[list] = []
    open_: list[tuple[str, list[str] | None, int | None]] = []  # tag, where its text goes, its span
    at = length = 0

    def text(s: str) -> None:
        nonlocal length
        if s:
            into = next((x for _, x, k in reversed(open_) if k is not None), main)
            if into is not None:
                into.append(s)
            length += len(s)

    for m in _MARKUP.finditer(raw):
        text(raw[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].lower() in ("&nbsp;", "&thinsp;", "&ensp;", "&emsp;"):
                text(" ")
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in ("br", "hr", "img", "wbr") or m[0].endswith("/>"):
                continue
            kind = MARKER if "footnote-marker" in m[3] else NOTE if "footnote" in m[3] else None
            into = None
            if kind:
                spans.append([length, length, kind])
                if kind == NOTE:
                    into = []
                    notes.append(into)
            open_.append((tag, into, len(spans) - 1 if kind else None))
        else:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    for _, _, k in open_[i:]:
                        if k is not None:
                            spans[k][1] = length
                    del open_[i:]
                    break
    text(raw[at:])
    for _, _, k in open_:
        if k is not None:
            spans[k][1] = length
    return " ".join("".join(main).split()), [n for n in (" ".join("".join(x).split()) for x in notes) if n], [tuple(s) for s in spans]


@F.pandas_udf(ArrayType(NOTE_SPAN))
def note_spans(s: pd.Series) -> pd.Series:
    """Where the notes and markers of raw lines stand; null gives none."""
    return s.map(lambda t: [] if t is None else [{"start": a, "end": b, "kind": k} for a, b, k in note_parts(t)[2]])


_PARTS = StructType([StructField("main", StringType()), StructField("notes", ArrayType(StringType()))])


@F.pandas_udf(_PARTS)
def semantic_parts(s: pd.Series) -> pd.DataFrame:
    """The main text and the notes of raw lines, each note a passage of its own; null gives an empty text."""
    rows = [note_parts(t)[:2] if t is not None else ("", []) for t in s]
    return pd.DataFrame(rows, columns=["main", "notes"])


def annotate(text: str, spans: Sequence[tuple[int, int, str]], lo: int = 0, hi: int | None = None) -> str:
    """A stretch of a text, escaped, with its notes and markers in ``<line-note>`` and ``<line-marker>``, cut at the stretch's ends."""
    hi = len(text) if hi is None else hi
    out, at = [], lo
    for a, b, kind in sorted(spans):
        a, b = max(a, lo), min(b, hi)
        if a < b and a >= at:
            out.append(html.escape(text[at:a], quote=False) + f"<line-{kind}>" + html.escape(text[a:b], quote=False) + f"</line-{kind}>")
            at = b
    return "".join(out) + html.escape(text[at:hi], quote=False)


def clauses(text: str, most: int = 6, least_words: int = 4, most_words: int = 20) -> list[str]:
    """A passage cut into clauses at punctuation, short ones joined with the next, at most ``most``."""
    out, held = [], []
    for part in re.split(r"(?<=[.,:;?!])\s+", text):
        held += part.split()
        while len(held) > most_words:
            out.append(" ".join(held[:most_words]))
            held = held[most_words:]
        if len(held) >= least_words:
            out.append(" ".join(held))
            held = []
    if held:
        if out and len(held) < least_words:
            out[-1] += " " + " ".join(held)
        else:
            out.append(" ".join(held))
    return out[:most]


def canonical_marks(text: str) -> str:
    """Marks in the order of their combining classes, the grapheme joiner dropped."""
    import unicodedata

    out, run = [], []
    for c in text.replace("͏", ""):
        if unicodedata.combining(c):
            run.append(c)
        else:
            out += sorted(run, key=unicodedata.combining) + [c]
            run = []
    return "".join(out + sorted(run, key=unicodedata.combining))


@F.pandas_udf(StringType())
def canonical_order(s: pd.Series) -> pd.Series:
    """canonical_marks of a column; null stays null."""
    return s.map(canonical_marks, na_action="ignore")

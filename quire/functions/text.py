"""Normalization and tokenization as column expressions, and the same rules for query strings on the driver.

All of it runs inside the JVM. A text is stripped of HTML, folded to plain letters, freed of marks, and cut into tokens
with positions. The regular expressions are written in the subset that Java and Python read alike, so a query word and a
line go through the same rules.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags shown as a break, entities shown as white space, and the marks above and below letters.
BREAKING_TAGS = "address|article|aside|blockquote|br|caption|center|dd|div|dl|dt|figcaption|figure|footer|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
SPACE_ENTITIES = "nbsp|thinsp|ensp|emsp"
MARKS = "\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7"
VOWELS = "\u05b0-\u05bc\u05c1\u05c2\u05c7"  # what vowel matching binds; all other marks are accents
COMBINING = "\u0300-\u036f\ufb1e"
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff"
#: Longer tokens (in bytes) are left out of the index.
MAX_TOKEN_BYTES = 128

_LETTER = rf"[\p{{L}}\p{{N}}{MARKS}{COMBINING}]"
TOKEN = rf"[\p{{L}}\p{{N}}]{_LETTER}*(?:(?:''|'|\"){_LETTER}+)*(?:'(?!['\"]*{_LETTER}))?"
_PAIR = rf"\(\s*(?:{TOKEN})\s*\)\s*\[\s*(?:{TOKEN})\s*\]"


def _presentation_forms() -> dict[str, str]:
    """Hebrew presentation forms by Unicode's own decompositions."""
    out = {}
    for code in range(0xFB1D, 0xFB50):
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)
        if plain != c and code not in (0xFB29,):
            out[c] = plain
    return out


FORMS = _presentation_forms()
DIGRAPHS = {"\u05f0": "\u05d5\u05d5", "\u05f1": "\u05d5\u05d9", "\u05f2": "\u05d9\u05d9"}


def fold_forms(c: Column) -> Column:
    """Presentation forms as base letters and marks. One-letter forms go in a single translate, the rest one by one,
    and only for rows that have any."""
    single = {k: v for k, v in FORMS.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in FORMS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(c.rlike("[\ufb1d-\ufb4f]"), out).otherwise(c)


def strip_html(c: Column) -> Column:
    """Tags deleted, breaking ones and superscripts read as a space (but not a superscript of one letter inside a word);
    entities of white space become a space, all others vanish; a ``<`` that opens no tag stays."""
    out = F.regexp_replace(c, f"(?i)&(?:{SPACE_ENTITIES});", " ")
    out = F.regexp_replace(out, r"(?i)(?<=\p{L})<(su[bp])(?:\s[^<>]*)?>(\p{L})</\1\s*>(?=\p{L})", "$2")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BREAKING_TAGS}|su[bp])(?=[\s/>])[^<>]*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|</?[a-zA-Z!][^<>]*>", "")
    return F.regexp_replace(out, r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", "")


def strip_data_uris(c: Column, least: int = 64) -> Column:
    """Embedded ``data:`` payloads of at least ``least`` characters deleted."""
    return F.regexp_replace(c, rf"(?i)data:[a-z0-9.+-]*/?[a-z0-9.+-]*(?:;[a-z0-9=.+-]+)*,[A-Za-z0-9+/=%_-]{{{least},}}", "")


def strip_marks(c: Column) -> Column:
    """Vowel points and accents deleted; word-dividing signs of the same block stay."""
    return F.regexp_replace(c, f"[{MARKS}]", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def fold_quotes(c: Column) -> Column:
    """Typographic and Hebrew quotes as ASCII ones."""
    return F.translate(c, "\u05f4\u201c\u201d\u201e\u05f3\u2018\u2019", "\"\"\"\"'''")


def normalize(c: Column) -> Column:
    """The plain text of a line: no tags, no presentation forms, no marks, single spaces; punctuation stays."""
    return collapse(strip_marks(fold_forms(strip_html(c))))


def normalize_vocalized(c: Column) -> Column:
    """The same with its marks: what vowel-sensitive searches look at."""
    return collapse(fold_forms(strip_html(c)))


def foldable(c: Column) -> Column:
    """A plain text ready for tokens: lower case, ASCII quotes, invisible and combining characters gone, digraphs parted."""
    out = F.regexp_replace(fold_quotes(F.lower(c)), f"[{INVISIBLE}{COMBINING}]", "")
    for k, v in DIGRAPHS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def placed_tokens(plain: Column) -> Column:
    """The tokens of a plain text as array<struct<t, p>>, read in one pass. A pair ``(X) [Y]`` is two readings at one position."""
    units = _all(foldable(plain), rf"{TOKEN}|{_PAIR}")

    def one(t: Column, i: Column) -> Column:
        return F.struct(F.replace(t, F.lit("''"), F.lit('"')).alias("t"), i.alias("p"))

    return F.flatten(F.transform(units, lambda u, i: F.when(u.startswith("("), F.transform(_all(u, TOKEN), lambda t: one(t, i))).otherwise(F.array(one(u, i)))))


def tokens_and_positions(plain: Column) -> tuple[Column, Column]:
    """Token and position arrays of a plain text (each reads the text by itself; see placed_tokens for both at once)."""
    return F.transform(placed_tokens(plain), lambda x: x["t"]), F.transform(placed_tokens(plain), lambda x: x["p"])


def token_count(plain: Column) -> Column:
    """How many tokens a plain text has."""
    return F.regexp_count(foldable(plain), F.lit(TOKEN))


def bare(term: Column) -> Column:
    """A term without quotes."""
    return F.regexp_replace(term, "['\"]", "")


def is_garbage(c: Column) -> Column:
    """Whether a line of a scanned page is noise: no letter, or far too few of them among what is printed."""
    total = F.length(F.regexp_replace(c, r"\s", ""))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    ratio = letters / F.greatest(total, F.lit(1))
    return (letters == 0) | ((total >= 50) & (ratio < 0.10)) | ((total >= 20) & (ratio < 0.20) & (total - letters > letters))


_MARKER = r"(?:\([א-ת0-9'\"*]{1,5}\)|\[[א-ת0-9'\"*]{1,5}\]|\{[א-ת0-9'\"*]{1,5}\})"
_LEAD, _TRAIL = rf"^\s*(?:{_MARKER}\s*)+", rf"(?:\s*{_MARKER}[\s.:,;]*)+$"


def content(plain: Column) -> Column:
    """A line without the enumerators at its ends, such as ``(ג) `` and `` {פ}``. A reading pair is no enumerator."""
    start = F.when(fold_quotes(plain).rlike(rf"^\s*{_PAIR}"), plain).otherwise(F.regexp_replace(plain, _LEAD, ""))
    return F.when(fold_quotes(plain).rlike(rf"{_PAIR}\s*$"), start).otherwise(F.regexp_replace(start, _TRAIL, ""))


def dedup_text(plain: Column) -> Column:
    """What makes two lines the same text: letters and digits in lower case; null under twelve Hebrew letters."""
    hebrew = F.length(F.regexp_replace(plain, r"[^א-ת]", ""))
    return F.when(hebrew >= 12, F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]", ""))


# -- the same for query strings ---------------------------------------------------------------------------------------

_PY_LETTER = rf"[^\W_{MARKS}{COMBINING}]"
_PY_ANY = rf"(?:{_PY_LETTER}|[{MARKS}{COMBINING}])"
_PY_TOKEN = re.compile(rf"{_PY_LETTER}{_PY_ANY}*(?:(?:''|'|\"){_PY_ANY}+)*(?:'(?!['\"]*{_PY_ANY}))?")
_PY_PAIR = re.compile(r"\(\s*([^()\[\]\s]+)\s*\)\s*\[\s*([^()\[\]\s]+)\s*\]")
_QUOTES = str.maketrans({**dict.fromkeys("\u05f4\u201c\u201d\u201e", '"'), **dict.fromkeys("\u05f3\u2018\u2019", "'")})
_AS_SPACE = str.maketrans(dict.fromkeys("\u05be-|,;:!?(){}", " "))
_GONE = str.maketrans(dict.fromkeys("*[]^$\\+.~`", ""))
_PY_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def sanitize(query: str) -> str:
    """A typed query without signs of operators: quotes folded, separators as spaces, of reading pairs the second."""
    q = _PY_PAIR.sub(r"\2", query).translate(_QUOTES).translate(_AS_SPACE).translate(_GONE)
    return " ".join(_PY_INVISIBLE.sub("", q).split())


def fold_word(word: str, marks: bool = False) -> str:
    """A query word as the index has it; its vowel points stay only for vowel-sensitive matching."""
    w = "".join(FORMS.get(c, DIGRAPHS.get(c, c)) for c in word.translate(_QUOTES).lower())
    w = re.sub(f"[{INVISIBLE}{COMBINING}]", "", w)
    return w if marks else re.sub(f"[{MARKS}]", "", w)


def split_words(query: str, marks: bool = False) -> list[str]:
    """The words of a query, in order."""
    return [m.replace("''", '"') for m in _PY_TOKEN.findall(fold_word(sanitize(query), marks))]


def word_spans(query: str) -> list[tuple[int, int]]:
    """Where the words of a query lie, in UTF-16 units, as a display that counts so needs them."""
    folded = query.translate(_QUOTES)
    at = [0]
    for c in query:
        at.append(at[-1] + (2 if ord(c) > 0xFFFF else 1))
    return [(at[m.start()], at[m.end()]) for m in _PY_TOKEN.finditer(folded)]

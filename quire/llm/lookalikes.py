"""Text that looks the same: a skeleton in which every character is replaced by the prototype of its shape.

skeleton(text) = decompose, replace each character by its prototype, decompose again. Two texts look the same if their
skeletons are equal. Invisible characters vanish first, so that none of them keeps accents from being put in order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts with the shape of a Latin letter, Hebrew letter pairs, and marks of one shape.
CYRILLIC_AS_LATIN = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h"}
GREEK_AS_LATIN = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v"}
JOINED_PAIRS = {"װ": "וו", "ױ": "וי", "ײ": "יי"}
MARKS = {"׳": "'", "’": "'", "‘": "'", "ʼ": "'", "′": "'", "״": '"', "”": '"', "“": '"', "″": '"', "׃": ":", "∶": ":", "‐": "-", "‑": "-"}
# From the confusables of Unicode (as in ICU 77), below U+3000 and in the extensions of Latin and Cyrillic: letters of Greek,
# Cyrillic and Armenian with the shape of a letter of another of these scripts or of Latin, of the same case, and marks with the
# shape of an ASCII mark. Left out as visible differences: a second letter of one script with the same prototype (unless there is
# no telling them apart), letters against digits or marks, Hebrew letters, and α, γ, υ, σ, г, И, и, which upright type tells apart.
UNICODE_LETTERS = {"Ϳ": "J", "ι": "i", "ρ": "p", "Ϝ": "F", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Г": "Γ", "Л": "Λ", "П": "Π", "Ф": "Φ", "к": "κ", "п": "π", "т": "τ", "ф": "φ", "є": "ε", "Ѱ": "Ψ", "ѱ": "ψ", "Ѳ": "Θ", "Ѵ": "V", "ѵ": "v", "Ӏ": "I", "ӏ": "i", "Ԍ": "G", "Ԝ": "W", "Ս": "U", "Տ": "S", "Փ": "Φ", "Օ": "O", "ա": "w", "գ": "q", "ծ": "δ", "հ": "h", "յ": "ȷ", "ո": "n", "պ": "ɰ", "ս": "u", "ց": "g", "ք": "f", "օ": "o", "ꙍ": "ω"}
UNICODE_MARKS = {"¸": ",", "ʹ": "'", "ʺ": "\"", "ʻ": "'", "ʽ": "'", "ʾ": "'", "˂": "<", "˃": ">", "˄": "^", "ˆ": "^", "ˈ": "'", "ː": ":", "˗": "-", "˜": "~", "˝": "\"", "ˮ": "\"", "˶": "\"", "˸": ":", "՚": "'", "։": ":", "׀": "|", "؍": ",", "٪": "%", "٫": ",", "٭": "*", "۔": "-", "܁": ".", "܂": ".", "܃": ":", "܄": ":", "ߺ": "_", "᐀": "=", "᛬": ":", "᛭": "+", "᜵": "/", "᠃": ":", "᠉": ":", "᳓": "\"", "῀": "~", "‒": "-", "–": "-", "‚": ",", "‛": "'", "‟": "\"", "․": ".", "‶": "\"", "‹": "<", "›": ">", "⁁": "/", "⁃": "-", "⁄": "/", "⁎": "*", "⁒": "%", "⁓": "~", "⁚": ":", "−": "-", "∕": "/", "∖": "\\", "∗": "*", "∣": "|", "∼": "~", "⏽": "|", "╱": "/", "❨": "(", "❩": ")", "❮": "<", "❯": ">", "❲": "(", "❳": ")", "❴": "{", "❵": "}", "➕": "+", "➖": "-", "⟋": "/", "⟍": "\\", "⧵": "\\", "⧸": "/", "⧹": "\\", "⹀": "=", "⼂": "\\", "⼃": "/", "꞉": ":"}
PROTOTYPES = {**UNICODE_LETTERS, **UNICODE_MARKS, **CYRILLIC_AS_LATIN, **GREEK_AS_LATIN, **JOINED_PAIRS, **MARKS}

#: Kinds of compatibility decomposition that only change width or presentation, not what is seen.
_FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>")
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
MIN_CHARS = 40


def _plain(c: str) -> str:
    """One character without its width or presentation form, decomposed as far as that goes."""
    kind = unicodedata.decomposition(c)
    if kind.startswith(_FORMS) or (kind.startswith("<compat>") and "\ufb00" <= c <= "\ufb4f"):
        return "".join(_plain(chr(int(x, 16))) for x in kind.split()[1:])
    whole = unicodedata.normalize("NFD", c)
    return whole if whole == c else "".join(map(_plain, whole))


class _Shapes(dict):
    """code point -> prototype, made by rule on first use."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if _IGNORABLE.match(c):
            out = ""
        elif unicodedata.category(c) == "Zs" or c == "\t":
            out = " "
        else:
            out = "".join("" if _IGNORABLE.match(x) else PROTOTYPES.get(x, x) for x in _plain(c))
        self[code] = out
        return out


_SHAPES = _Shapes()


def skeleton(text: str) -> str:
    """The form in which texts that look the same are equal. Line breaks stay, other white space becomes a space."""
    return text if text.isascii() and "\t" not in text else unicodedata.normalize("NFD", text.translate(_SHAPES))


def canonical(text: str) -> str:
    """The same form composed again where Unicode composes: what to store and show."""
    return unicodedata.normalize("NFC", skeleton(text))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, id, text) -> 128 bits of the skeleton and 64 of the text."""
    for batch in batches:
        low, high, own = [], [], []
        for t in batch.column(2).to_pylist():
            h = xxhash.xxh3_128_intdigest(skeleton(t))
            low.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
            high.append((h >> 64) - (1 << 63))
            own.append(xxhash.xxh3_64_intdigest(t) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(own, pa.int64())], ["field", "id", "low", "high", "own"])


def hashed_texts(df: DataFrame, key: str, fields: Sequence[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """(field, id, low, high, own) of every text of at least ``min_chars`` characters; each text of a key once."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
    rows = df.select(F.col(key).cast("long").alias("id"), each.alias("x")).select("x.field", "id", "x.text").where(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    return rows.mapInArrow(_hashed, "field string, id long, low long, high long, own long").distinct()


def lookalike_members(df: DataFrame, key: str, fields: Sequence[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``hashed_texts`` whose skeleton belongs to more than one different text."""
    from quire.session import cut

    rows = cut(hashed_texts(df, key, fields, min_chars))
    mixed = rows.groupBy("field", "low", "high").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a < b").select("field", "low", "high")
    return rows.join(mixed, ["field", "low", "high"], "left_semi")


def lookalike_pairs(df: DataFrame, key: str, fields: Sequence[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs of keys whose texts of one field look the same but differ in their characters: (field, id_a, id_b).

    Null texts, null keys and texts under ``min_chars`` code points make no pair; equal texts make none with each other.
    Repeated rows count once, other columns are not looked at, an empty table gives no pair. Skeletons are compared by
    128-bit hashes. Texts are joined as classes of equal texts, and only skeletons of several classes; their members are
    expanded last, so copies of one text never meet each other.
    """
    from quire.session import cut

    rows = cut(lookalike_members(df, key, fields, min_chars))
    classes = rows.select("field", "low", "high", "own").distinct()
    a, b = (classes.select("field", "low", "high", F.col("own").alias(f"own_{x}")) for x in "ab")
    out = a.join(b, ["field", "low", "high"]).where("own_a < own_b")
    for x in "ab":
        out = out.join(rows.select("field", "low", "high", F.col("own").alias(f"own_{x}"), F.col("id").alias(f"k_{x}")), ["field", "low", "high", f"own_{x}"])
    return out.where("k_a <> k_b").select("field", F.least("k_a", "k_b").alias("id_a"), F.greatest("k_a", "k_b").alias("id_b")).distinct()


@F.pandas_udf(StringType())
def canonical_text(s):
    """canonical() of a column; null stays null."""
    return s.map(canonical, na_action="ignore")

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.hashes import content_hash, fnv1a, fnv1a64, line_hash, metadata_hash


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.v for r in df.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_strip_html(spark):
    cases = [
        ("<b>a</b>b<br>c", "ab c"), ("a&nbsp;b&quot;c", "a bc"), ("6 < 64", "6 < 64"), ("מי<b>לה</b>", "מילה"), ("תורה<sup>30</sup>", "תורה 30 "),
        ("מ<sup>ש</sup>ה", "משה"), ("<p>x</p>y", " x y"), ("a <!-- c --> b", "a  b"), (None, None), ("", ""),
    ]
    assert values(spark, [c for c, _ in cases], T.strip_html) == [w for _, w in cases]


def test_normalize(spark):
    cases = [("<h2>בְּרֵאשִׁית</h2>  ברא", "בראשית ברא"), ("שׁוּﬨ", "שות"), ("א־ב", "א־ב"), (" a \tb ", "a b"), (None, None)]
    assert values(spark, [c for c, _ in cases], T.normalize) == [w for _, w in cases]


def test_tokens(spark):
    cases = [
        ("אמר רבא, ואמר", ["אמר", "רבא", "ואמר"]), ("רמב\"ם ר' יוחנן", ["רמב\"ם", "ר'", "יוחנן"]), ("רמ''ט", ["רמ\"ט"]), ("a''' b", ["a'", "b"]),
        ("א״ב ג׳", ["א\"ב", "ג'"]), ("x-y (z)", ["x", "y", "z"]), ("12 ab3", ["12", "ab3"]), ("", []), ("?!", []), ("A​B", ["ab"]),
    ]
    assert values(spark, [c for c, _ in cases], lambda c: T.tokens_and_positions(c)[0]) == [w for _, w in cases]
    pair = values(spark, ["הארץ (הוצא) [היצא] אתך", "כי [אם] עונותיכם"], lambda c: F.struct(*T.tokens_and_positions(c)))
    assert (list(pair[0][0]), list(pair[0][1])) == (["הארץ", "הוצא", "היצא", "אתך"], [0, 1, 1, 2])
    assert (list(pair[1][0]), list(pair[1][1])) == (["כי", "אם", "עונותיכם"], [0, 1, 2])


def test_driver_and_rows_agree(spark):
    r = random.Random(1)
    rows = ["".join(r.choice("אבגד'\"' ,.-ab1") for _ in range(r.randrange(25))) for _ in range(400)]
    got = values(spark, rows, lambda c: T.tokens_and_positions(T.collapse(c))[0])
    for row, tokens in zip(rows, got, strict=True):
        clean = row.replace("-", " ")
        assert [m.replace("''", '"') for m in T._PY_TOKEN.findall(T.fold_word(clean))] == list(tokens), row


def test_sanitize_and_split():
    assert T.sanitize(" [א] ב* “ג” ד־ה, (ו) [ז] ") == 'א ב "ג" ד ה ז'
    assert T.split_words("רמב״ם  שָׁלוֹם?!") == ['רמב"ם', "שלום"] and T.split_words("?!") == []
    assert T.word_spans("\U0001d122 אב ג") == [(3, 5), (6, 7)]


def test_garbage(spark):
    assert values(spark, ["12 34", "אמר רבא", "1" * 49 + "א" * 2, "#" * 60 + "אב", "(א) 1"], T.is_garbage) == [True, False, True, True, False]


def test_hashes(spark):
    assert fnv1a64(b"") == 0xCBF29CE484222325 - (1 << 64) and fnv1a64(b"a") == 0xAF63DC4C8601EC8C - (1 << 64)
    rows = ["", "a", "אבג", "x" * 300, None]
    assert values(spark, rows, fnv1a) == [fnv1a64(r.encode()) if r is not None else 0 for r in rows]
    lines = ["אמר רבי עקיבא לתלמידיו", "אמר, רבי: עקיבא - לתלמידיו!", "אמר רבי עקיבה לתלמידיו", "אמר רבי עקיבא לתלמידיו 1", "אמר רבא", "אמר רבי עקיבא לתלמידיו A", "אמר רבי עקיבא לתלמידיו a"]
    h = values(spark, lines, line_hash)
    assert h[0] == h[1] and len({h[0], h[2], h[3]}) == 3 and h[4] == 0 and h[5] == h[6] != h[0]
    df = spark.createDataFrame([("t", "x", ["b", "a", "b"]), ("t", "x", ["a", "b"])], "title string, topics string, facets array<string>")
    m = [r.m for r in df.select(metadata_hash(F.col("title"), F.col("topics"), F.col("facets")).alias("m")).collect()]
    assert m[0] == m[1]
    assert df.select(content_hash(F.lit("z"), F.col("title"), F.col("topics"), F.col("facets")).alias("m")).distinct().count() == 1


def test_data_uris(spark):
    got = values(spark, ["a data:image/png;base64," + "A" * 80 + " b", "data:short,AAA"], T.strip_data_uris)
    assert got == ["a  b", "data:short,AAA"]


@pytest.mark.parametrize("line,want", [("(ג) אמר רבא {פ}", "אמר רבא"), ("{ס}", ""), ("(הוצא) [היצא] אתך", "(הוצא) [היצא] אתך"), ("אמר (ארוכהמדי) סוף", "אמר (ארוכהמדי) סוף"), ("(א): אמר", "(א): אמר"[3:].strip())])
def test_content(spark, line, want):
    assert values(spark, [line], T.content)[0].strip() == want

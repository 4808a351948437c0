from pyspark.sql import functions as F

from quire.functions import display as D
from quire.functions.words import WordOptions, affixed, options_at, plan_word, resolve_gaps, spelling_variants, typo_branches
from quire.operators.regexes import CROSS_SPACE, INVALID, SINGLE_WORD, WORD_SEQUENCE, parse, range_udf

A, B = frozenset(["משה"]), frozenset(["ואהרן"])
TEXT = "משה ואהרן אמרו שלום ואחר כך משה כהן הלך"


def test_snippets():
    s = D.snippet_html(TEXT, D.Paint([A, B], [0]))
    assert s.count(D.OPEN) == 2 and "כך משה כהן" in s
    assert D.snippet_html("משה דיבר ואחר כך משה שתק", D.Paint([A])).count(D.OPEN) == 2
    s = D.snippet_html("משה רבנו ואהרן אמר ואחר כך משה לבדו הלך", D.Paint([A, B], [1]))
    assert s.count(D.OPEN) == 2 and "כך משה לבדו" in s
    assert D.snippet_html("a < b & משה", D.Paint([A])) == f"a &lt; b &amp; {D.OPEN}משה{D.CLOSE}"
    assert D.snippet_html("ואהרן בא משה", D.Paint([A, B], None, 2)).count(D.OPEN) == 2
    long = "מלה " * 500 + "משה" + " סוף" * 500
    s = D.snippet_html(long, D.Paint([A]), 100)
    assert f"{D.OPEN}משה{D.CLOSE}" in s and len(s) < 140 and s.startswith("מלה")
    assert D.page_snippet_html(long + " " + long, D.Paint([A]), 400).count(D.OPEN) == 2
    assert D.vocalize_snippet(f"{D.OPEN}אב{D.CLOSE}", "אָב גַד אָב", "אב גד אב") == f"{D.OPEN}אָב{D.CLOSE}"
    assert D.vocalize_snippet(f"גד {D.OPEN}אב{D.CLOSE}", "אָב גַד אָב", "אב גד אב") == f"גַד {D.OPEN}אָב{D.CLOSE}"
    assert D.vocalize_snippet(f"{D.OPEN}משה{D.CLOSE} א", "מֹשֶׁה א") == f"{D.OPEN}מֹשֶׁה{D.CLOSE} א"


def test_patterns():
    h = D.highlight_pattern("משה ואהרן", distance=1)
    assert D.find_matches("\U0001d122 משה רבנו ואהרן", h) == [[(3, 6), (12, 17)]] and D.highlight_pattern("?!") is None
    assert D.find_matches("מֹשֶׁה", D.literal_pattern("משה")) == [[(0, 6)]]


def test_notes(spark):
    raw = "a<sup class='footnote-marker'>1</sup><i class=\"footnote\">b <b>c</b><i class='footnote'>d</i></i> e"
    main, notes, spans = D.note_parts(raw)
    assert (main, notes) == ("a e", ["b c", "d"]) and spans == [(1, 2, "marker"), (2, 6, "note"), (5, 6, "note")]
    assert D.annotate("a1b e", [(1, 2, "marker"), (2, 3, "note")], 0, 4) == "a<line-marker>1</line-marker><line-note>b</line-note> "
    got = spark.createDataFrame([(raw,), (None,)], "r string").select(D.semantic_parts("r").alias("p"), D.note_spans("r").alias("s")).collect()
    assert got[0].p.main == "a e" and len(got[0].s) == 3 and got[1].p.main == "" and got[1].s == []


def test_small_functions():
    assert D.canonical_marks("בָּ͏") == "בָּ"
    assert D.clauses("one two three four, five six. seven eight nine ten eleven") == ["one two three four,", "five six. seven eight nine ten eleven"]


def test_word_plans():
    assert spelling_variants("שבת") == ["שבת", "שובת"] and spelling_variants("מצוה")[0] == "מצוה" and "מצה" not in spelling_variants("מצוה")
    assert "קדש" in spelling_variants("קודש") and "קדוש" not in spelling_variants("קודש") and len(spelling_variants("ויקוימו")) <= 32
    assert list(typo_branches("אב")) == [] and set(typo_branches("אכל")) == {"עכל", "הכל", "אקל"}
    assert resolve_gaps(3, 1) == [1, 1] and resolve_gaps(3, 0, {"0-1": "2"}) == [2, 2] and resolve_gaps(3, 0, {"0-1": "-2", "1-2": "1", "x": "3"}) == [0, 1]
    import re

    m = lambda w, t, **o: any(re.fullmatch(p, t) for p in affixed(w, WordOptions(**o)))
    assert m("מלך", "מלכים", gram_suffix=True) and not m("מלך", "מלךים", gram_suffix=True) and m("תורה", "תורתו", gram_suffix=True) and not m("תורה", "תורהו", gram_suffix=True)
    assert m("מלך", "וכשהמלך", gram_prefix=True) and not m("בית", "xבית", gram_prefix=True) and not m("ית", "בית", gram_prefix=True) and m("שבת", "28שבת", prefix=True)
    assert [b.tier for b in plan_word("ברכה", WordOptions(prefix=True)).branches] == [0, 1]
    o = options_at({"א_0": {"קידומות": True}}, "א", 0, {0: ["ב"]})
    assert o.prefix and o.alternatives == ("ב",)


def test_regex_kinds(spark):
    kinds = {"זה": SINGLE_WORD, "זה את": WORD_SEQUENCE, "זה.*את": CROSS_SPACE, "^גם": CROSS_SPACE, "a(?=b)": INVALID, "(a+)+": INVALID, "": INVALID, "x" * 301: INVALID, r"\bזה\b": SINGLE_WORD, "[א-ת]+ה": SINGLE_WORD, "a^b": INVALID, "a$b": INVALID, "(a": INVALID, r"a\sb": CROSS_SPACE, "(?:א ב|ג)": CROSS_SPACE}
    assert {p: parse(p).kind for p in kinds} == kinds
    got = spark.createDataFrame([("\U0001d122 זה את זה",), (None,)], "t string").select(range_udf("זה את")(F.col("t")).alias("r")).collect()
    assert [(x.start, x.end) for x in got[0].r] == [(3, 5), (6, 8)] and got[1].r == []

from itertools import combinations

from quire.llm.lookalikes import PROTOTYPES, canonical, canonical_text, lookalike_pairs, skeleton

LONG = " and a tail that makes the text long enough"


def test_skeleton():
    same = [
        ("Ampelé", "Аmрelé"), ("abc12", "ａｂｃ１２"), ("שׁ", "שׁ"), ("ואהם", "וﬡﬣﬦ"),
        ("וויי", "װײ"), ("וי", "ױ"), ("a b", "a b"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"),
        ("ab", "﻿a­b⁠"), ("ר\"ם", "ר״ם"), ("ר'", "ר׳"), ("ס:", "ס׃"), ("בָּ", "בָּ"),
        ("בָּ", "בּ͏ָ"), ("v", "ν"), ("a\tb", "a b"), ("ײַ", "ייַ"), ("בָּ", "בָּ"),
    ]
    for a, b in same:
        assert skeleton(a) == skeleton(b), (a, b)
    different = [("a b", "a\nb"), ("A", "a"), ("של", "שָל"), ("ז", "ו"), ("x2", "x²"), ("0", "O"), ("1", "l"), ("''", '"'), ("a  b", "a b"), ("שׁ", "שׂ")]
    for a, b in different:
        assert skeleton(a) != skeleton(b), (a, b)
    assert skeleton(skeleton("\u0410m\u0440e\u0301 \u05f0")) == skeleton("\u0410m\u0440e\u0301 \u05f0")
    assert canonical("e\u0301") == "\u00e9" and canonical("") == ""


def test_pairs_equal_brute_force(spark):
    texts = ["Ampel\u00e9" + LONG, "\u0410mpel\u00e9" + LONG, "Ampele\u0301" + LONG, "Ampele" + LONG, "Ampel\u00e9" + LONG, "short \u00e9", "short e\u0301", None, ""]
    rows = [(i, t, texts[-1 - i], i) for i, t in enumerate(texts)] + [(0, texts[0], texts[-1], 5), (None, texts[1], None, 1), (50, "\u00e9" * 20_000, None, 1), (51, "e\u0301" * 20_000, None, 1)]
    df = spark.createDataFrame(rows, "id long, raw string, indexed_text string, own int")
    got = sorted(tuple(r) for r in lookalike_pairs(df, "id", ["raw", "indexed_text"]).collect())
    want = set()
    for k, f in ((1, "raw"), (2, "indexed_text")):
        for x, y in combinations([r for r in rows if r[0] is not None and r[k] and len(r[k]) >= 40], 2):
            if x[0] != y[0] and x[k] != y[k] and skeleton(x[k]) == skeleton(y[k]):
                want.add((f, min(x[0], y[0]), max(x[0], y[0])))
    assert got == sorted(want) and want
    assert lookalike_pairs(df.limit(0), "id", ["raw"]).count() == 0
    assert df.where("id = 1").select(canonical_text("raw").alias("c")).first().c == canonical(texts[1])


def test_unicode_confusables():
    for a, b in [("p", "ρ"), ("i", "ι"), ("к", "κ"), ("o", "օ"), ("O", "Օ"), ("I", "Ӏ"), ("Γ", "Г"), ("a-b", "a–b"), ("a-b", "a−b"), ("a-b", "a‒b"), ("a:b", "a։b"), ("(a)", "﹙a﹚"), ("(a)", "︵a︶"), ("a,b", "a﹐b"), ("'", "‛")]:
        assert skeleton(a) == skeleton(b), (a, b)
    for a, b in [("a", "α"), ("o", "σ"), ("о", "σ"), ("I", "l"), ("И", "N"), ("a-b", "a—b"), ("Ү", "У"), ("ו", "ן"), ("ס", "o"), ("י", "'"), ("k", "K"), ("x", "×")]:
        assert skeleton(a) != skeleton(b), (a, b)
    for c, to in PROTOTYPES.items():
        assert skeleton(c) == skeleton(to) == skeleton(skeleton(c)), c

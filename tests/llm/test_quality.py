import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.quality import FAR, STATS, Common, Prose, classified, is_table_row, measure, statistics

COMMON = Common([("en", "the"), ("en", "of"), ("en", "and"), ("he", "של"), ("he", "את")])


def test_measure():
    lang, n, s = measure("The end of the line.\n- an entry\n\n| a | 1 |", COMMON)
    x = dict(zip(STATS, s, strict=True))
    assert (lang, n) == ("en", 9) and x["punctuated_lines"] == x["list_lines"] == x["table_lines"] == pytest.approx(1 / 3)
    assert x["common_words"] == pytest.approx(3 / 9) and x["mean_word_length"] == pytest.approx(24 / 9) and x["digit_ratio"] == pytest.approx(1 / 29)
    assert measure("", COMMON) == ("und", 0, [0.0] * len(STATS))
    assert measure("שֶׁל אֶת", COMMON)[0] == "he"


def test_lines():
    for row in ["| a | b |", "a\tb\t1", "a;b;1", "word     12.5    7", "a │ 1 │ b"]:
        assert is_table_row(row), row
    for row in ["A sentence; with parts; and more; of it.", "two  spaces only", "|", "a | b", "$%  ^&*  #@!"]:
        assert not is_table_row(row), row

    def kind(text):
        x = dict(zip(STATS, measure(text, COMMON)[2], strict=True))
        return [k for k in ("list_lines", "table_lines", "unreadable_lines") if x[k] > 0.5]

    for t in ["- a\n- b", "(א) מה\n(ב) של", "1. one\n2. two", "Chapter one ........ 12", "entry, 12, 15-17, 200", "• x y", "* one;"]:
        assert kind(t) == ["list_lines"], t
    for t in ["%$# @!^ &*( <>} {|\\", "a b. c, d' e f| g", "0f a3 9c d2 11 4e 7b", "word word word word word word word", "asdkfjhqwlekjrhq zxmcnvbqpwoeiruty", "�□? �□□ ??□� □", "×¡×’×�× ×œ×�×’"]:
        assert kind(t) == ["unreadable_lines"], t
    for t in ["— Yes.\n— No!", "A verse of the song\nand the rest of it", "In 1999, the 3 of them."]:
        assert kind(t) == [], t


def make(n=400):
    r = random.Random(6)
    vocab = ["the", "of", "and"] * 6 + [f"word{chr(97 + i % 26)}{'x' * (i % 5)}" for i in range(60)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randrange(6, 15))).capitalize() + "."
    docs = [(i, "\n".join(line() for _ in range(r.randrange(3, 9)))) for i in range(n)]
    docs += [(1000 + i, "\n".join("- " + r.choice(vocab) for _ in range(9)) + "\n" + line()) for i in range(20)]
    docs += [(2000 + i, "\n".join(f"{r.choice(vocab)};{i};{r.randrange(99)}" for i in range(8))) for i in range(20)]
    docs += [(3000 + i, "\n".join("".join(r.choice("%$#@!^&* <>{}|") for _ in range(50)) for _ in range(5))) for i in range(20)]
    docs += [(4000 + i, line() + "\n" + line() + "\n" + line() + "\n- one\n- two") for i in range(10)]
    return docs


def test_kinds(spark):
    df = spark.createDataFrame([*make(), make()[0], (None, "x"), (7000, None), (7001, ""), (8000, "the word of it. " * 4000)], "doc_id long, text string").withColumn("language", F.lit(1)).withColumn("kind", F.lit(2))
    common = spark.createDataFrame([("en", w) for w in ("the", "of", "and")] + [("en", "the"), (None, "x"), ("en", None)], "lang string, word string")
    rows = classified(df, "doc_id", "text", common).collect()
    kinds = {r.doc_id: r.kind for r in rows}
    assert len(rows) == len(kinds) == len({d for d, _ in make()}) + 2
    for lo, k in ((0, "prose"), (1000, "list"), (2000, "table"), (3000, "junk"), (4000, "prose"), (7000, "prose"), (8000, "junk")):
        assert {v for d, v in kinds.items() if lo <= d < lo + 1000} == {k}
    assert all(r.distance == pytest.approx(sum(r.parts)) for r in rows)
    assert {r.main for r in rows if r.kind == "list"} <= {"list_lines", "punctuated_lines"}
    assert classified(df.limit(0), "doc_id", "text", common).count() == 0
    assert statistics(df, "doc_id", "text", common.limit(0)).where("language <> 'und'").count() == 0


def test_distance_is_mahalanobis(spark):
    common = spark.createDataFrame([("en", w) for w in ("the", "of", "and")], "lang string, word string")
    stats = statistics(spark.createDataFrame(make(120), "doc_id long, text string"), "doc_id", "text", common)
    prose = Prose(stats)
    m, s = prose.models["en"]
    for r in prose.distances(stats).where("language = 'en'").limit(30).collect():
        x = np.array([r[c] for c in STATS]) - m
        assert r.distance == pytest.approx(x @ s @ x)


def test_lists_outnumber_prose(spark):
    """Most documents of the language are copies of one list, others are different lists; the prose is still the centre."""
    common = spark.createDataFrame([("en", w) for w in ("the", "of", "and")], "lang string, word string")
    prose = make(100)[:100]
    one = "\n".join(f"- the {w} of it" for w in ("end", "word", "line", "book", "page", "song"))
    docs = [*prose, *((1000 + i, one) for i in range(300)), *((2000 + i, "\n".join(f"{k}. the word{i} and {k}" for k in range(4 + i % 9))) for i in range(150))]
    rows = classified(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", common).collect()
    assert len(rows) == 550
    assert {r.kind for r in rows if r.doc_id >= 1000} == {"list"} and {r.kind for r in rows if r.doc_id < 1000} == {"prose"}
    assert all(r.distance > FAR for r in rows if r.doc_id >= 1000) and sum(r.distance <= FAR for r in rows if r.doc_id < 1000) >= 95
    lists = classified(spark.createDataFrame(docs[100:], "doc_id long, text string"), "doc_id", "text", common)
    assert lists.where("kind = 'list' AND distance IS NULL").count() == 450

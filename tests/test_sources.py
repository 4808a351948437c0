import pytest
from pyspark.sql import functions as F

from quire.functions.hashes import line_check, line_hash
from quire.operators import lexicons, vectors
from quire.operators.corpus import Corpus, build, number_books
from quire.operators.search import Query, search
from quire.functions.words import plan_word
from quire.sources import books
from quire.sources.store import Store, difference


def test_numbers(spark):
    b = spark.createDataFrame([("c",), ("a",), (None,), ("c",)], "file_path string")
    known = spark.createDataFrame([("b", 4)], "file_path string, book_no long")
    got = {r.file_path: r.book_no for r in number_books(b, known, 7).collect()}
    assert got == {"b": 4, "a": 8, "c": 9}


def test_decode_and_zstd(spark):
    import zstandard

    frame = zstandard.ZstdCompressor().compress("שלום".encode())
    df = spark.createDataFrame([(bytearray(b"\xffab"), bytearray(frame)), (None, bytearray(b"broken")), (None, None)], "b binary, z binary")
    rows = df.select(books.decode(F.col("b")).alias("t"), books.zstd_text(F.col("z")).alias("z")).collect()
    assert [r.t for r in rows] == ["�ab", None, None] and [r.z for r in rows] == ["שלום", None, None]


def test_library_books(spark):
    ask = spark.createDataFrame([(0, "library", 1, "t", "/a", "p1"), (1, "library", 2, "t", "/a", "p2"), (2, "gone", 1, "t", "/a", "p3"), (3, "library", 3, "t", "/a", "p4")], "position int, source string, book_id long, title string, topics string, file_path string")
    rows = spark.createDataFrame([("library", 1, 10, "<h1>ראש</h1>"), ("library", 1, 20, "שורה"), ("library", 3, 0, "x"), ("library", 3, 1, None)], "source string, book_id long, line_index int, content string")
    lines, status = books.library_books(ask, rows, spark.createDataFrame([("library",)], "source string"))
    assert [r.status for r in status.collect()] == ["Indexed", "Missing", "Unavailable", "Failed"]
    got = sorted((r.file_path, r.ordinal, r.segment, r.plain, r.reference) for r in lines.collect())
    assert got == [("p1", 0, 10, "ראש", "ראש"), ("p1", 1, 20, "שורה", "ראש")]


def test_displayed(spark):
    rows = spark.createDataFrame([(1, 0, "שורה ראשונה בספר הזה"), (1, 5, "אחרת")], "book_id long, line_index int, content string")
    plain = F.col("plain")
    hits = spark.createDataFrame([(1, 0, "שורה ראשונה בספר הזה"), (1, 1, "ישן"), (2, 0, "אין")], "book_id long, segment long, plain string")
    hits = hits.withColumn("line_check", line_check(plain)).withColumn("line_hash", line_hash(plain))
    got = {(r.book_id, r.segment): (r.text_status, r.row_text) for r in books.displayed(hits, rows).collect()}
    assert got == {(1, 0): ("ok", "שורה ראשונה בספר הזה"), (1, 1): ("stale", "אחרת"), (2, 0): ("unavailable", "אין")}


def test_rehydrated(spark):
    lines = spark.createDataFrame([(1, "a\U0001d122b"), (2, "x"), (3, None)], "id long, raw string")
    notes = spark.createDataFrame([(1, 3, 0, "n"), (1, 99, 1, "end"), (3, 0, 0, "z"), (2, None, 0, "q")], "id long, char_pos int, note_no int, body string")
    got = {r.id: r.raw for r in books.rehydrated(lines, notes).collect()}
    assert got == {1: 'a\U0001d122<i class="footnote">n</i>b<i class="footnote">end</i>', 2: "x", 3: None}


def test_difference_and_stamps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, t string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "id long, t string")
    assert {(r.id, r.change) for r in difference(a, b, "id", "t").collect()} == {(1, "removed"), (3, "changed"), (4, "added")}


def test_stored_postings(spark, tmp_path):
    c = build(spark.createDataFrame([(i, f"w{i % 3} common x{i}") for i in range(30)] + [(99, None)], "id long, raw string"))
    c.write(str(tmp_path / "c"))
    s = Corpus.read(spark, str(tmp_path / "c"))
    for q in (Query([plan_word("w1")]), Query([plan_word("w1"), plan_word("common")], [0]), Query([plan_word("none")])):
        assert sorted(r.id for r in search(s, q).rows.select("id").collect()) == sorted(r.id for r in search(c, q).rows.select("id").collect())
    assert {(r.term, r.df) for r in s.terms().collect()} == {(r.term, r.df) for r in c.terms().collect()}


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"רמב\\"ם": ["רבי משה בן מיימון"]}', encoding="utf-8")
    (tmp_path / "t.json").write_text('{"d": [{"מלתא": "דבר"}]}', encoding="utf-8")
    (tmp_path / "x.json").write_text("no json", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("# c\nטוב\tרע\n", encoding="utf-8")
    assert lexicons.load_json(spark, str(tmp_path / "a.json"), "acronym").count() == 1 and lexicons.load_json(spark, str(tmp_path / "t.json"), "translation").count() == 1
    assert lexicons.load_json(spark, str(tmp_path / "x.json"), "acronym") is None and lexicons.load_json(spark, str(tmp_path / "no"), "acronym") is None
    assert [tuple(r) for r in lexicons.load_blacklist(spark, str(tmp_path / "b.tsv")).collect()] == [("טוב", "רע")]
    assert lexicons.load_morphology(spark, str(tmp_path / "x.json")) is None
    assert lexicons.glosses("דבר, ענין גדול; מלה (הערה)/שיח") == ["דבר", "מלה", "שיח"]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0])], "key string, embedding array<double>")
    assert [(r.key, round(r.similarity, 3)) for r in vectors.knn(v, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 0.5)]
    i = vectors.info(v).first()
    assert (i.vectors, i["keys"], i.broken) == (5, 5, 1)
    new = vectors.with_delta(v, spark.createDataFrame([("a", [0.0, 1.0])], v.schema), spark.createDataFrame([("b",)], "key string"))
    assert sorted(r.key for r in new.collect()) == ["a", "c", "d", "e"]
    assert vectors.recall(spark.createDataFrame([(1, "a")], "query int, key string"), spark.createDataFrame([(1, "a"), (1, "b")], "query int, key string")).first().recall == 0.5
    with pytest.raises(vectors.SearchError):
        vectors.Ranking(fusion="none")
    assert [vectors.alpha_for(q) for q in ('"a b"', "a 5", "a", "a b c", "a b c d e")] == [1.0, 0.85, 0.7, 0.5, 0.3]
    lex, sem = (spark.createDataFrame(r, "id long, score double") for r in ([(1, 2.0), (2, 1.0)], [(2, 0.9), (3, 0.8)]))
    got = {r.id: r for r in vectors.fuse(lex, sem, vectors.Ranking()).collect()}
    assert got[2].source == "both" and got[2].score == pytest.approx(1 / 62 + 1 / 61) and got[1].source == "lexical"
    w = {r.id: r.score for r in vectors.fuse(lex, sem, vectors.Ranking("weighted", alpha=0.5)).collect()}
    assert w[2] == pytest.approx(0.5 * 0.5 + 0.5)


def test_stream_ingest(spark, tmp_path):
    from quire.streaming.ingest import ingest

    src = str(tmp_path / "in")
    store = Store(spark, str(tmp_path / "store"))
    make = lambda path, text: spark.createDataFrame([(path, "t", "/a", text, [], 0)], books.BOOK).write.mode("append").parquet(src)
    make("p", "אחת\nשתים")
    ingest(spark, src, books.BOOK, store, str(tmp_path / "cp")).awaitTermination()
    assert store.lines().count() == 2
    make("q", "שלש")
    ingest(spark, src, books.BOOK, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.plain for r in store.lines().collect()) == sorted(["אחת", "שתים", "שלש"])


def test_sections_over_stretches(spark, monkeypatch):
    from quire.operators import corpus

    monkeypatch.setattr(corpus, "STRETCH", 3)
    raws = ["x", "<h1>A</h1>", "a", "<h2>B</h2>", "b", "c", "d", "e", "f", "g", "<h1>C</h1>", "h", "i", "<h3>D</h3>", "j"]
    df = spark.createDataFrame([(p, i, r) for p in ("p", None) for i, r in enumerate(raws)] + [("q", 0, None), ("q", 7, "late")], "file_path string, ordinal int, raw string")
    got = {(r.file_path, r.ordinal): (r.section_ordinal, r.reference) for r in corpus.with_sections(df).collect()}
    for p in ("p", None):
        assert [got[p, i] for i in range(15)] == [(0, ""), (1, "A"), (1, "A"), *[(3, "A, B")] * 7, (10, "C"), (10, "C"), (10, "C"), (13, "C, D"), (13, "C, D")]
    assert got["q", 0] == got["q", 7] == (0, "") and len(got) == 32

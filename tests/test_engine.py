import pytest
from pyspark.sql import functions as F

from quire.engine import SearchEngine, quoted
from quire.sources.books import BOOK
from quire.operators.search import ANY, AT_LEAST, GENERATION, IDENTICAL_TEXT, MOST, RELEVANCE, SAME_PARAGRAPH, SAME_SECTION, SAME_SECTION_GROUPS


@pytest.fixture(scope="module")
def device(spark, tmp_path_factory):
    e = SearchEngine(spark, str(tmp_path_factory.mktemp("device")))
    given = [("id:101", "Device A", "/devices", "<h1>חומרה</h1>\nמחשב מהיר\nמסך כחול\nמחשב קטן", [], 0), ("id:202", "Device B", "/devices", "מחשב מהיר\nמַחְשֵׁב נוח\nמסך ירוק", [], 0), ("id:303", "Accessory", "/accessories", "מקלדת שחורה\nמחשב קטן", [], 0)]
    e.add_text_books(spark.createDataFrame(given, BOOK))
    e.commit()
    e.set_book_order(spark.createDataFrame([("id:202", 0, 2), ("id:303", 1, 0), ("id:101", 2, 1)], "file_path string, catalogue_order int, generation_order int"))
    return e


def at(p):
    return [(r.id >> 32, r.ordinal) for r in (p.rows if hasattr(p, "rows") else p).collect()]


CAT = [(2, 0), (2, 1), (3, 1), (1, 1), (1, 3)]


def test_golden_contract(device):
    e = device
    p = e.search_exact("מחשב")
    assert at(p) == CAT and p.total == 5
    assert at(e.search_exact("מחשב", order=GENERATION)) == [(3, 1), (1, 1), (1, 3), (2, 0), (2, 1)]
    assert sorted(at(e.search_exact("מחשב", order=RELEVANCE))) == sorted(CAT)
    assert at(e.search_exact("מחשב מהיר")) == [(2, 0), (1, 1)] and at(e.search_exact("מחשב מהיר", order=GENERATION)) == [(1, 1), (2, 0)]
    assert at(e.search_fuzzy("מחשף", max_distance=1)) == CAT
    p = e.search_exact("מחשב", grouping=IDENTICAL_TEXT)
    assert at(p) == CAT and (p.total, p.groups) == (5, 5) and {r.merged_count for r in p.rows.collect()} == {1}
    p = e.search_exact("מחשב", limit=2, offset=1)
    assert at(p) == [(2, 1), (3, 1)] and p.total == 5
    assert at(e.search_exact("מחשב", facets=["/devices"])) == [(2, 0), (2, 1), (1, 1), (1, 3)]
    assert at(e.search_exact("מַחְשֵׁב", match_nikud=True)) == [(2, 1)]
    assert at(e.search_advanced("מסך", negative_query="ירוק", scope=SAME_PARAGRAPH)) == [(1, 2)]
    assert {r.file_path: r["count"] for r in e.count_by_book("exact", "מחשב").collect()} == {"id:101": 2, "id:202": 2, "id:303": 1}
    assert e.get_document_count() == 9 and e.search_exact("מחשב").rows.where("file_path = 'id:101'").first().reference == "חומרה"
    assert {r.path: r["count"] for r in e.get_facet_counts("exact", "מחשב").collect()} == {"/devices": 4, "/accessories": 1}
    assert e.search_exact("").total == 0 and e.search_exact("?!").total == 0 and e.search_fuzzy("?!").total == 0
    assert e.book_order_revision() == 1 and e.check_index_compatibility() == "compatible"


def test_families_by_name(device):
    e = device
    assert e.count_exact("מחשב") == 5 and e.count_by_book_exact("מחשב").count() == 3 and e.get_facet_counts_exact("מחשב").count() == 2
    assert e.count_fuzzy_with_status("מחשב", max_distance=0).count == 5 and e.search_and_count_advanced("מחשב", limit=1).total == 5
    assert sum(len(c) for c in e.search_exact_stream("מחשב", 2)) == 5 and not e.get_facet_counts_advanced_with_status("מחשב")[1]
    assert e.semantic_passage_highlights("one two three four, five six seven eight.", [[1.0, 0.0], [0.0, 1.0]], [0.0, 2.0]).endswith("<mark>five six seven eight.</mark>")
    assert e.generate_index_fuzzy_highlight_pattern("מחשב", max_distance=0) == [["מחשב"]]
    with e.lexical_cancellation_handle("r1"):
        assert e.count_exact("מחשב") == 5
    e.cancel_lexical_search("unknown")


def test_streams(device):
    assert [len(x) for x in device.stream("exact", "מחשב", 2)] == [2, 2, 1]
    first, *rest = device.stream_with_counts("exact", "מחשב", 3)
    assert first.total == 5 and [len(u.rows) for u in rest] == [3, 2]
    events = list(device.search_user_regex_stream("מחש."))
    assert events[-1].done and sum(len(u.rows) for u in events) == 5


@pytest.fixture(scope="module")
def law(spark, tmp_path_factory):
    e = SearchEngine(spark, str(tmp_path_factory.mktemp("law")))
    e.add_text_book("T", "/root", "b", "<h1>דינים</h1>\n<h2>סימן א</h2>\nדין אינו מתכוין בשבת\nודין מתעסק בחלבים ועריות\n<h2>סימן ב</h2>\nכאן נדון רק במלאכת שבת\nמתעסק וגם אינו מתכוין באותה שורה")
    e.commit()
    return e


def lines(e, q, **a):
    return sorted(r.ordinal + 1 for r in e.search_advanced(q, **a).rows.collect())


def test_sections_negatives_and_partial(law):
    assert lines(law, "מתכוין מתעסק") == [] and lines(law, "מתכוין מתעסק", scope=SAME_PARAGRAPH) == [7] and lines(law, "מתכוין מתעסק", scope=SAME_SECTION) == [3, 4, 7]
    assert lines(law, "בשבת נדון", scope=SAME_SECTION) == []
    assert lines(law, "מתכוין", negative_query="מתעסק בחלבים", scope=SAME_SECTION, negative_scope=SAME_SECTION) == [7]
    assert lines(law, "מתכוין", negative_query="בחלבים נדון", scope=SAME_SECTION, negative_scope=SAME_SECTION) == [3, 7]
    assert lines(law, "מתכוין בחלבים", word_match_mode=ANY) == [3, 4, 7] and lines(law, "מתכוין מתעסק בחלבים", word_match_mode=MOST) == [4, 7]
    three = "מתכוין מתעסק בחלבים"
    assert [lines(law, three, word_match_mode=AT_LEAST, word_match_count=k) for k in (3, 10, 2, 0, None)] == [[], [], [4, 7], [3, 4, 7], [3, 4, 7]]
    assert lines(law, "מתכוין בחלבים נדון", word_match_mode=MOST, scope=SAME_SECTION) == [3, 4, 6, 7]


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    """Lines with fillers between, so that no phrase runs over a line break."""
    e = SearchEngine(spark, str(tmp_path_factory.mktemp("words")))

    given = []

    def book(path, rows, filler=True):
        given.append((path, path, "/root", "\n".join(f"{x}\nמילוי" if filler else x for x in rows), [], 0))

    book("order", ["חייב להחזיר", "להחזיר חייב", "להחזיר את החפץ חייב", "להחזיר את החפץ הזה חייב", "חייב לשלם ולא להחזיר", "אמר רבי יוחנן", "אמר רבי אמר"])
    book("pair", ["ארץ הארץ (הוצא) [היצא] אתך", "כי [אם] עונותיכם"])
    book("cross", ["ויבדל בין המים אשר מתחת לרקיע ובין המים", "ויאמר אלהים יקוו המים"], False)
    book("typo", ["ברכה", "ברכגה", "תורה"])
    book("fuzzy", ["שלום", "שלם", "ביי"])
    book("tiers", ["ברקה", "בריכה", "ובברכה", "ברכה"])
    book("quotes", ["אמר רמב\"ם בהלכות", "כתב רבי משה בן מיימון בספרו", "דבר אחר"])
    book("long", ["א" * 80 + " ארוך", "ב" * 60 + " קצר"])
    book("voc", ["בְּרֵאשִׁית ברא", "ברָאשית נברא"])
    book("edge", ["סוף {פ}", "(א) התחלה טובה"], False)
    e.add_text_books(spark.createDataFrame(given, BOOK))
    e.commit()
    return e


def found(e, path, q, **a):
    family = a.pop("family", "advanced")
    return sorted(r.ordinal for r in e.search(family, q, **a).rows.where(F.col("file_path") == path).collect())


def test_orders_and_gaps(words):
    f = lambda q, **a: [x // 2 for x in found(words, "order", q, **a)]
    assert [f("חייב להחזיר", distance=d, any_order=True) for d in range(4)] == [[0, 1], [0, 1], [0, 1, 2, 4], [0, 1, 2, 3, 4]]
    assert f("חייב להחזיר") == [0] and f("חייב להחזיר", distance=3) == [0, 4]
    assert f("אמר אמר", any_order=True) == [] and f("אמר אמר", any_order=True, distance=1) == [6]
    assert f("חייב להחזיר", custom_spacing={"0-1": "2"}) == [0, 4]
    assert [r.ordinal // 2 for r in words.search_advanced("חייב להחזיר", distance=3, any_order=True, order=RELEVANCE).rows.collect()][-1] == 3


def test_pairs_quotes_and_long_tokens(words):
    f = lambda q, **a: len(found(words, "pair", q, **a))
    assert (f("הארץ היצא אתך"), f("הארץ הוצא אתך"), f("הארץ אתך"), f("הארץ אתך", distance=1), f("כי עונותיכם")) == (1, 1, 0, 1, 0)
    assert found(words, "quotes", "רמבם", family="exact") == [0] and found(words, "quotes", 'רמב"ם', family="exact") == [0] and found(words, "quotes", "רמב״ם", family="exact") == [0]
    assert found(words, "long", "א" * 80, family="exact") == [] and found(words, "long", "ב" * 60, family="exact") == [2]


def test_cross_line(words):
    p = words.search_advanced("ובין המים ויאמר אלהים")
    rows = p.rows.collect()
    assert p.total == 1 and rows[0].ordinal == 0 and rows[0].continues_to_next_line and rows[0].text.count("<br>") == 1 and rows[0].text.count("<font color=red>") == 4
    assert found(words, "cross", "המים ויאמר", distance=2) == [0] and found(words, "cross", "ובין ויאמר") == [] and found(words, "cross", "ובין ויאמר", distance=1) == [0]
    assert found(words, "edge", "סוף התחלה") == [0] and found(words, "cross", "ובין ויאמר", scope=SAME_PARAGRAPH) == []
    assert found(words, "cross", "המים ויאמר", any_order=True) == []


def test_expansions(words):
    assert found(words, "typo", "ברכה", typo=True)[:2] == [0, 2] and found(words, "typo", "ברכה") == [0]
    assert found(words, "fuzzy", "שלום", family="fuzzy", max_distance=0) == [0] and found(words, "fuzzy", "שלום", family="fuzzy", max_distance=1) == [0, 2]
    with pytest.raises(ValueError):
        words.search_fuzzy("שלום", max_distance=3)
    ranked = [r.ordinal // 2 for r in words.search_advanced("ברכה", prefix=True, spelling=True, typo=True, order=RELEVANCE).rows.where("file_path = 'tiers'").collect()]
    assert ranked == [3, 2, 1, 0]
    assert found(words, "voc", "ברֵאשית", family="exact", match_nikud=True) == [0]
    assert found(words, "order", "שלם", prefix=True) == [8] and found(words, "order", "שלם", gram_prefix=True) == [8]
    assert found(words, "order", "ושלם", alternative_words={0: ["לשלם"]}) == [8]
    h = words.count_with_status("regex", ["(?:ו|ב|ה)?(?:אמר|רבי)"], max_expansions=1)
    assert h.truncated and h.count == 3 and not words.count_with_status("regex", ["אמר"]).truncated


def test_regexes(words):
    assert found(words, "order", "אמר רבי (?:יוחנן|אמר)", family="user_regex", highlight=False) == [10, 12]
    assert found(words, "order", "^אמר.*אמר$", family="user_regex", highlight=False) == [12]
    assert found(words, "edge", "סוף$", family="user_regex", highlight=False) == [0] and found(words, "edge", "^התחלה", family="user_regex", highlight=False) == [1]
    assert found(words, "order", "ל[הש].+", family="user_regex", highlight=False) == [0, 2, 4, 6, 8]


def test_smart_and_lexicons(spark, words):
    assert quoted('"אמר רבי" רמב"ם x') == ([["אמר", "רבי"]], ['רמב"ם', "x"]) and quoted('אמר "רבי') == ([], ["אמר", "רבי"])
    assert found(words, "order", '"רבי אמר" אמר', family="smart") == [12] and found(words, "order", "רבי אמר", family="smart") == [10, 12]
    words.set_acronyms_dictionary(spark.createDataFrame([('רמב"ם', "רבי משה בן מיימון")], "acronym string, expansion string"))
    assert found(words, "quotes", 'רמב"ם', acronym=True) == [0, 2] and found(words, "quotes", "רבי משה בן מיימון", acronym=True) == [0, 2]
    assert found(words, "quotes", 'רמב"ם') == [0]
    words.set_translation_dictionary(spark.createDataFrame([("d", "מלתא", "דבר, ענין גדול")], "dictionary string, headword string, gloss string"))
    assert found(words, "quotes", "מלתא", translation=True) == [4] and found(words, "quotes", "מלתא") == []


def test_facets_and_groups(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    given = [
        ("1", "1", "/root/x", "דבר המלך", ["/era/ראשונים", "/author/a"], 0), ("2", "2", "/root/x", "דבר המלך", ["/era/אחרונים"], 0), ("3", "3", "/root/y", "דבר המלך", ["/era/ראשונים", "/base"], 0),
        ("4", "4", "/root/z", "<h1>א</h1>\nשירה ראשונה\nשירה שניה\n<h1>ב</h1>\nאחר", [], 0), ("5", "5", "/root/z", "אמר רבי עקיבא לתלמידיו", [], 0), ("6", "6", "/root/z", "אמר, רבי עקיבא לתלמידיו\nרבי עקיבא", [], 0),
    ]
    e.add_text_books(spark.createDataFrame(given, BOOK))
    e.commit()
    n = lambda *f: e.count("exact", "דבר המלך", list(f))
    era = "/era/ראשונים"
    assert [n(), n(""), n(era), n(era, "/era/אחרונים"), n(era, "/root/x"), n("/era/אחרונים", "/root/y"), n("/base"), n("/root/x", "/root/y"), n("/root")] == [3, 3, 2, 3, 1, 0, 1, 3, 3]
    with pytest.raises(ValueError):
        n("no path")
    p = e.search_exact("שירה", grouping=SAME_SECTION_GROUPS)
    r = p.rows.collect()
    assert (p.total, p.groups, len(r)) == (2, 1, 1) and (r[0].merged_count, len(r[0].siblings), r[0].ordinal) == (2, 1, 1)
    p = e.search_exact("עקיבא", grouping=IDENTICAL_TEXT)
    assert (p.total, p.groups) == (3, 2) and e.search_exact("עקיבא", grouping=IDENTICAL_TEXT, offset=1, limit=1).rows.count() == 1


def test_store(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    assert e.check_index_compatibility() == "missing_index"
    assert e.add_text_book("t", "", "p", "") == 0 and e.add_text_book("t", "/a", "p", "אחת\nשתים\nשלש") == 3
    assert e.get_document_count() == 0
    e.commit()
    assert e.get_document_count() == 3
    e.add_text_book("u", "/a", "q", b"\xff ab")
    e.rollback()
    e.commit()
    assert e.get_document_count() == 3
    row = spark.createDataFrame([("p", 1, "t", "חדש"), ("r", 0, "v", "עוד")], "file_path string, ordinal int, title string, text string")
    e.upsert_documents_batch(row)
    e.delete_document_by_id((1 << 32) + 3)
    e.commit()
    got = {(r.id >> 32, r.ordinal): r.plain for r in e.store.lines().collect()}
    assert len(got) == 3 and sorted(got.values()) == sorted(["אחת", "חדש", "עוד"]) and got[1, 1] == "חדש"
    new = next(k[0] for k, v in got.items() if v == "עוד")
    e.delete_documents_by_file_path("r")
    e.commit()
    e.add_text_book("w", "/a", "s", "אחר")
    e.commit()
    assert {r.id >> 32 for r in e.store.lines().collect()} == {1, new + 1}  # numbers are never given again
    before = sorted(r.id for r in e.store.lines().collect())
    e.optimize()
    assert sorted(r.id for r in e.store.lines().collect()) == before and e.get_segment_count() == 1
    s = {r.file_path: r for r in e.get_book_stamps().collect()}
    assert s["s"].documents == 1 and s["s"].text_hash != 0 and s["p"].text_hash == 0  # an upserted line disagrees
    e.remove_documents_by_title("w")
    e.commit()
    assert e.get_indexed_file_paths().count() == 1
    e.clear()
    e.commit()
    assert e.get_document_count() == 0


def test_pdf(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    pages = [("p. 1", "שורה אחת של טקסט\n" + "#$%^ 12 " * 10, 0), ("p. 2", "בְּרֵאשִׁית ברא", 1)]
    assert e.add_pdf_book("t", "/a", "f", pages) == 2
    e.commit()
    assert [(r.segment, r.is_pdf, r.reference) for r in e.search_exact("בראשית ברא").rows.collect()] == [(1, True, "p. 2")]
    assert e.store.lines().where("segment = 0").first().plain == "שורה אחת של טקסט"
    e.add_pdf_book("u", "/a", "g", [("p. 1", "דבר אחד נאמר כאן (ג)\n(ד) ועוד דבר שני\nוסוף דבר (ה)", 0)])
    e.commit()
    n = lambda q, **a: e.count("advanced", q, **a)
    assert n("כאן ועוד") == 1 and n("נאמר ועוד") == 0 and n("נאמר ועוד", distance=1) == 1 and n("כאן ג") == 1 and n("ד ועוד") == 1 and n("כאן ג ד ועוד") == 1
    assert n("שני וסוף") == 1 and n("דבר ה") == 1 and n("ועוד כאן", any_order=True) == 1
    data = "אב\nגד".encode()
    with pytest.raises(ValueError):
        e.add_pdf_book_bytes("t", "/a", "g", data, [0, 99], ["a", "b"])
    assert e.add_pdf_book_bytes("t", "/a", "g", data, [0, 5], ["a", "b"]) == 2


def test_regex_stream_and_limit(words, monkeypatch):
    from quire.operators import regexes

    monkeypatch.setattr(regexes, "MAX_HITS", 3, raising=False)
    lines = lambda rows: sorted(r.id for r in rows)
    pattern = "^.+"
    every = regexes.matched(words.corpus(), pattern)
    ids = lines(every.rows.collect())
    streamed = [r.id for u in words.search_user_regex_stream(pattern) for r in u.rows or []]
    assert not every.truncated and len(ids) > 3 and sorted(streamed) == ids
    some = regexes.matched(words.corpus(), pattern, limit=3)
    assert some.truncated and len(lines(some.rows.collect())) == 3 and lines(some.rows.collect()) == lines(some.rows.collect())
    whole = regexes.matched(words.corpus(), pattern, limit=len(ids))
    assert not whole.truncated and lines(whole.rows.collect()) == ids


def test_morphology(spark, tmp_path):
    from quire.operators.lexicons import Morphology

    e = SearchEngine(spark, str(tmp_path))
    texts = {10: "הלך", 5: "הולכים", 1: "הלב", 7: "אחר"}
    e.add_text_book("t", "", "p", "\n".join(texts.get(i, "") for i in range(12)))
    e.commit()
    base = spark.createDataFrame([(1, "הלכ"), (2, "ישנ")], "id long, value string")
    surface = spark.createDataFrame([(1, "הלכתי", 1), (2, "הולכ", 1), (4, "הולכימ", 1), (6, "ישנ", 2)], "id long, value string, base_id long")
    e.set_magic_dictionary(Morphology(base, surface))
    ranked = [r.ordinal for r in e.search_fuzzy("הלך", max_distance=1, order=RELEVANCE).rows.collect()]
    assert ranked == [10, 5, 1]
    forms = {r.form for r in Morphology(base, surface).forms(["הלך"]).collect()}
    assert forms == {"הלכתי", "הולכ", "הולכימ"}


def test_morphology_takes_no_hits_away(spark, tmp_path):
    from dataclasses import replace

    from quire.operators.lexicons import Morphology

    e = SearchEngine(spark, str(tmp_path))
    letters = "אבגדהוזחטיכלמנסעפצקרש"
    e.add_text_book("t", "", "p", "\n".join(["דבר", "דיברתי", *(f"{x}{y}דבר" for x in letters for y in letters[:8])]))
    e.commit()
    ids = lambda: {r.ordinal for r in e.search_fuzzy("דבר", max_distance=2, limit=1000).rows.collect()}
    without = ids()
    assert len(without) == 1 + 21 * 8
    base, surface = spark.createDataFrame([(1, "דבר")], "id long, value string"), spark.createDataFrame([(1, "דיברתי", 1)], "id long, value string, base_id long")
    e.set_magic_dictionary(Morphology(base, surface))
    assert ids() == without | {1}
    q = e.fuzzy_query("דבר")
    assert not e.hits(q).truncated
    cut = e.hits([replace(q[0], cap=100)])
    assert cut.truncated and len(cut.words[0].terms) == 100 and list(cut.words[0].terms)[:2] == ["דבר", "דיברתי"]


def test_semantic(spark, device):
    lines = device.corpus().lines.select("id", "file_path").collect()
    keys = spark.createDataFrame([(r.id, r.file_path, f"k{i % 4}") for i, r in enumerate(sorted(lines, key=lambda r: r.id))], "id long, file_path string, key string")
    vec = spark.createDataFrame([("k0", [1.0, 0.0]), ("k1", [0.0, 1.0]), ("k2", [-1.0, 0.0]), ("k9", [0.5, 0.5])], "key string, embedding array<double>")
    with pytest.raises(ValueError):
        device.search_semantic("מחשב", [1.0, 0.0], keys, mode="semanticOnly")
    rows, reason = device.search_semantic("מחשב", [1.0, 0.0], keys)
    assert reason == "notConfigured" and rows.count() == 5
    device.install_semantic_vectors(vec)
    rows, reason = device.search_semantic("מחשב", [1.0, 0.0], keys)
    got = rows.collect()
    ids = {r.id for r in keys.where("key = 'k0'").collect()}
    assert reason is None and {r.id for r in got if r.source != "lexical"} == ids and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    only, _ = device.search_semantic("מחשב", [1.0, 0.0], keys, mode="semanticOnly", facets=["/accessories"])
    assert all(r.file_path == "id:303" for r in only.collect())
    assert {(r.key, r.change) for r in device.semantic_index_diff(keys).collect()} == {("k3", "added"), ("k9", "removed")}
    assert device.semantic_coverage(keys).agg(F.sum("covered")).first()[0] == sum(1 for r in keys.collect() if r.key != "k3")
    assert device.install_semantic_vectors(spark.createDataFrame([("k3", [1.0, 0.1]), ("K0", [0.0, 1.0])], "key string, embedding array<double>"), delta=True, tombstones=spark.createDataFrame([("k9",)], "key string")) == 2
    assert device.semantic_vectors_info().first().keys == 4 and device._vectors().where("key = 'k0'").first().embedding == [0.0, 1.0]
    device.restore_semantic_generation()
    assert {r.key for r in device._vectors().collect()} == {"k0", "k1", "k2", "k9"}
    device.compact_semantic_vectors()
    assert device.retire_previous_semantic_generation() > 0 and device.semantic_vectors_info().first().vectors == 4
    again = SearchEngine(spark, device.path)
    assert again.semantic_status() == "ready" and at(again.search_exact("מחשב")) == CAT
    s = device.semantic_session("מחשב", [1.0, 0.0], keys, grouping=IDENTICAL_TEXT)
    both = [r.id for r in s.page(2).collect()] + [r.id for r in s.page(10, 2).collect()]
    assert both == [r.id for r in s.ranked] and s.total == len(set(both)) and not s.restarted and device.semantic_session("מחשב", [1.0, 0.0], keys, grouping=IDENTICAL_TEXT) is s
    device.disable_semantic()
    assert device.semantic_status() == "notConfigured"
    assert device.semantic_session("מחשב", [1.0, 0.0], keys, grouping=IDENTICAL_TEXT).restarted


def test_page_order_without_broadcast(spark, device):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert at(device.search_exact("מחשב")) == CAT and at(device.search_exact("מחשב", order=GENERATION)) == [(3, 1), (1, 1), (1, 3), (2, 0), (2, 1)]
        assert [(r.id >> 32, r.ordinal) for part in device.stream("exact", "מחשב", 2) for r in part] == CAT
        assert at(device.search_exact("מחשב", limit=2, offset=3)) == CAT[3:]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_index_follows_commits(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    e.add_text_book("t", "/a", "p", "אחת שתים\nשלש\nאַחַת עוד")
    e.commit()
    assert e.count_exact("אחת") == 2 and e.search_exact("אַחַת", match_nikud=True).total == 1
    assert [r.text for r in e.search_exact("אחת").rows.collect()][1] == "<font color=red>אַחַת</font> עוד"
    e.upsert_documents_batch(spark.createDataFrame([("p", 1, "אחת אחת")], "file_path string, ordinal int, text string"))
    e.delete_document_by_id((1 << 32) + 1)
    e.commit()
    assert e.count_exact("אחת") == 2 and e.count_exact("שלש") == 0 and e.count_exact("שתים") == 0
    assert {(r.term, r.df) for r in e.terms().collect()} == {("אחת", 2), ("עוד", 1)}
    e.optimize()
    assert e.count_exact("אחת") == 2
    assert [r.id for r in e.neighbour((1 << 32) + 2).collect()] == [(1 << 32) + 3] and e.get_documents_by_ids([1, 2]).count() == 0
    assert e.count("advanced", "אחת", alternative_words={0: ["לא כן", "שלש"]}) == 2 and e.count("advanced", "זה", alternative_words={0: ["אחת אחת"]}) == 1
    plan = e.hits(e.exact_query("אחת")).rows.select("id")._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term" in plan


def test_line_sources(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    e.add_text_books(spark.createDataFrame([(p, p, "", "דבר אחד\nדבר שני\nדבר שלישי", [], 0) for p in ("id:1", "uid:2", "db:x:3")], BOOK))
    e.commit()
    rows = lambda *r: spark.createDataFrame(list(r), "book_id long, line_index int, content string")
    assert {r.text_status for r in e.search_exact("דבר").rows.collect()} == {None}
    e.configure_line_source("library", rows((1, 0, "דבר אחד"), (1, 1, "אחר לגמרי"), (1, 5, "דבר שלישי")))
    e.configure_line_source("user", rows())
    e.suspend_line_source("user")
    got = {(r.file_path, r.ordinal): r.text_status for r in e.search_exact("דבר").rows.collect()}
    assert [got["id:1", i] for i in range(3)] == ["ok", "stale", "ok"] and {got[p, i] for p in ("uid:2", "db:x:3") for i in range(3)} == {"unavailable"}

import hashlib

from quire.operators import recipe

LINES = "id long, file_path string, ordinal int, section int, text string, notes array<string>"


def test_fixture(spark):
    body = "תורה ודרך ארץ קדמה לתורה והלכה למעשה"
    rows = [("פתח דבר", 0, []), (body, 0, []), (body, 0, []), ("מנשה מלך יהודה ומסורת התורה", 0, []), ("סעיף שני", 1, []), ("גוף הדברים והמשך הטענה העיקרית", 1, ["הערת שוליים ארוכה דיה העוסקת בביאור דברי הראשונים", "קצר"]), ("עיקר הדברים סוף הטקסט העיקרי", 1, []), ("א", 1, None), (None, 1, None)]
    df = spark.createDataFrame([(i, "b", i, s, t, n) for i, (t, s, n) in enumerate(rows)], LINES)
    got = {(r.ordinal, r.window_no): (r.text, r.key) for r in recipe.embedded(df).collect()}
    # keys of the published fixture
    assert got[0, 0] == (f"[PASSAGE] פתח דבר {body} {body}", "5d5ff0d7b5f87b4860aa707c7ea02fe7")
    assert got[1, 0][1] == got[2, 0][1] == "6d3ffed9a099151e30d238a699d9275b" and got[3, 0][1] == "227827e1541bc4b05bcb35afe8008292"
    assert got[4, 0][1] == "058ae4323d2eaa0f558dce0cbe745fc5" and got[5, 0][1] == "177d49912c8b23ff269b2bb65ba89423" and got[5, 1][1] == "e1904856733c79b9267b429fe93e0aff"
    assert set(got) == {(i, 0) for i in range(7)} | {(5, 1)}


def brute(t, window=512, overlap=128):
    t, out, a = t.strip(" "), [], 0
    while True:
        if len(t) - a <= window:
            return out + [t[a:].strip()]
        cut = max((i for i in range(a, a + window) if t[i].isspace()), default=None)
        end = cut if cut is not None and cut - a > window // 2 else a + window
        out.append(t[a:end].strip())
        at = max(a + 1, end - overlap)
        gap = next((i for i in range(at, end) if t[i].isspace()), None)
        while gap is not None and gap < end and t[gap].isspace():
            gap += 1
        a = gap if gap is not None and gap < end else at


def test_windows(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest()[: 1 + i % 9] for i in range(900)]
    texts = [" ".join(words), "x" * 1500, "a " * 400, " ".join(words[:80]) + "\n\n" + "y" * 700 + " end", "short one", "z" * 512, "z" * 513]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", recipe.windows_of(df.t).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), i
        assert all(len(w) <= 512 for w in got[i])


def test_context_over_stretches(spark):
    edge = recipe._STRETCH
    rows = [(i, "b", i, 0 if i < edge + 1 else 1, f"w{i}", None) for i in range(edge - 4, edge + 4)] + [(99, "c", 0, None, "alone", None)]
    got = {(r.file_path, r.ordinal): r.context for r in recipe.with_context(spark.createDataFrame(rows, LINES)).collect()}
    assert got["b", edge] == " ".join(f"w{i}" for i in range(edge - 2, edge + 1)) and got["b", edge - 1] == " ".join(f"w{i}" for i in range(edge - 3, edge + 1))
    assert got["b", edge + 1] == " ".join(f"w{i}" for i in range(edge + 1, edge + 4)) and got["c", 0] == "alone" and len(got) == 9


def test_plan_and_rebuild(spark, tmp_path):
    df = spark.createDataFrame([(i, "b", i, 0, f"a line that is long enough {i % 2}", None) for i in range(4)], LINES)
    keys = sorted({r.key for r in recipe.embedded(df).collect()})
    have = spark.createDataFrame([(keys[0].upper(),), ("gone",), (None,)], "key string")
    out = recipe.plan(df, have, str(tmp_path / "p"))
    assert {k: v["rows"] for k, v in out.items()} == {"records": 4, "books": 1, "embed": 1, "tombstones": 1} and recipe.faults(spark, str(tmp_path / "p")) == []
    vec = lambda *k: spark.createDataFrame([(x, [1.0, 2.0]) for x in k], "key string, embedding array<double>")
    assert recipe.rebuilt(df, vec(*keys, "more"), str(tmp_path / "v")) == {"keys": 2, "missing": 0} and spark.read.parquet(str(tmp_path / "v")).count() == 2
    try:
        recipe.rebuilt(df, vec(keys[0]), str(tmp_path / "w"))
        raise AssertionError("a set with gaps was written")
    except ValueError:
        pass

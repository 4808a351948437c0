import pytest

from quire.llm.markup import blocks, clean, converted, read

CASES = [
    ("<h2>Title</h2>", "## Title", {"html"}),
    ("a<br>b <!-- no --> c &nbsp;d&quot;", 'a\nb c d"', {"html"}),
    ("<ul><li>one</li><li><b>two</b></li></ul>", "- one\n- two", {"html"}),
    ("open <i>never closed", "open never closed", {"html"}),
    ("<p&nbsp;dir=\"rtl\">text</p>", "text", {"html"}),
    ("<pre>x < y\n  z</pre>", "```\nx < y\n  z\n```", {"html"}),
    ("text **bold** and *it* and ~~gone~~ `code *x*`", "text bold and it and gone code *x*", {"markdown"}),
    ("# Head\n- a\n- b", "# Head\n- a\n- b", {"markdown"}),
    ("> said", "said", {"markdown"}),
    ("a [link](https://x.example/1) ![pic](f.png) b", "a link pic b", {"markdown"}),
    ("x\n```\nlet n = 1;\n  # no head\n```\ny", "x\n```\nlet n = 1;\n  # no head\n```\ny", {"markdown"}),
    ("== Head ==", "## Head", {"wiki"}),
    ("a [[target|shown]] [[plain]] '''b''' ''c'' {{note|d}}", "a shown plain b c (d)", {"wiki"}),
    ("'''so'''' is", "so' is", {"wiki"}),
    ("t\n{| class=\"wikitable\"\n! h\n|-\n| 1 || 2\n|}\nu", "t\n| h |\n| 1 | 2 |\nu", {"wiki"}),
    ("see [https://w.example/1 here] now", "see here now", {"wiki"}),
    (r"\section{Head} a \textbf{b \emph{c}} d\cite{k1} \footnote{e}", "# Head\na b c d (e)", {"latex"}),
    ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b", {"latex"}),
    (r"so $a_1^{2}=3$ and \(\frac{1}{2}\) hold", r"so $a_1^{2}=3$ and \(\frac{1}{2}\) hold", {"latex"}),
    (r"<b>x</b> \emph{y} [[z]] **w**", "x y z w", {"html", "latex", "wiki", "markdown"}),
    ("<a hr\u200bef='x'>y</a>", "y", {"html"}),
]

PLAIN = ["6 < 64 and 7 > 3", "R&D, AT&T; x", "5* and 1* more", "a * * * b", "#12 and no. #5", "$96 and $70, both", "רמ''ט אמר רמ''ג", "[Kélbor 3] (x)", "snake_case_name", "{ק} a | b", "<unknown> <3", "a = b == c", "2 * 3 * 4", "\\n is text", ""]


@pytest.mark.parametrize("raw,want,kinds", CASES)
def test_constructs(raw, want, kinds):
    found, k = blocks(raw)
    assert (clean(raw), k) == (want, kinds), [(b.kind, b.text) for b in found]


@pytest.mark.parametrize("raw", PLAIN)
def test_signs_that_stand_for_themselves(raw):
    assert read(raw).kinds == set() and clean(raw) == raw.strip()


def test_two_passes():
    stop = frozenset("the of and in is".split())
    long = "the end of the story is told in the book and in the song and that is the whole of it " * 3
    links = " ".join(f"<a href='{i}'>menu entry {i}</a>" for i in range(12))
    found, _ = blocks(f"<div>{links}</div><div>Home</div><div>{links}</div><p>{long}</p><p>Short one</p><h1>Head</h1>", stop)
    assert [b.label for b in found] == ["residue", "residue", "residue", "text", "text", "structure"]
    assert "menu" not in clean(f"<div>{links}</div><p>{long}</p>", stop)
    assert blocks("Only short", stop)[0][0].label == "text"


def test_table(spark):
    rows = [(1, "<b>x</b>", 5), (1, "<b>x</b>", 5), (2, None, 5), (None, "<b>y</b>", 5), (3, "", 5), (4, "plain", 5), (6, "**a** " * 30_000, 5)]
    common = spark.createDataFrame([("en", "the"), ("en", None)], "lang string, word string")
    df = spark.createDataFrame(rows, "id long, raw string, kinds int")
    got = {r.id: r for r in converted(df, "id", "raw", common).collect()}
    assert set(got) == {1, 3, 4, 6} and got[1].text == "x" and got[1].kinds == ["html"] and got[3].text == "" and got[4].kinds == [] and got[6].kinds == ["markdown"]
    assert converted(df.limit(0), "id", "raw", common).count() == 0


STOP = frozenset("the of and a to in is".split())


def labels(raw):
    return [(b.label, b.kinds) for b in blocks(raw, STOP)[0]]


def test_navigation_is_residue_and_its_neighbours_inherit():
    text = "<p>The end of the story is told in a book to which the reader of the day went in search of a <b>word</b>, and so on.</p>"
    links = "<p>" + " ".join(f'<a href="/{i}">Section number {i}</a>' for i in range(6)) + "</p>"
    raw = f"{links}\n<p>Home</p>\n{links}\n{text}\n<p>A short one</p>\n{text}\n<p>Top</p>"
    assert [x for x, _ in labels(raw)] == ["residue", "residue", "residue", "text", "text", "text", "text"]
    out = clean(raw, STOP)
    assert "Section" not in out and "Home" not in out and "A short one" in out and out.endswith("Top")
    assert [k for _, k in labels("<p>The <i>one</i></p>\n\nplain and simple\n\n**bold** is the word")] == [["html"], [], ["markdown"]]
    assert labels("<!-- only a remark -->") == [("residue", ["html"])] and clean("<!-- only a remark -->", STOP) == ""


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<ol><li>one</li><li>two<ul><li>in</li></ul></li><li>three</li></ol>", "1. one\n2. two\n- in\n3. three"),
        ("Title\n=====\ntext", "# Title\ntext"), ("[[File:x.png|thumb|a caption]] and [[a|b]]", "a caption and b"), ("x {{a|{{b|c}}}} y", "x ((c)) y"), ("{{a {{b|c}} x", "{{a (c) x"),
        ("a<ref name=x>note</ref> b<ref name=x/>", "a (note) b"), ("<nowiki>''as it is''</nowiki>", "''as it is''"), (r"\textbf{a \emph{b \textit{c}}} d", "a b c d"), (r"so \frac{a}{b} is", "so (a)/(b) is"),
        (r"\href{http://x}{label} \cite[p.~1]{k} end", "label end"), (r"open \textbf{never", r"open \textbf{never"), ("* [[a]]\n\n# one\n# two", "- a\n1. one\n2. two"), ("__a__ **b** ***c*** ~~d~~ snake_case_name 2*3*4", "a b c d snake_case_name 2*3*4"),
    ],
)
def test_conversions(raw, want):
    assert clean(raw) == want


def test_time_is_linear():
    import time

    for sign in ("''a ", "\\[\\begin{math}", "<pre>x ", "**a ", "~~a ", "{| x\n", "{{a|", "\\textbf{", "$a=", "<sup class='footnote-marker'>", "{{a}} {{"):
        began = time.perf_counter()
        blocks(sign * (1_000_000 // len(sign)), STOP)
        assert time.perf_counter() - began < 20, sign

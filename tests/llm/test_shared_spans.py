import random

import numpy as np

from quire.llm import shared_spans as m
from quire.llm.shared_spans import rolling, shared_spans, sliding_min


def brute(rows, w=60):
    owners = {}
    for i, t in rows:
        for j in range(len(t) - w + 1):
            owners.setdefault(t[j : j + w], set()).add(i)
    out = {}
    for i, t in rows:
        hit = [False] * len(t)
        for j in range(len(t) - w + 1):
            if len(owners[t[j : j + w]]) > 1:
                hit[j : j + w] = [True] * w
        if any(hit):
            out[i] = sum(hit)
    return out


def test_pieces():
    x = np.array([ord(c) for c in "abcabcab"], dtype=np.uint32)
    h = rolling(x, 3)
    assert h[0] == h[3] and h[1] == h[4] and len({int(v) for v in h}) == 3 and len(rolling(x, 9)) == 0
    for span in range(1, 9):
        assert list(sliding_min(x, span)) == [min(x[i : i + span]) for i in range(len(x) - span + 1)]


def test_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 700)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeאבג\U0001d122 ") for _ in range(r.randrange(2, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    pool = [text(r.choice([8, 11, 12, 13, 30])) for _ in range(25)]
    rows = [(i, text(r.randrange(12)) + (r.choice(pool) if r.random() < 0.6 else "") + text(r.randrange(12))) for i in range(250)]
    rows += [(900, "x" * 3000), (901, "x" * 61), (902, "y" * 200), (903, pool[0] * 40), (904, ""), (905, "z" * 59), (906, "z" * 59)]
    rows += [(1000 + i, "a third of all rows holds this very passage, word by word, to the end" + str(i)) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[0], rows[1], (907, None), (None, rows[2][1])], "id long, t string").selectExpr("id", "t", "1 AS pos", "2 AS hash", "3 AS chars")
    got = {x.id: x for x in shared_spans(df, "id", "t").collect()}
    want = brute(rows)
    assert {k: v.covered for k, v in got.items()} == want and len(want) > 150
    text_of = dict(rows)
    for k, x in got.items():
        assert x.chars == len(text_of[k]) and all(s["end"] - s["start"] >= 60 for s in x.spans) and all(a["end"] < b["start"] for a, b in zip(x.spans, x.spans[1:]))
    assert shared_spans(df.limit(0), "id", "t").count() == 0

import random

from quire.llm import leakage as m
from quire.llm.leakage import leaks, words_of


def brute(docs, items, k=12):
    out = {}
    for d, t in docs:
        w = words_of(t)
        for i, s in items:
            v, best = words_of(s), 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= k:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_WORDS", 300)
    monkeypatch.setattr(m, "BLOCK_WORDS", 150)
    monkeypatch.setattr(m, "MATCHES", 64)
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([5, 12, 30, 90])))) for i in range(12)] + [(50, "a " * 40), (51, "")]
    docs = []
    for d in range(80):
        words = [r.choice(vocab + ["zz"]) for _ in range(r.randrange(30))]
        if r.random() < 0.6:
            w = r.choice(items)[1].split()
            a = r.randrange(max(1, len(w) - 8))
            n = r.choice([11, 12, 13, 40])
            words += w[a : a + n] + [r.choice(vocab)]
        text = " ".join(words)
        docs.append((d, r.choice([text, text.upper().replace("W1", "W1,"), text.replace(" ", "\n"), text.replace("w2", "w​ָ2")])))
    docs += [(200, "a " * 100), (201, ""), (202, "... !"), (203, "A, " * 12), (204, "a " * 11)]
    df = spark.createDataFrame([*docs, docs[0], (205, None), (None, docs[1][1])], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words")
    it = spark.createDataFrame([*items, items[0], (60, None), (None, items[2][1])], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.words for x in leaks(df, "doc_id", "text", it, "item_id", "text").collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 10
    for x in leaks(df, "doc_id", "text", it, "item_id", "text").collect():
        a, b = words_of(dict(docs)[x.doc_id]), words_of(dict(items)[x.item_id])
        assert a[x.doc_word : x.doc_word + x.words] == b[x.item_word : x.item_word + x.words]
    assert leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0

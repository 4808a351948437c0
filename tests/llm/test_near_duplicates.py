import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from quire.llm.common import bare_words
from quire.llm.near_duplicates import BANDS, ROWS, SKETCH_BITS, SLACK, NearDuplicates, connected


def brute(rows):
    by = {}
    for part, key, text in rows:
        if key is not None and text is not None and len(w := bare_words(text)) >= 12:
            by.setdefault(part, set()).add((key, frozenset(Counter(w).items())))
    out = set()
    for part, recs in by.items():
        for (ka, a), (kb, b) in combinations(sorted(recs, key=str), 2):
            ca, cb = Counter(dict(a)), Counter(dict(b))
            i = sum((ca & cb).values())
            if ka != kb and i * 5 >= 4 * (sum(ca.values()) + sum(cb.values()) - i):
                out.add((part, min(ka, kb), max(ka, kb)))
    return out


def make(seed=1, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["a"] * 60
    rows, key = [], 0
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([3, 11, 12, 13, 25, 60]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            words = base[:]
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.3:
                r.shuffle(words)
            key += 1
            rows.append((r.choice("xy"), key, " ".join(words[:2]) + ", " + " ".join(words[2:]) + "."))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = make()
    rows += [rows[3], rows[4], ("x", None, rows[3][2]), ("x", 9001, None), ("x", 9002, ""), ("y", 9003, "... !!"), ("x", 9004, "a " * 5000), ("x", 9005, "a " * 4999)]
    hot = "one two three four five six seven eight nine ten eleven twelve"
    rows += [("y", 10_000 + i, hot + (" x" if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "p string, k long, t string").withColumn("part", F.lit(1)).withColumn("rep", F.lit(2))
    nd = NearDuplicates(df, "k", "t", F.col("p"))
    got = [tuple(r) for r in nd.pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    links = Counter()
    for p, a, b in got:
        links[p, a] += 1
        links[p, b] += 1
    assert all(links[r.part, r.key] == r.links for r in nd.linked().collect())
    groups = {(r.part, r.key): r.group_id for r in nd.groups().collect()}
    assert set(groups) == set(links) and all(groups[p, a] == groups[p, b] for p, a, b in got)


def test_empty(spark):
    nd = NearDuplicates(spark.createDataFrame([], "k long, t string"), "k", "t")
    assert nd.pairs().count() == 0 and nd.groups().count() == 0 and nd.linked().count() == 0


def test_connected(spark):
    e = spark.createDataFrame([("p", i, i + 1) for i in range(40)] + [("p", 100, 101), ("q", 1, 50), ("p", 7, 7)], "part string, a long, b long")
    got = {(r.part, r.node): r.root for r in connected(e, "part", "a", "b").collect()}
    assert got == {("p", i): 0 for i in range(41)} | {("p", 100): 100, ("p", 101): 100, ("q", 1): 1, ("q", 50): 1}


def test_chance_of_a_miss():
    """At exactly 0.8, bands and sketches together miss fewer pairs than 24 bands of 4 did alone."""
    n, bits, far = BANDS * ROWS, SKETCH_BITS, 0.8 - SLACK
    odd, after = [1.0] + [0.0] * bits, []
    for _ in range(2 * n + 1):  # after[b][k]: the chance of k odd cells when b values have flipped a cell
        after.append(odd)
        odd = [(odd[k - 1] * (bits - k + 1) / bits if k else 0) + (odd[k + 1] * (k + 1) / bits if k < bits else 0) for k in range(bits + 1)]
    low = [k for k in range(bits + 1) if 2 * k >= bits or 1 + bits / (4 * n) * math.log(1 - 2 * k / bits) < far]
    sifted = sum(math.comb(n, d) * 0.2**d * 0.8 ** (n - d) * sum(after[2 * d][k] for k in low) for d in range(n + 1))
    assert (1 - 0.8**ROWS) ** BANDS + sifted < (1 - 0.8**4) ** 24
    assert sifted < 1e-9

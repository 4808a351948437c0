import os
import random

import pytest
from pyspark.sql import functions as F

from quire.llm.packing import Bytes, Ranks, packed


def test_cuts():
    text = "אבג" * 7 + "a\U0001d122"
    cuts = Bytes().cuts(text, 10)
    assert "".join(text[a:b] for a, b, _ in cuts) == text and all(len(text[a:b].encode()) == n <= 10 for a, b, n in cuts)
    assert Bytes().cuts("", 10) == [(0, 0, 0)] and Bytes().cuts("a" * 10, 10) == [(0, 10, 10)] and len(Bytes().cuts("a" * 11, 10)) == 2
    with pytest.raises(ValueError):
        Bytes().cuts("\U0001d122", 3)


def test_ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    t = Ranks(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    text = "The quick brown fox אבג jumps over \U0001d122 the lazy dog. " * 9
    cuts = t.cuts(text, 16)
    assert "".join(text[a:b] for a, b, _ in cuts) == text and all(n <= 16 for *_, n in cuts)
    whole = t.encoding.encode_ordinary(text)
    assert t.cuts(text, 10_000) == [(0, len(text), len(whole))]


def test_packing(spark):
    r = random.Random(5)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    docs = []
    for d in range(400):
        words = [r.choice(r.choice(topics) if r.random() < 0.1 else topics[d % 6]) for _ in range(r.choice([3, 20, 50, 120]))]
        docs.append((d, " ".join(words)))
    docs += [(500, ""), (501, "x" * 1000), (502, "x" * 1001), (503, "א" * 1700), (504, "same"), (505, "same")]
    df = spark.createDataFrame([*docs, docs[1], docs[402], (None, "a"), (506, None)], "doc_id long, text string").withColumn("tokens", F.lit(1)).withColumn("shard", F.lit("s"))
    rows = packed(df, "doc_id", "text", capacity=1000, shard_texts=150).collect()
    text = dict(docs)
    by, boxes = {}, {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
        boxes.setdefault(x.container, []).append(x)
    assert set(by) == set(text)
    for d, parts in by.items():
        parts.sort(key=lambda x: x.piece)
        assert [x.piece for x in parts] == list(range(len(parts))) and sum(x.tokens for x in parts) == len(text[d].encode())
        assert len(parts) == 1 or len(text[d].encode()) > 1000
        starts = [x.start for x in parts] + [len(text[d])]
        assert all(len(text[d][a:b].encode()) == x.tokens for x, a, b in zip(parts, starts, starts[1:]))
    used = {k: sum(x.tokens for x in v) for k, v in boxes.items()}
    assert max(used.values()) <= 1000
    assert sum(used.values()) / (1000 * len(used)) > 0.93
    assert packed(df.limit(0), "doc_id", "text").count() == 0
    mixed = [len({x.doc_id % 6 for x in v if x.doc_id < 400}) / len(v) for v in boxes.values() if len(v) > 3]
    assert sum(mixed) / len(mixed) < 0.75  # neighbours share their topic far more often than by chance


def test_a_key_with_two_texts_is_one_of_them(spark):
    texts = {1: ["a" * 2500, "b" * 900], 2: ["c" * 1500, "d" * 2100]}
    df = spark.createDataFrame([(k, t) for k, v in texts.items() for t in (*v, v[0])], "doc_id long, text string")
    got = {}
    for x in packed(df, "doc_id", "text", capacity=1000).collect():
        got.setdefault(x.doc_id, []).append(x)
    for k, v in texts.items():
        assert sum(x.tokens for x in got[k]) in map(len, v) and sorted(x.piece for x in got[k]) == list(range(len(got[k])))

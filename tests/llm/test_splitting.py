import random

import pytest

import quire.llm.splitting as S
from quire.llm.splitting import MARK, oversized, split, split_spans, windows


def sane(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    assert spans and not text[: spans[0][0]].strip() and not text[spans[-1][1] :].strip()
    for a, b in spans:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert b - c <= overlap and d > b and not text[b : max(b, c)].strip()
    return spans


def test_random_texts():
    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice(["word", "longerword", "x", "ab. ", ", ", "\n", " ", " ", "  ", "y" * r.randrange(1, 90), " " * r.randrange(1, 60)]) for _ in range(r.randrange(1, 120)))
        limit = r.choice([16, 40, 100, 512])
        if text.strip():
            sane(text, limit, r.choice([0, limit // 8, limit // 4]))


def test_cuts_at_sentences():
    sentence = "This is a sentence of some length, with a clause. "
    text = (sentence * 40).strip()
    spans = sane(text, 512, 128)
    assert all(text[b - 1] == "." for _, b in spans)
    assert all(c < b for (_, b), (c, _) in zip(spans, spans[1:]))


def cost(spans, text, limit, room):
    """What a choice of pieces costs, None if a start or an end lies at no boundary."""
    ends, starts, costs = S.boundaries(text, limit)
    n = len(text)
    pieces = max(2, -(-(n - room) // (limit - room)))
    even = min(limit, (n + (pieces - 1) * room) / pieces)
    total = 0.0
    for i, (a, b) in enumerate(spans):
        total += S.BALANCE * ((b - a - even) / limit) ** 2
        if b < n:
            total += min(c for e, c in zip(ends, costs) if e == b)
        if i:
            before = spans[i - 1][1]
            total += S.SHORT * (1 - max(before - a, 0) / room) ** 2 if room else 0.0
            total += 0.0 if any(e == before and s == a for e, s in zip(ends, starts)) else S.START * min(c for s, c in zip(starts, costs) if s == a)
    return total


def every(text, limit, room):
    """All choices of pieces, longest pieces not preferred."""
    ends, starts, _ = S.boundaries(text, limit)
    cuts = list(zip(map(int, ends), map(int, starts)))

    def grow(a, spans):
        for b in [*(e for e, _ in cuts), len(text)]:
            if b - a > limit or (spans and b - a <= room) or b <= a or (spans and b <= spans[-1][1]):
                continue
            if b == len(text):
                yield [*spans, (a, b)]
                continue
            own = {s for e, s in cuts if e == b}
            for s in {s for _, s in cuts if s <= max(own) and s >= b - room} | own:
                if s > a:
                    yield from grow(s, [*spans, (a, b)])

    return grow(0, [])


def test_cheapest_of_all_choices():
    r = random.Random(9)
    for _ in range(60):
        text = " ".join(r.choice(["ab", "cdefg.", "hi,", "jklm", "no\np"]) for _ in range(r.randrange(6, 11)))
        limit, room = r.choice([(16, 4), (20, 5), (18, 0)])
        if len(text) <= limit:
            continue
        least = min(cost(x, text, limit, room) for x in every(text, limit, room))
        assert cost(split_spans(text, limit, room), text, limit, room) == pytest.approx(least), (text, limit, room)


def test_edges():
    assert split("") == [] and split("  \n") == [] and split("a" * 512) == ["a" * 512]
    assert [len(p) for p in split("a" * 513)] == [len(p) for p in split("b" * 513)] and len(split("a" * 513)) == 2
    assert max(map(len, split("אֱ" * 3000))) <= 512 and not any(p[0] == "ֱ" for p in split("אֱ" * 3000))
    assert "".join(split("ab " * 100_000, 512, 0)).replace(" ", "") == "ab" * 100_000
    with pytest.raises(ValueError):
        split("a", 10, 10)


def test_windows(spark):
    long = "one two three. " * 60
    rows = [(1, long, [], "x"), (1, long, [], "x"), (2, "short", ["n", None, long], "x"), (3, None, None, "x"), (4, "", [""], "x"), (None, long, [], "x"), (5, "short", None, "x")]
    df = spark.createDataFrame(rows, "id long, semantic_text string, semantic_notes array<string>, passage string")
    got = windows(df, "id", "semantic_text", "semantic_notes").orderBy("id", "ordinal").collect()
    assert {r.id for r in got} == {1, 2} and all(r.text.startswith(MARK) and len(r.text) <= 512 + len(MARK) for r in got)
    assert [r.ordinal for r in got if r.id == 2] == list(range(len([r for r in got if r.id == 2])))
    assert [(r.passage, r.ordinal) for r in got if r.id == 2][:3] == [(0, 0), (1, 1), (3, 2)]
    assert sorted(tuple(r) for r in oversized(df, "id", "semantic_text", "semantic_notes").collect()) == [(1, 0), (2, 3)]
    blank = spark.createDataFrame([(7, " " * 600, ["x"]), (8, " " * 300 + "a" + " " * 300, None)], "id long, semantic_text string, semantic_notes array<string>")
    assert sorted(tuple(r) for r in oversized(blank, "id", "semantic_text", "semantic_notes").collect()) == [(7, 0), (8, 0)]
    assert [(r.id, r.passage) for r in windows(blank, "id", "semantic_text", "semantic_notes").orderBy("id").collect()] == [(7, 1), (8, 0)]
    assert windows(df.limit(0), "id", "semantic_text", "semantic_notes").count() == 0

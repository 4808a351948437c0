"""Cutting long texts into overlapping pieces at natural boundaries, by dynamic programming over the boundaries.

Every place a piece may end has a penalty: nothing at the end of a paragraph, little at the end of a sentence, more
between clauses, more between words, much inside a word (only offered where no white space is near). A piece that
follows a cut starts up to ``overlap`` characters before it, at a boundary too. Among all ways to cover the text with
pieces under the limit, ends and starts chosen together, the cheapest is taken: penalties of the cuts, part of those of the
starts, what an overlap falls short of the one asked for, and the squared deviation of each piece from the even length.
Time is proportional to the length of the text, as only places within one piece length are compared.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 512, 128
MARK = "[PASSAGE] "
#: Penalties of the kinds of a cut; the deviation of a piece from the even length counts up to BALANCE.
PARAGRAPH, SENTENCE, CLAUSE, WORD, INSIDE, BALANCE = 0.0, 1.0, 3.0, 6.0, 60.0, 8.0
#: How much of a boundary's penalty counts where a piece starts, and the cost of no overlap at all.
START, SHORT = 0.5, 3.0

_GAP = regex.compile(r"\s+")
_SENTENCE_END = regex.compile(r"[.!?׃:…؟。！？][\"'”’״׳)\]]*$")
_CLAUSE_END = regex.compile(r"[,;،、—–][\"'”’)\]]*$")


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places to cut: (where the left side ends, where the right side starts, penalty), in order, without start and end.

    Stretches without white space longer than a quarter of the limit get places inside, never before a combining mark.
    """
    ends, starts, costs = [], [], []
    step, last = max(1, limit // 4), 0

    def inside(lo: int, hi: int) -> None:
        at = lo + step
        while at < hi:
            p = at
            while p > lo + 1 and (unicodedata.combining(text[p]) or text[p] == "\u200d" or text[p - 1] == "\u200d"):
                p -= 1
            p = p if p > lo + 1 else at
            ends.append(p)
            starts.append(p)
            costs.append(INSIDE)
            at = p + step

    for m in _GAP.finditer(text):
        a, b = m.span()
        if a - last > step:
            inside(last, a)
        if 0 < a and b < len(text):
            before = text[max(0, a - 4) : a]
            cost = PARAGRAPH if "\n" in m[0] or "\u2029" in m[0] else SENTENCE if _SENTENCE_END.search(before) else CLAUSE if _CLAUSE_END.search(before) else WORD
            ends.append(a)
            starts.append(b)
            costs.append(cost)
        last = b
    if len(text) - last > step:
        inside(last, len(text))
    return np.array(ends, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(costs, dtype=np.float64)


def split_spans(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces of ``text`` as (start, end), each at most ``limit`` long, consecutive ones sharing at most ``overlap``
    characters and leaving out at most white space between them. A text within the limit is one piece, an empty text none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text.strip() else []
    lead, text = len(text) - len(text.lstrip()), text.strip()
    n = len(text)
    if n <= limit:
        return [(lead, lead + n)] if n else []
    ends, starts, costs = boundaries(text, limit)
    spans = _cheapest(n, ends, starts, costs, limit, min(overlap, limit // 2)) or _cheapest(n, ends, starts, costs, limit, 0)
    return [(lead + a, lead + b) for a, b in spans if text[a:b].strip()]


def _cheapest(n: int, ends: np.ndarray, starts: np.ndarray, costs: np.ndarray, limit: int, room: int) -> list[tuple[int, int]]:
    """The cheapest pieces of a text of ``n`` characters, empty if no choice of boundaries covers it.

    ``close[j]`` is the least cost of everything up to the cut j, ``open_[k]`` that of everything before a piece that starts
    at boundary k (0 is the start of the text). A piece ends more than ``room`` behind its start, so it goes on beyond the
    cut before it, and all cuts a start can follow are settled when it is first needed.
    """
    pieces = max(2, -(-(n - room) // (limit - room)))
    even = min(limit, (n + (pieces - 1) * room) / pieces)
    ends, costs = np.append(ends, n), np.append(costs, 0.0)
    begin, lead = np.append(0, starts), START * np.append(0.0, costs[:-1])
    close, from_ = np.full(len(ends), np.inf), np.full(len(ends), -1)
    open_, after = np.full(len(begin), np.inf), np.full(len(begin), -1)
    open_[0], settled = 0.0, 1
    first = np.searchsorted(ends, begin)  # cut k - 1 is where boundary k lies; earlier cuts end before it
    last = np.searchsorted(ends, begin + room, "right")
    low = np.searchsorted(begin, ends - limit)
    high = np.searchsorted(begin, ends - room)
    for j in range(len(ends)):
        while settled < len(begin) and begin[settled] + room < ends[j]:
            k = settled
            lo, hi = min(int(first[k]), k - 1), int(last[k])
            if lo < hi:
                shared = np.maximum(ends[lo:hi] - begin[k], 0)
                total = close[lo:hi] + (SHORT * (1 - shared / room) ** 2 if room else 0.0) + lead[k]
                total[k - 1 - lo] -= lead[k]  # the piece starts where the one before it ends: one boundary, one penalty
                total[ends[lo:hi] < ends[k - 1]] = np.inf
                i = int(np.argmin(total))
                open_[k], after[k] = total[i], lo + i
            settled += 1
        lo, hi = int(low[j]), max(int(high[j]), 1 if ends[j] <= limit else 0)
        if lo < hi:
            length = ends[j] - begin[lo:hi]
            total = open_[lo:hi] + BALANCE * ((length - even) / limit) ** 2
            i = int(np.argmin(total))
            close[j], from_[j] = total[i] + costs[j], lo + i
    if not np.isfinite(close[-1]):
        return []
    spans, j = [], len(ends) - 1
    while j >= 0:
        k = int(from_[j])
        spans.append((int(begin[k]), int(ends[j])))
        j = int(after[k]) if k else -1
    return spans[::-1]


def split(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """The pieces themselves, white space around them removed."""
    return [text[a:b].strip() for a, b in split_spans(text, limit, overlap)]


_CUT = "id long, passage int, chars int, first int, pieces array<string>"


def _cutter(limit: int, overlap: int):
    """mapInArrow: (id, passages) -> each passage with its pieces and the ordinal of the first of them in its line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, passages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = 0
                for k, text in enumerate(passages):
                    if text is not None:
                        pieces = split(text, limit, overlap)
                        for col, v in zip(out, (key, k, len(text), first, pieces), strict=True):
                            col.append(v)
                        first += len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["id", "passage", "chars", "first", "pieces"])

    return run


def cut_passages(df: DataFrame, key: str, main: str, notes: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The passages of every line that has one over the limit, with their pieces: (id, passage, chars, first, pieces).

    ``passage`` 0 is ``main``, k the k-th of ``notes``; ``chars`` is the length of the passage, ``first`` the ordinal of its
    first piece in the line. Null passages and null lists are none; a blank passage has no piece. Rows with a null key are
    left out; rows repeating a key count once (by key, as they have the same texts). Lines without a long passage are
    dropped by the scan before any text reaches Python.
    """
    passages = F.concat(F.array(F.col(main)), F.coalesce(F.col(notes), F.array().cast("array<string>")))
    rows = df.select(F.col(key).cast("long").alias("id"), passages.alias("passages")).where(F.col("id").isNotNull() & F.exists("passages", lambda t: F.length(t) > limit))
    return rows.dropDuplicates(["id"]).mapInArrow(_cutter(limit, overlap), _CUT)


def windows(df: DataFrame, key: str, main: str, notes: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The windows of every line that has a passage over the limit: (id, passage, ordinal, chars, text), see cut_passages.
    ``ordinal`` counts the windows of a line; ``text`` starts with the mark, which doesn't count."""
    each = cut_passages(df, key, main, notes, limit, overlap).select("id", "passage", "chars", "first", F.posexplode("pieces").alias("at", "piece"))
    return each.select("id", "passage", (F.col("first") + F.col("at")).alias("ordinal"), "chars", F.concat(F.lit(MARK), "piece").alias("text"))


def oversized(df: DataFrame, key: str, main: str, notes: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The passages that the cutter had to divide, or that are over the limit with little but white space: (id, passage)."""
    rows = cut_passages(df, key, main, notes, limit, overlap)
    return rows.where((F.size("pieces") > 1) | (F.col("chars") > limit)).select("id", "passage").distinct()

"""Evaluation texts inside training texts: suffix arrays over shards of the training text, searched with every test suffix.

Both sides become words without case, punctuation, vowel points, invisible characters and kinds of white space. A task
gathers documents into a shard, sorts the shard's suffixes (by prefix doubling) and looks every suffix of every test item
up by binary search. The range of training suffixes that agree in the first ``min_words`` words gives all places; the
ranks of the doubling give how far each match goes on.

Words no test item has can't be part of a match: they only separate. Suffixes that reach such a word within
``min_words`` words are left out of the array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bare_words, offsets_of

MIN_WORDS = 12
#: Documents are gathered to shards of about so many words; one longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Test items are searched in blocks of about so many words: a task holds one block beside its shard at a time.
BLOCK_WORDS = 200_000
#: Matches of a shard and a block are followed at most so many at a time, whatever their number.
MATCHES = 1 << 21

_FOUND = "doc_id long, item_id long, doc_word int, item_word int, words int"


def words_of(text: str) -> list[str]:
    """The words by which texts are compared."""
    return bare_words(unicodedata.normalize("NFC", text).lower())


class Items:
    """A block of test items: their words as numbers, and where each item lies."""

    def __init__(self, rows: list[tuple[int, list[str]]], min_words: int):
        self.min_words, self.vocab, flat, self.ids, self.starts = min_words, {}, [], [], []
        for item, words in rows:
            self.ids.append(item)
            self.starts.append(len(flat))
            flat += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            flat.append(0)
        self.words = np.array(flat, dtype=np.int32)


def suffix_ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For 1, 2, 4, ... words: the rank of each suffix by its first so many words; equal prefixes have equal ranks.
    0 is a separator: prefixes that meet one are compared up to it and never equal to a prefix at another place."""
    n = len(words)
    ranks = [np.where(words == 0, -np.arange(1, n + 1), words).astype(np.int64)]
    k = 1
    while k < longest:
        r = ranks[-1]
        low = r.min() - 1
        after = np.full(n, low, dtype=np.int64)
        after[: max(0, n - k)] = r[k:]
        pair = (r - low) * np.int64(r.max() - low + 1) + (after - low)
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        k *= 2
    return ranks


def search(docs: list[np.ndarray], items: Items) -> tuple[np.ndarray, ...]:
    """All matches of at least ``min_words`` words between a shard and the items, the longest for each document and item:
    (document, item, first word in the document, first word in the item, words)."""
    m = items.min_words
    off = offsets_of([len(d) + 1 for d in docs])
    words = np.zeros(off[-1], dtype=np.int32)
    for d, a in zip(docs, off[:-1], strict=True):
        words[a : a + len(d)] = d
    zero = np.flatnonzero(words == 0)
    free = zero[np.searchsorted(zero, np.arange(len(words)))] - np.arange(len(words))  # words up to the next separator
    lead = np.flatnonzero(free >= m)
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    if not len(lead):
        return none
    # only stretches that hold such a suffix stay, each with the separator that ends it
    keep = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(keep, lead, 1)
    np.add.at(keep, lead + m, -1)
    inside = np.cumsum(keep)[:-1] > 0
    inside[1:] |= inside[:-1] & (words[1:] == 0)
    where = np.flatnonzero(inside)
    train = words[where]
    both = np.concatenate([train, [0], items.words])
    base = len(train) + 1
    levels = suffix_ranks(both, 64)
    new_at = np.full(len(words), -1, dtype=np.int64)
    new_at[where] = np.arange(len(where))
    cand = new_at[lead]
    suffixes = cand[np.argsort(levels[-1][cand], kind="stable")]  # the suffix array of the shard

    def prefix(at: np.ndarray) -> np.ndarray:
        """One number for the first m words of each suffix, in suffix order."""
        top = m.bit_length() - 1
        a, b = levels[top][at], levels[top][np.minimum(at + m - (1 << top), len(both) - 1)]
        return (a - a_low) * np.int64(a_span) + (b - a_low)

    top = m.bit_length() - 1
    a_low = int(levels[top].min())
    a_span = int(levels[top].max()) - a_low + 1
    z = np.flatnonzero(items.words == 0)
    left = z[np.searchsorted(z, np.arange(len(items.words)))] - np.arange(len(items.words))
    tests = np.flatnonzero(left >= m) + base
    keys = prefix(suffixes)
    order = np.argsort(keys, kind="stable")  # equal to the suffix order but for ties within a prefix
    suffixes, keys = suffixes[order], keys[order]
    wanted = prefix(tests)
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    before = offsets_of(hi - lo)
    out = [none]
    for first in range(0, int(before[-1]), MATCHES):
        n = np.arange(first, min(first + MATCHES, int(before[-1])))
        k = np.searchsorted(before, n, "right") - 1
        s, t = suffixes[lo[k] + n - before[k]], tests[k]
        length = _reach(levels, s, t)
        place = where[s]
        out.append(_longest(np.searchsorted(off, place, "right") - 1, np.searchsorted(np.array(items.starts), t - base, "right") - 1, place, t - base, length))
    doc, item, place, t, length = _longest(*(np.concatenate(x) for x in zip(*out, strict=True)))
    return doc, item, place - off[doc], t - np.array(items.starts)[item], length


def _reach(levels: list[np.ndarray], s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``s`` and ``t`` have in common: as many doublings as agree, from large to small,
    again and again."""
    size = len(levels[0])
    length, x, y, more = np.zeros(len(t), dtype=np.int64), s.copy(), t.copy(), np.ones(len(t), dtype=bool)
    while more.any():
        grown = np.zeros(len(t), dtype=bool)
        for k in range(len(levels) - 1, -1, -1):
            ok = more & (x < size) & (y < size)
            ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            step = 1 << k
            length[ok] += step
            x[ok] += step
            y[ok] += step
            grown |= ok
        more = grown
    return length


def _longest(doc: np.ndarray, item: np.ndarray, place: np.ndarray, t: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the matches of each document and item the longest, the first of equals."""
    order = np.lexsort((t, place, -length, item, doc))
    doc, item, place, t, length = doc[order], item[order], place[order], t[order], length[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[first], item[first], place[first], t[first], length[first]


def _search(blocks: list, min_words: int):
    """mapInArrow: (doc_id, text) -> matches. A shard is read and parted into words once, then held against every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list[int], docs: list[list[str]]) -> Iterator[pa.RecordBatch]:
            for sent in blocks:
                block: Items = sent.value
                get = block.vocab.get
                doc, item, a, b, n = search([np.fromiter((get(w, 0) for w in d), dtype=np.int32, count=len(d)) for d in docs], block)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(ids, dtype=np.int64)[doc]), pa.array(np.array(block.ids, dtype=np.int64)[item]), *(pa.array(v.astype(np.int32)) for v in (a, b, n))], ["doc_id", "item_id", "doc_word", "item_word", "words"]
                    )

        ids, docs, have = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < min_words:
                    continue
                ids.append(doc)
                docs.append(words)
                have += len(words)
                if have >= SHARD_WORDS:
                    yield from flush(ids, docs)
                    ids, docs, have = [], [], 0
        if docs:
            yield from flush(ids, docs)

    return run


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents that hold at least ``min_words`` consecutive words of a test item as consecutive words, each with the
    longest match: (doc_id, item_id, doc_word, item_word, words).

    Null ids and texts and texts under ``min_words`` words (empty ones too) match nothing. Repeated rows of either table
    count once. Items go out in blocks, which the driver makes one after the other and keeps on disk for the tasks: what is
    sent grows with the test items (a few bytes a word), not with the documents, which are read once and never leave their
    task. No items or no documents give an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    blocks, block, have = [], [], 0
    send = lambda rows: blocks.append(spark.sparkContext.broadcast(Items(rows, min_words)))
    for item, body in tests.toLocalIterator():
        words = words_of(body)
        if len(words) >= min_words:
            block.append((item, words))
            have += len(words)
            if have >= BLOCK_WORDS:
                send(block)
                block, have = [], 0
    if block:
        send(block)
    found = rows.mapInArrow(_search(blocks, min_words), _FOUND) if blocks else spark.createDataFrame([], _FOUND)
    best = F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))
    top = found.groupBy("doc_id", "item_id").agg(F.max(best).alias("m"))
    return top.select("doc_id", "item_id", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"), F.col("m.words").alias("words"))

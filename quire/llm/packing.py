"""Laying texts into containers of fixed capacity by lexical retrieval: related texts share a container, little stays empty.

Texts over the capacity are cut into full pieces, which are containers of their own, and a rest. Texts and rests are dealt
to shards of bounded size. Within a shard an inverted index with BM25 weights is built. The largest unused text seeds a
container; its unused neighbours are taken in order of their score while they fit; the last gap is closed by best fit.
Seeds in falling size keep small texts for the gaps, so that containers end up nearly full.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, list_array, offsets_of

CAPACITY = 8192
#: Texts a shard holds on average; a shard is one task's work, so this bounds memory, and a shard wastes half a container.
SHARD_TEXTS = 2000
#: Neighbours are taken by score until less than this share of the container is free; then the fit decides.
GAP = 0.25
K1, B = 1.2, 0.75

_PIECES = "shard int, doc_id long, own long, piece int, start long, tokens int, whole boolean, terms array<int>, counts array<int>"
_PACKED = "container string, doc_id long, piece int, start long, tokens int"


class Bytes:
    """The byte-level tokenizer: a token is a byte of UTF-8."""

    def cuts(self, text: str, capacity: int) -> list[tuple[int, int, int]]:
        """Pieces of at most ``capacity`` tokens as (first character, end, tokens), never inside a character."""
        if len(text) * 4 <= capacity:
            return [(0, len(text), len(text.encode()))]
        raw = text.encode()
        if len(raw) <= capacity:
            return [(0, len(text), len(raw))]
        return _at_characters(raw, capacity, None)


class Ranks:
    """A byte-pair tokenizer given by a file of ranks (token in base64, rank), the path being a parameter."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def cuts(self, text: str, capacity: int) -> list[tuple[int, int, int]]:
        """As above; a piece that would end inside a character ends before it."""
        tokens = self.encoding.encode_ordinary(text)
        if len(tokens) <= capacity:
            return [(0, len(text), len(tokens))]
        ends = np.cumsum([len(self.encoding.decode_single_token_bytes(t)) for t in tokens])
        return _at_characters(text.encode(), capacity, ends)


def _at_characters(raw: bytes, capacity: int, ends: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Cut UTF-8 so that each piece has at most ``capacity`` tokens; ``ends`` are the tokens' ends in bytes (None: each byte)."""
    out, at, chars = [], 0, 0
    while at < len(raw):
        if ends is None:
            stop = min(at + capacity, len(raw))
        else:
            stop = int(ends[min(int(np.searchsorted(ends, at, "right")) + capacity - 1, len(ends) - 1)])
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        if stop <= at:
            raise ValueError("the capacity is below the tokens of one character")
        n = len(raw[at:stop].decode())
        tokens = stop - at if ends is None else int(np.searchsorted(ends, stop, "left") - np.searchsorted(ends, at, "right")) + 1
        out.append((chars, chars + n, tokens))
        at, chars = stop, chars + n
    return out


def _pieces(capacity: int, shards: int, tokenizer):
    """mapInArrow: (doc_id, text) -> its pieces with the terms of those that are to be packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            sizes, terms, counts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cuts, own = tokenizer.cuts(text, capacity), xxhash.xxh3_64_intdigest(text) - (1 << 63)
                for k, (a, b, tokens) in enumerate(cuts):
                    whole = k < len(cuts) - 1
                    bag = Counter() if whole else Counter(known[w] & 0x7FFFFFFF for w in text[a:b].lower().split())
                    sizes.append(len(bag))
                    terms += bag.keys()
                    counts += bag.values()
                    for col, v in zip(out, ((known[str(doc)] >> 8) % shards, doc, own, k, a, tokens, whole), strict=True):
                        col.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            off = offsets_of(sizes)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(out, types, strict=True)), list_array(off, np.array(terms, dtype=np.int32)), list_array(off, np.array(counts, dtype=np.int32))],
                ["shard", "doc_id", "own", "piece", "start", "tokens", "whole", "terms", "counts"],
            )

    return run


class Index:
    """A BM25 inverted index over the texts of a shard."""

    def __init__(self, off: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        n = len(off) - 1
        doc = np.repeat(np.arange(n), np.diff(off))
        self.n, self.off = n, off
        uniq, self.term = np.unique(terms, return_inverse=True)
        df = np.bincount(self.term, minlength=len(uniq))
        length = np.bincount(doc, weights=counts, minlength=n)
        mean = length.mean() or 1.0
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[self.term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[doc] / mean))
        order = np.argsort(self.term, kind="stable")
        self.doc, self.weight, self.at = doc[order], weight[order], offsets_of(df)
        #: Words of more than half of the texts say nothing about relatedness and have most of the postings.
        self.useful = df * 2 <= n

    def scores(self, i: int) -> np.ndarray:
        """The score of every text for text ``i`` as the query."""
        q = self.term[self.off[i] : self.off[i + 1]]
        parts = [slice(self.at[t], self.at[t + 1]) for t in q[self.useful[q]]]
        if not parts:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[p] for p in parts]), weights=np.concatenate([self.weight[p] for p in parts]), minlength=self.n)


def pack(sizes: np.ndarray, index: Index, capacity: int, gap: float = GAP) -> list[list[int]]:
    """The containers of a shard as lists of texts. Ties in size and score go to the earlier text."""
    order = np.lexsort((np.arange(len(sizes)), sizes))
    free = [int(sizes[i]) for i in order]  # the unused texts by size, for seeds and best fit
    who = [int(i) for i in order]
    unused = np.ones(len(sizes), dtype=bool)

    def take(i: int) -> None:
        unused[i] = False
        p = bisect_right(free, int(sizes[i])) - 1
        while who[p] != i:
            p -= 1
        del free[p], who[p]

    out = []
    while who:
        seed = who[-1]
        take(seed)
        box, room = [seed], capacity - int(sizes[seed])
        if who and room > gap * capacity and free[0] <= room:
            score = index.scores(seed)
            near = np.flatnonzero((score > 0) & unused & (sizes <= room))
            for i in near[np.argsort(-score[near], kind="stable")]:
                s = int(sizes[i])
                if s <= room:
                    take(int(i))
                    box.append(int(i))
                    room -= s
                    if room <= gap * capacity:
                        break
        while who and free[0] <= room:
            i = who[bisect_right(free, room) - 1]
            take(i)
            box.append(i)
            room -= int(sizes[i])
        out.append(box)
    return out


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, own, piece = (table[c].to_numpy() for c in ("doc_id", "own", "piece"))
        order = np.lexsort((piece, own, doc))
        of = np.searchsorted(doc[order], doc[order])  # where a key begins: of several texts of a key one counts, whole
        new = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(piece[order]) != 0))  # repeated rows once
        table = table.take(pa.array(order[new & (own[order] == own[order][of])])).combine_chunks()
        doc, piece, whole = table["doc_id"].to_numpy(), table["piece"].to_numpy(), table["whole"].to_numpy(zero_copy_only=False)
        names = np.array([f"d{d}.{p}" for d, p in zip(doc, piece, strict=True)], dtype=object)
        rest = np.flatnonzero(~whole)
        if len(rest):
            lists, counts = table["terms"].take(pa.array(rest)).combine_chunks(), table["counts"].take(pa.array(rest)).combine_chunks()
            off = offsets_of(lists.value_lengths().to_numpy())
            index = Index(off, lists.flatten().to_numpy(), counts.flatten().to_numpy())
            shard = table["shard"][0].as_py()
            for n, box in enumerate(pack(table["tokens"].to_numpy()[rest], index, capacity)):
                names[rest[box]] = f"s{shard}.{n}"
        return pa.table({"container": pa.array(names, pa.string()), "doc_id": table["doc_id"], "piece": table["piece"], "start": table["start"], "tokens": table["tokens"]})

    return run


def packed(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer=None, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """Every text in containers: (container, doc_id, piece, start, tokens); ``start`` is the piece's first character.

    A text within the capacity is one piece; a longer one is cut into full pieces and a rest. Null keys and texts are
    left out; an empty text is a piece of no tokens; rows that repeat a key are one text (of different ones the one with the
    least hash). An empty table gives no row. Other columns are not looked at. Shards are dealt by hash of the key, so no
    source or text can overfill one; the pieces of a text share a shard.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    shards = max(1, -(-df.count() // shard_texts))  # counted by the file footers, no text is read
    return rows.mapInArrow(_pieces(capacity, shards, tokenizer or Bytes()), _PIECES).groupBy("shard").applyInArrow(_pack_shard(capacity), _PACKED)

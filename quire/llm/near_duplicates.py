"""Near-duplicate records: MinHash bands propose, odd sketches sift, an exact count of words decides.

A text is a bag of words. The bag becomes a set by numbering the occurrences of a word, so the Jaccard similarity of two
sets is the number of common words divided by the number of words in either, repetitions counted. MinHash samples of the
set are cut into bands; texts that agree in one whole band are candidates. The same samples are folded into a bitmap in
which each sample flips one bit (an odd sketch): the XOR of two bitmaps has as many odd cells as the samples differ in,
from which a similarity is estimated precisely where it is high, with eight 64-bit words a text. Candidates whose estimate
is far below the threshold are dropped; the rest are decided by counting.

Copies (texts with equal bags) are one class and go through all this once, as one representative. No bucket is collected:
candidates come from an equi-join of band rows, which adaptive execution splits where one key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, as_long, bare_words, list_array, mix64, offsets_of
from quire.session import cut

BANDS, ROWS = 40, 5  # a pair at similarity 0.8 misses every band with a chance of (1 - 0.8**5)**40 = 1.3e-7
SKETCH_BITS = 512
#: Candidates whose estimate is this far below the threshold go; from 200 samples and 512 cells, one at 0.8 does with a
#: chance of 4e-10 (256 cells: 1.2e-6, ten times what the bands miss).
SLACK = 0.25
MIN_WORDS = 12
THRESHOLD = (4, 5)  # numerator and denominator of 0.8, so that the decision is exact

_WORDS = [f"s{w}" for w in range(SKETCH_BITS // 64)]
_BAG = "part string, key long, sig_a long, sig_b long, els array<long>"


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bags(min_words: int):
    """mapInArrow: (part, key, text) -> the bag of each text of at least ``min_words`` words, with a 128-bit signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            part, keep, lengths, flat = batch.column(0), [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = bare_words(text) if text is not None else []
                if len(words) >= min_words:
                    keep.append(i)
                    lengths.append(len(words))
                    flat += [known[w] for w in words]
            if not keep:
                continue
            off = offsets_of(lengths)
            h, row = np.array(flat, dtype=np.uint64), np.repeat(np.arange(len(keep)), lengths)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            starts = np.flatnonzero(new)
            nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
            els = mix64(h + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = off[:-1]
            pick = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [part.take(pick), batch.column(1).take(pick), pa.array(as_long(np.add.reduceat(els, at))), pa.array(as_long(np.bitwise_xor.reduceat(mix64(els + np.uint64(1)), at))), list_array(off, as_long(els))],
                ["part", "key", "sig_a", "sig_b", "els"],
            )

    return run


def minhash(els: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) MinHash samples of sets that lie one after the other."""
    out = np.empty((len(starts), n), dtype=np.uint64)
    for i, a in enumerate(_multipliers(n)):
        v = els * a
        v ^= v >> np.uint64(29)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(texts, bits / 64) parity bitmaps: sample i with value v flips the cell hash(i, v)."""
    n, k = samples.shape
    cell = (mix64(samples + np.arange(k, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)).astype(np.int64)
    flips = np.zeros((n, bits), dtype=np.uint8)
    rows = np.arange(n)
    for i in range(k):
        flips[rows, cell[:, i]] ^= 1
    return np.packbits(flips, axis=1, bitorder="little").view("<u8")


def estimate(odd_cells: Column, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> Column:
    """The similarity that this many odd cells in the XOR of two sketches speak for (low where the sketch is saturated)."""
    share = F.lit(1.0) - F.lit(2.0 / bits) * odd_cells
    return F.when(share > 0, 1 + F.lit(bits / (4.0 * samples)) * F.log(share)).otherwise(F.lit(-1.0))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, rep, els, sig_a) -> the band keys and the sketch of each text, without its elements."""
    words = SKETCH_BITS // 64
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):  # bounds the arrays in memory, whatever the batch size
            b = batch.slice(lo, 2000)
            lists = b.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            els = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64)
            s = minhash(els, off[:-1] - off[0], BANDS * ROWS)
            salt = np.array([np.uint64(hash_part(p)) for p in b.column(0).to_pylist()], dtype=np.uint64)
            keys = np.empty((len(s), BANDS), dtype=np.uint64)
            for j in range(BANDS):
                h = salt + np.uint64(j + 1)
                for i in range(ROWS):
                    h = mix64(h ^ s[:, j * ROWS + i])
                keys[:, j] = h
            sk = odd_sketch(s)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), list_array(np.arange(len(s) + 1) * BANDS, as_long(keys.ravel())), pa.array(np.diff(off).astype(np.int32)), *(pa.array(as_long(np.ascontiguousarray(sk[:, w]))) for w in range(words))],
                ["part", "rep", "sig_a", "bands", "n", *(f"s{w}" for w in range(words))],
            )


def hash_part(part: str | None) -> int:
    """A salt for the band keys, so that texts of different parts never meet."""
    import xxhash

    return xxhash.xxh64_intdigest(part or "")


class NearDuplicates:
    """The near-duplicate relation of ``df``: ``members`` (part, rep, key) and ``links`` (part, rep_a, rep_b).

    ``rep`` is the smallest key of a class of texts with equal bags; ``links`` are pairs of representatives, smaller key
    first, whose similarity is at least the threshold. Texts never meet across values of ``part``.

    Null texts and texts under ``min_words`` words (empty ones too) belong to no class. Null keys are left out. Rows that
    repeat a key and text count once; a key with several texts is a member of several classes. A null part counts
    as the empty one. Other columns of ``df`` are not looked at. An empty table gives two empty results.
    """

    def __init__(self, df: DataFrame, key: str, text: str, part: Column | None = None, min_words: int = MIN_WORDS):
        rows = df.select(F.coalesce(part if part is not None else F.lit(""), F.lit("")).cast("string").alias("part"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        rows = rows.where(F.col("key").isNotNull() & F.col("text").isNotNull())
        self.found = cut(rows.mapInArrow(bags(min_words), _BAG))
        ids = ["part", "sig_a", "sig_b"]
        classes = self.found.groupBy(*ids).agg(F.min("key").alias("rep"), F.first("els").alias("els"))
        self.sketched = cut(classes.select("part", "rep", "els", "sig_a").mapInArrow(_sketches, "part string, rep long, sig_a long, bands array<long>, n int, " + ", ".join(f"{w} long" for w in _WORDS)))
        reps = self.found.groupBy(*ids).agg(F.min("key").alias("rep"))
        self.members = self.found.select(*ids, "key").distinct().join(reps, ids).select("part", "rep", "sig_a", "key")
        self.links = cut(self._links())

    def candidates(self) -> DataFrame:
        """Pairs of classes that agree in a band and whose lengths don't rule the threshold out."""
        band = self.sketched.select(F.explode("bands").alias("band"), "part", "rep", "sig_a", "n")
        a, b = (band.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("part", "rep", "sig_a", "n"))) for x in "ab")
        num, den = THRESHOLD
        near = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
        first = (F.col("rep_a") < F.col("rep_b")) | ((F.col("rep_a") == F.col("rep_b")) & (F.col("sig_a_a") < F.col("sig_a_b")))
        pairs = a.join(b, "band").where(first & (F.col("part_a") == F.col("part_b")) & near)
        return pairs.select(F.col("part_a").alias("part"), "rep_a", "sig_a_a", "rep_b", "sig_a_b").distinct()

    def _links(self) -> DataFrame:
        num, den = THRESHOLD
        pairs = self.candidates()
        for x in "ab":  # the sketches first: 64 bytes a side decide on most candidates
            on = ["part", f"rep_{x}", f"sig_a_{x}"]
            pairs = pairs.join(self.sketched.select("part", F.col("rep").alias(on[1]), F.col("sig_a").alias(on[2]), *(F.col(w).alias(f"{w}_{x}") for w in _WORDS)), on)
        odd = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS), F.lit(0))
        pairs = cut(pairs.where(estimate(odd) >= num / den - SLACK).select("part", "rep_a", "sig_a_a", "rep_b", "sig_a_b"))
        ends = pairs.select("part", F.col("rep_a").alias("key"), F.col("sig_a_a").alias("sig_a")).unionByName(pairs.select("part", F.col("rep_b").alias("key"), F.col("sig_a_b").alias("sig_a"))).distinct()
        wanted = self.found.select("part", "key", "sig_a", "els").join(ends, ["part", "key", "sig_a"], "left_semi").dropDuplicates(["part", "key", "sig_a"])
        for x in "ab":
            on = ["part", f"rep_{x}", f"sig_a_{x}"]
            pairs = pairs.join(wanted.select("part", F.col("key").alias(on[1]), F.col("sig_a").alias(on[2]), F.col("els").alias(f"els_{x}")), on)
        common, total = F.size(F.array_intersect("els_a", "els_b")), F.size("els_a") + F.size("els_b")
        return pairs.where(common * den >= (total - common) * num).select("part", "rep_a", "sig_a_a", "rep_b", "sig_a_b")

    def pairs(self) -> DataFrame:
        """Every pair of different keys whose texts are alike, copies expanded: (part, id_a, id_b), smaller key first."""
        many = self.members.groupBy("part", "rep", "sig_a").agg(F.count("*").alias("n")).where("n > 1")
        copies = many.select("part", F.col("rep").alias("rep_a"), F.col("sig_a").alias("sig_a_a"), F.col("rep").alias("rep_b"), F.col("sig_a").alias("sig_a_b"))
        out = self.links.unionByName(copies)
        for x in "ab":
            on = ["part", f"rep_{x}", f"sig_a_{x}"]
            out = out.join(self.members.select("part", F.col("rep").alias(on[1]), F.col("sig_a").alias(on[2]), F.col("key").alias(f"key_{x}")), on)
        same = (F.col("rep_a") == F.col("rep_b")) & (F.col("sig_a_a") == F.col("sig_a_b"))
        out = out.where(~same | (F.col("key_a") < F.col("key_b")))
        return out.select("part", F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b")).where("id_a <> id_b").distinct()

    def linked(self) -> DataFrame:
        """One row per record of a class: (part, key, rep, links): the representative's key, and the number of records
        (copies included) that the record is alike to."""
        at = ["part", "rep", "sig_a"]
        n = self.members.groupBy(*at).agg(F.count("*").alias("n"))
        other = self.links.toDF("part", "rep", "sig_a", "rep_o", "sig_o")
        ends = other.unionByName(other.toDF("part", "rep_o", "sig_o", "rep", "sig_a"))
        far = ends.join(n.toDF("part", "rep_o", "sig_o", "n"), ["part", "rep_o", "sig_o"]).groupBy(*at).agg(F.sum("n").alias("far"))
        per = n.join(far, at, "left").select(*at, (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
        return self.members.join(per, at).select("part", "key", "rep", "links")

    def groups(self) -> DataFrame:
        """One row per record that is alike to another: (part, key, group_id), the smallest key that links lead to."""
        edges = self.links.select("part", F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        label = connected(edges, "part", "a", "b")
        many = self.members.join(label.select("part", F.col("node").alias("rep"), "root"), ["part", "rep"], "left").select("part", "key", F.coalesce("root", "rep").alias("group_id"))
        size = many.groupBy("part", "group_id").agg(F.count_distinct("key").alias("n")).where("n > 1").select("part", "group_id")
        return many.join(size, ["part", "group_id"]).select("part", "key", "group_id").distinct()


def connected(edges: DataFrame, part: str, a: str, b: str) -> DataFrame:
    """Connected components as (part, node, root), root the smallest node, by large-star and small-star rounds.

    Each round is two aggregations over the edges, written to the checkpoint folder; a node with many edges is an
    aggregation key with partial sums, never a collected list. Rounds grow with the logarithm of a component's length.
    """
    e = edges.select(F.col(part).alias("part"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = e.unionByName(e.select("part", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("part", "u").agg(F.min("v").alias("m")).select("part", "u", F.least("u", "m").alias("m"))
        large = both.join(low, ["part", "u"]).where("v > u").select("part", F.col("m").alias("u"), "v").where("u <> v").distinct()
        least = large.groupBy("part", "v").agg(F.min("u").alias("m"))
        joined = large.join(least, ["part", "v"])
        small = joined.select("part", F.col("m").alias("u"), "v").unionByName(joined.where("u <> m").select("part", F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.hash("part", "u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    return e.select("part", F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select("part", F.col("u").alias("node"), F.col("u").alias("root"))).distinct()

"""Long verbatim spans shared between records: Rabin-Karp hashes of every window, counted, and merged into intervals.

A window is ``width`` consecutive characters. A span of at least ``width`` characters stands in two records exactly if each
of its windows does, so it is enough to know for every window whether its hash occurs under another id.

Counting all windows of all texts would shuffle more than the texts. Therefore every window is first named by the least
hash among the half-width windows in it (its minimizer), which depends on its characters alone: windows whose minimizer
stands under a single id can't be repeated and are counted no further, at no loss. Neighbouring windows mostly share
their minimizer and travel as one run. The windows of the remaining runs are hashed at full width and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_long, mix64
from quire.session import cut

WIDTH = 60
#: Texts are hashed in pieces of about so many characters, which bounds a worker's memory for texts of any length.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        x = np.full(max(n, CHUNK * 2), base, dtype=np.uint64)
        x[0] = 1
        known = _powers[base] = np.multiply.accumulate(x)
    return known[:n]


def rolling(points: np.ndarray, width: int) -> np.ndarray:
    """The Rabin-Karp hash of every window of ``width`` code points, scrambled so that any of its bits can be used.

    The polynomial is taken modulo 2**64 over scrambled code points; prefix sums and the inverse of the (odd) base roll
    it over all windows at once.
    """
    n = len(points)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(0x51ED27)) * _powers_of(_BASE, n), out=total[1:])
    return mix64((total[width:] - total[:-width]) * _powers_of(pow(_BASE, -1, 1 << 64), n)[: n - width + 1])


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = span - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _pieces(rows: Iterator[tuple[int, str]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side in chunks: (row, offset in its text, first place in the chunk, code points of the chunk).

    A text longer than a chunk comes in pieces that overlap by ``width`` - 1, so that each window lies in one piece.
    """
    who, offset, place, parts, have = [], [], [], [], 0
    for row, text in rows:
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        for lo in range(0, max(1, len(points) - width + 1), CHUNK):
            part = points[lo : lo + CHUNK + width - 1]
            who.append(row)
            offset.append(lo)
            place.append(have)
            parts.append(part)
            have += len(part)
            if have >= CHUNK:
                yield np.array(who), np.array(offset), np.array(place), np.concatenate(parts)
                who, offset, place, parts, have = [], [], [], [], 0
    if parts:
        yield np.array(who), np.array(offset), np.array(place), np.concatenate(parts)


def _runs(width: int):
    """mapInArrow: (id, text) -> runs of windows with one minimizer: (fp, id, start, n)."""
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for who, offset, place, points in _pieces(enumerate(batch.column(1).to_pylist()), width):
                if len(points) < width:
                    continue
                least = sliding_min(rolling(points, half), width - half + 1)  # one a window of the chunk
                size = np.diff(np.append(place, len(points)))
                piece = np.repeat(np.arange(len(place)), size)[: len(least)]
                at = np.arange(len(least)) - place[piece]
                valid = at + width <= size[piece]
                new = valid.copy()
                new[1:] &= (at[1:] == 0) | (least[1:] != least[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                run_no = np.cumsum(new)[valid] - 1
                n = np.bincount(run_no, minlength=len(first))
                p = piece[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(least[first])), pa.array(ids[who[p]]), pa.array((offset[p] + at[first]).astype(np.int32)), pa.array(n.astype(np.int32))], ["fp", "id", "start", "n"]
                )

    return run


def _hashes(width: int):
    """mapInArrow: (id, text, runs) -> the full-width hash of each window of the runs: (hash, id, pos, chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), batch.column(1).to_pylist()
            for who, offset, place, points in _pieces(enumerate(texts), width):
                h = rolling(points, width)
                size = np.diff(np.append(place, len(points)))
                for k in range(len(who)):
                    lo, count = int(offset[k]), int(size[k]) - width + 1
                    want = np.zeros(max(0, count), dtype=bool)
                    for r in runs[int(who[k])].as_py():
                        want[max(0, r["start"] - lo) : max(0, r["start"] - lo + r["n"])] = True
                    pos = np.flatnonzero(want)
                    if len(pos):
                        m = len(pos)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(as_long(h[place[k] + pos])), pa.array(np.full(m, ids[who[k]])), pa.array((lo + pos).astype(np.int32)), pa.array(np.full(m, len(texts[int(who[k])]), dtype=np.int32))],
                            ["hash", "id", "pos", "chars"],
                        )

    return run


def _packed(run):
    """Small record batches of a mapInArrow function gathered to larger ones."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gather


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """The values of ``name`` that stand under more than one id. Partial aggregation keeps two ids a value and task, so a
    value that fills a third of all rows is no load; the result is written, so that the join back to the rows starts
    from plain exchanges and adaptive execution can split a hot value there."""
    return cut(rows.groupBy(name).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select(name))


def shared_windows(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, starts): for each text (id, text, alone) that is ``alone``, the places of its windows that also stand under another id,
    if there are any. A text's places are bounded by its length."""
    runs = cut(texts.mapInArrow(_packed(_runs(width)), "fp long, id long, start int, n int"))
    kept = runs.join(_repeated(runs, "fp"), "fp", "left_semi").select("id", "start", "n").distinct()
    per = kept.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    rows = cut(texts.join(per, "id").select("id", "text", "runs").mapInArrow(_packed(_hashes(width)), "hash long, id long, pos int, chars int"))
    hits = rows.select("hash", "id", "pos").join(_repeated(rows, "hash"), "hash", "left_semi").join(texts.where("alone").select("id"), "id", "left_semi")
    return hits.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def _intervals(starts: str, width: int) -> Column:
    """Windows that overlap or touch merged to maximal intervals."""
    p = F.col(starts)
    begin = F.filter(p, lambda x, i: F.coalesce(x - F.get(p, i - 1) > width, F.lit(True)))
    end = F.transform(F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) - x > width, F.lit(True))), lambda x: x + width)
    return F.zip_with(begin, end, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def shared_spans(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """For each text that shares a span of at least ``width`` characters with a text of another id, its maximal shared
    intervals and their extent: (id, chars, spans array<struct<start, end>>, covered).

    Null keys and texts, and texts shorter than ``width``, share nothing. Rows that repeat a key count once, as they have
    the same text; copies under one key are no other record. Copies under other keys are shared from end to end. Other
    columns are not looked at. An empty table gives an empty result. Windows are compared by 64-bit hashes, whole texts by
    128 bits.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= width))
    rows = rows.select("id", "text", F.xxhash64("text").alias("low"), F.xxhash64(F.lit("high"), "text").alias("high"))
    members = cut(rows.select("low", "high", "id", F.length("text").alias("chars")).distinct())
    classes = cut(members.groupBy("low", "high", "chars").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    one = classes.select("low", "high", F.col("rep").alias("id"), (F.col("rep") == F.col("last")).alias("alone"))
    texts = cut(rows.join(one, ["low", "high", "id"]).select("id", "text", "alone").dropDuplicates(["id", "alone"]))
    found = shared_windows(texts, width).select(F.col("id").alias("rep"), _intervals("starts", width).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("chars").alias("end")))
    per = classes.join(found, "rep", "left").withColumn("spans", F.when(F.col("rep") < F.col("last"), whole).otherwise(F.col("spans"))).where("spans IS NOT NULL")
    out = members.select("low", "high", "id").join(per.select("low", "high", "chars", "spans"), ["low", "high"]).select("id", "chars", "spans")
    return out.withColumn("covered", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]))

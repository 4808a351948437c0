"""Fingerprints: 64-bit FNV-1a where stored values must agree, CRC-32 for row checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.functions.text import dedup_text

# Offset basis and prime of FNV-1a with 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_MASK = (1 << 64) - 1


def fnv1a64(data: bytes) -> int:
    """FNV-1a as a signed 64-bit integer; never 0, which means "no fingerprint"."""
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & _MASK
    h = h or 1
    return h - (1 << 64) if h >> 63 else h


def _fnv_many(texts: Sequence[str]) -> np.ndarray:
    """FNV-1a of many strings side by side: byte i of all of them in one step."""
    raw = [t.encode() for t in texts]
    order = np.argsort([-len(r) for r in raw], kind="stable")
    lengths = np.array([len(raw[i]) for i in order])
    flat = np.frombuffer(b"".join(raw[i] for i in order), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    h = np.full(len(raw), FNV_BASIS, dtype=np.uint64)
    live = len(raw)
    for i in range(int(lengths[0]) if len(raw) else 0):
        while live and lengths[live - 1] <= i:
            live -= 1
        h[:live] = (h[:live] ^ flat[starts[:live] + i]) * np.uint64(FNV_PRIME)
    h[h == 0] = 1
    out = np.empty(len(raw), dtype=np.uint64)
    out[order] = h
    return out.view(np.int64)


@F.pandas_udf(LongType())
def fnv1a(s: pd.Series) -> pd.Series:
    """FNV-1a 64 of a string column; null is 0, "no fingerprint"."""
    return pd.Series(_fnv_many(s.fillna("").tolist())).where(s.notna().to_numpy(), 0)


def text_hash(text: Column) -> Column:
    """Fingerprint of a book's text."""
    return fnv1a(text)


def metadata_hash(title: Column, topics: Column, facets: Column) -> Column:
    """Fingerprint of a book's metadata; the order and repetition of facets don't matter."""
    return fnv1a(F.concat_ws("\x1f", F.coalesce(title, F.lit("")), F.coalesce(topics, F.lit("")), F.array_sort(F.array_distinct(F.coalesce(facets, F.array().cast("array<string>"))))))


def content_hash(text: Column, title: Column, topics: Column, facets: Column) -> Column:
    """Fingerprint of a book's text together with its metadata."""
    return fnv1a(F.concat_ws("\x1e", text, F.coalesce(title, F.lit("")), F.coalesce(topics, F.lit("")), F.concat_ws("\x1f", F.array_sort(F.array_distinct(F.coalesce(facets, F.array().cast("array<string>")))))))


def line_hash(plain: Column) -> Column:
    """Signature of a line for merging identical texts; 0 for lines too short to have one."""
    return fnv1a(dedup_text(plain))


def line_check(row: Column) -> Column:
    """CRC-32 of the exact row text."""
    return F.crc32(F.encode(row, "UTF-8"))

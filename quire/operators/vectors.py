"""Vector search over embeddings, and its fusion with a lexical ranking.

A scan computes the cosine of every vector with the query inside the JVM and keeps a top-k per task. There is no index to
go stale, and a filter on books is an ordinary predicate before the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K, THRESHOLD, MAX_LINES_PER_HIT = 60, 0.55, 32
FOUNDATIONAL_BONUS, FOUNDATIONAL_SHARE = 0.002, 0.5
RRF, WEIGHTED, ADAPTIVE = "rrf", "weighted", "adaptive"
HYBRID, SEMANTIC_ONLY, LEXICAL_ONLY = "hybrid", "semanticOnly", "lexicalOnly"


class SearchError(ValueError):
    """A typed failure; ``kind`` says which."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Ranking:
    """How two rankings become one; ranges are checked."""

    fusion: str = RRF
    k: int = RRF_K
    alpha: float | None = None
    threshold: float = THRESHOLD
    foundational_bonus: float = 0.0

    def __post_init__(self) -> None:
        if self.fusion not in (RRF, WEIGHTED, ADAPTIVE):
            raise SearchError("invalidRanking", f"unknown fusion {self.fusion!r}")
        if self.k < 1 or not 0 <= self.threshold <= 1 or (self.alpha is not None and not 0 <= self.alpha <= 1) or not 0 <= self.foundational_bonus <= 1:
            raise SearchError("invalidRanking", "a ranking value is out of its range")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column with a query vector; null for null, zero and wrongly sized vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    length = F.sqrt(dot(v, v))
    return F.when((F.size(v) == len(query)) & (length > 0), dot(v, q) / (length * F.lit(norm or 1.0)))


def knn(vectors: DataFrame, query: Sequence[float], k: int, key: str = "key", vector: str = "embedding", threshold: float = 0.0) -> DataFrame:
    """(key, similarity): the k nearest vectors, similarity (cos + 1) / 2, at least ``threshold``; ties by key."""
    if k < 1:
        raise SearchError("invalidLimit", "k is at least 1")
    rows = vectors.select(key, ((cosine(F.col(vector), query) + 1) / 2).alias("similarity")).where(F.col("similarity") >= threshold)
    return rows.orderBy(F.col("similarity").desc(), F.col(key)).limit(k)


def _nearest_of_batches(ids: np.ndarray, queries: np.ndarray, k: int):
    """mapInArrow: (key, vector) -> (query, key, similarity), the k nearest of each batch to each query."""
    norms = np.sqrt((queries**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and v is not None and len(v) == queries.shape[1] and None not in v]
            if not rows:
                continue
            keys, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
            length = np.sqrt((x**2).sum(axis=1))
            keys, x, length = keys[length > 0], x[length > 0], length[length > 0]
            near = np.round(((x @ queries.T) / (length[:, None] * norms) + 1) / 2, 12)
            for j, q in enumerate(ids):
                top = np.lexsort((keys, -near[:, j]))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([int(q)] * len(top), pa.int64()), pa.array(keys[top], pa.int64()), pa.array(near[top, j])], ["query", "key", "similarity"])

    return run


def knn_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "key", vector: str = "embedding", block: int = 256) -> DataFrame:
    """(query, key, similarity, rank): the k nearest vectors of every row of ``queries``, whose keys are whole numbers.

    Similarities (cos + 1) / 2 are compared at 12 digits, ties by key; a query in ``vectors`` is its own neighbour. Queries
    go out in blocks of ``block``, the only vectors that the driver reads at a time. Null keys, null and zero vectors and
    those of another length have no similarity; of queries that repeat a key one is taken.
    """
    if k < 1:
        raise SearchError("invalidLimit", "k is at least 1")
    asked = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL").dropDuplicates(["key"]).orderBy("key")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    out, last = None, None
    while found := (asked if last is None else asked.where(F.col("key") > last)).limit(block).collect():
        last = found[-1].key
        for n in sorted({len(r.v) for r in found}):
            same = [r for r in found if len(r.v) == n and None not in r.v and any(r.v)]
            if same:
                part = rows.mapInArrow(_nearest_of_batches(np.array([r.key for r in same]), np.array([r.v for r in same]), k), "query long, key long, similarity double")
                out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query long, key long, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("similarity").desc(), "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.col("key").alias(key), "similarity", "rank")


def resolve(nearest: DataFrame, lines: DataFrame, per_hit: int = MAX_LINES_PER_HIT) -> DataFrame:
    """Lines of the nearest keys: each key's best ``per_hit`` lines, one of each book before a second of any."""
    joined = lines.join(nearest, "key").withColumn("turn", F.row_number().over(W.partitionBy("key", "file_path").orderBy("id")))
    ranked = joined.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("turn", "id"))).where(F.col("nth") <= per_hit)
    best = ranked.groupBy("id").agg(F.max("similarity").alias("similarity"))
    return lines.drop("key").dropDuplicates(["id"]).join(best, "id")


def alpha_for(query: str) -> float:
    """How much the lexical half weighs, by the kind of a query: quoted, a reference, short or long."""
    words = query.split()
    if len(query) > 1 and query.strip()[:1] == query.strip()[-1:] == '"':
        return 1.0
    if any(any(c.isdigit() for c in w) for w in words) or any(w in ("פרק", "סימן", "דף", "הלכה") for w in words):
        return 0.85
    return 0.7 if len(words) <= 2 else 0.5 if len(words) <= 4 else 0.3


def fuse(lexical: DataFrame, semantic: DataFrame, ranking: Ranking, query: str = "", foundational: DataFrame | None = None) -> DataFrame:
    """(id, score, source, lexical_rank, semantic_rank) of two ranked lists (id, score), each bounded by its limit.

    Reciprocal ranks, or a weighted sum of scores scaled to 0..1 with the given weight, or one chosen by the query. Lines
    of foundational books get the bonus. Ties by id. The lists are ranked globally, so they must be top-k lists.
    """

    def ranks(df: DataFrame, name: str) -> DataFrame:
        top = F.max("score").over(W.partitionBy())
        scaled = F.when(top > 0, F.col("score") / top).otherwise(0.0)
        return df.select("id", F.row_number().over(W.orderBy(F.col("score").desc(), "id")).alias(f"{name}_rank"), scaled.alias(f"{name}_score"))

    both = ranks(lexical, "lexical").join(ranks(semantic, "semantic"), "id", "full")
    if ranking.fusion == RRF:
        part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(ranking.k) + F.col(c)), F.lit(0.0))
        score = part("lexical_rank") + part("semantic_rank")
    else:
        a = ranking.alpha if ranking.fusion == WEIGHTED and ranking.alpha is not None else alpha_for(query)
        score = F.lit(a) * F.coalesce("lexical_score", F.lit(0.0)) + F.lit(1 - a) * F.coalesce("semantic_score", F.lit(0.0))
    out = both.withColumn("score", score)
    if foundational is not None and ranking.foundational_bonus:
        out = out.join(foundational.select("id").distinct().withColumn("_f", F.lit(ranking.foundational_bonus)), "id", "left").withColumn("score", F.col("score") + F.coalesce("_f", F.lit(0.0)))
    source = F.when(F.col("semantic_rank").isNull(), "lexical").when(F.col("lexical_rank").isNull(), "semantic").otherwise("both")
    return out.select("id", "score", source.alias("source"), "lexical_rank", "semantic_rank").orderBy(F.col("score").desc(), "id")


# -- vector sets ---------------------------------------------------------------------------------------------------------


def with_delta(base: DataFrame, delta: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """A vector set after a delta: its keys replace those of the base, tombstones remove them."""
    gone = delta.select("key") if tombstones is None else delta.select("key").unionByName(tombstones.select("key"))
    return base.join(gone.distinct(), "key", "left_anti").unionByName(delta.dropDuplicates(["key"]))


def info(vectors: DataFrame) -> DataFrame:
    """One row: number of vectors and keys, dimensions, rows with a broken vector, and a checksum that order doesn't change."""
    size = F.size("embedding")
    return vectors.agg(
        F.count("*").alias("vectors"), F.count_distinct("key").alias("keys"), F.min(size).alias("least_dim"), F.max(size).alias("most_dim"),
        F.sum(F.when(F.col("embedding").isNull() | (size == 0) | F.exists("embedding", lambda x: F.isnan(x) | x.isNull()), 1).otherwise(0)).alias("broken"),
        F.bit_xor(F.xxhash64("key", "embedding")).alias("checksum"),
    )


def coverage(lines: DataFrame, vectors: DataFrame) -> DataFrame:
    """(file_path, embeddable, covered): lines with a text key, and those whose key has a vector."""
    known = vectors.select("key").distinct().withColumn("_v", F.lit(1))
    return lines.where("key IS NOT NULL").join(known, "key", "left").groupBy("file_path").agg(F.count("*").alias("embeddable"), F.sum(F.coalesce("_v", F.lit(0))).alias("covered"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours (query, key) that a search found."""
    hit = exact.join(found.select("query", "key").distinct().withColumn("_h", F.lit(1)), ["query", "key"], "left")
    return hit.agg((F.sum(F.coalesce("_h", F.lit(0))) / F.count("*")).alias("recall"))

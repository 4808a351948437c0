import random

import pytest

from quire.operators.vectors import knn_all
from quire.plans.search import QUERIES


def test_knn_of_every_hundredth(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], i % 3) for i in range(350)] + [(350, None, 0), (351, [0.0] * 8, 0), (352, [1.0], 0)]
    rows[7] = (7, rows[100][1], 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    v = {x.vec_id: x.embedding for x in df.collect() if x.vec_id < 350}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for name, kept in (("knn_cosine_all", lambda i: True), ("filtered_knn_all", lambda i: i % 3 == 1)):
        got = {(x.query, x["rank"]): (x.vec_id, x.similarity) for x in QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(got) == 4 * 20
        for q in (0, 100, 200, 300):
            want = sorted((-round((cos(v[q], v[i]) + 1) / 2, 12), i) for i in v if kept(i))[:20]
            assert [got[q, n + 1][0] for n in range(20)] == [i for _, i in want]
            assert [got[q, n + 1][1] for n in range(20)] == pytest.approx([-s for s, _ in want], abs=1e-6)
    some = df.where("vec_id % 100 = 0")
    assert sorted(map(tuple, knn_all(df, some, 5, "vec_id", block=3).collect())) == sorted(map(tuple, knn_all(df, some, 5, "vec_id").collect()))
    assert knn_all(df, df.limit(0), 5, "vec_id").count() == 0

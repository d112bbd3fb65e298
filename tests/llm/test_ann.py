"""Nearest neighbours on larger tables."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from cragline.llm import ann


def test_recall_over_many_lists(spark, tmp_path, monkeypatch):
    n = 12_000
    x = np.random.default_rng(5).normal(size=(n, 64))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), f"{tmp_path}/e.parquet")
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    df = spark.read.parquet(f"{tmp_path}/e.parquet")
    assert len(ann.fit(df)["lists"].c) == 600
    got = ann.nearest(df).toPandas().groupby("query_id").vec_id.agg(set)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(got.get(q, set()) & set(np.argpartition(-s, 5)[:5]))
    assert hit >= 0.93 * 5 * (n // 50)


def test_isolated_rows_get_all_neighbours(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    n = 1500
    x = rng.normal(size=(12, 32))[rng.integers(0, 12, n)] + 0.02 * rng.normal(size=(n, 32))
    x[::50] = rng.normal(size=(n // 50, 32))  # alone, far from all groups
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[60].tolist())] * 20
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/e.parquet")
    monkeypatch.setattr(ann, "LIST_ROWS", 5)
    got = ann.nearest(spark.read.parquet(f"{tmp_path}/e.parquet")).toPandas()
    assert got.groupby("query_id").size().to_dict() == {q: 5 for q in range(0, n, 50)}
    few = spark.createDataFrame([(0, [1.0, 0.0]), *[(1, [1.0, 0.1])] * 20, (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]

"""The vector index against a comparison with all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from timberline.operators import vectors

SCHEMA = "vec_id bigint, embedding array<float>, row int, list int, part int"


def rows_of(spark, vectors_, ids=None):
    ids = range(len(vectors_)) if ids is None else ids
    data = [(i, None if v is None else [float(x) if x is not None else None for x in v], 1, 2, 3) for i, v in zip(ids, vectors_, strict=True)]
    return spark.createDataFrame(data, SCHEMA)


def brute(queries, rows, k):
    def unit(v):
        v = np.array([np.nan if x is None else x for x in np.array(v if v is not None else [], object)], np.float32).astype(float)
        return v / np.linalg.norm(v) if len(v) and np.isfinite(v).all() and np.linalg.norm(v) else None

    every = [(i, unit(v)) for i, v in rows]
    out = []
    for i, v in queries:
        own = unit(v)
        if own is None:
            continue
        near = [(round(float(own @ u), 6) + 0.0, j) for j, u in every if u is not None and (j != i or i is None)]
        near.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, n, j, s) for n, (s, j) in enumerate(near[:k], 1)]
    return out


def clustered(seed, n, width=8, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width))
    return (centres[rng.integers(0, groups, n)] + 0.3 * rng.standard_normal((n, width))).astype(np.float32)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"LIST_BLOCK": 40, "QUERY_BLOCK": 7, "_PRODUCT_ROWS": 5}.items():
        monkeypatch.setattr(vectors, name, value)


def test_exact_search(spark, small_blocks):
    data = clustered(1, 500)
    data[100:200] = data[3]  # one vector many times
    rows = rows_of(spark, data)
    index = vectors.build_index(rows, "vec_id", "embedding")
    assert index.rows.count() == 500 and len(index.centroids) == 22
    assert index.rows.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 100
    for probes in (1, 5):
        got = index.search(rows.where("vec_id % 20 = 0"), 6, "vec_id", "embedding", probes, exact=True)
        assert got.columns == ["id", "rank", "neighbour", "similarity"]
        want = brute([(i, data[i]) for i in range(0, 500, 20)], list(enumerate(data)), 6)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_measured_probes_find_most(spark):
    data = clustered(2, 3_000, width=24, groups=40)
    rows = rows_of(spark, data)
    index = vectors.build_index(rows, "vec_id", "embedding")
    queries = rows.where("vec_id % 20 = 0")
    probes = index.probes_for(10)
    assert probes < len(index.centroids) / 2
    exact = index.search(queries, 10, "vec_id", "embedding", exact=True)
    got = vectors.recall(index.search(queries, 10, "vec_id", "embedding"), exact).first()
    assert (got["queries"], got["wanted"]) == (150, 1500) and got["recall"] >= 0.9


def test_odd_rows(spark, small_blocks):
    data = [None, [], [0, 0], [1, 0], [1, 0], [0, 1], [-1, 0], [1, None], [float("nan"), 1], [2, 0], [1, 1]]
    ids = [0, 1, 2, 3, 3, 5, 6, 7, 8, None, 10]
    rows = rows_of(spark, data, ids)
    index = vectors.build_index(rows, "vec_id", "embedding")
    assert index.rows.count() == 6
    got = index.search(rows, 3, "vec_id", "embedding", exact=True).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(list(zip(ids, data, strict=True)), list(zip(ids, data, strict=True)), 3), key=key)


def test_empty_tables_and_errors(spark):
    rows = rows_of(spark, [])
    index = vectors.build_index(rows, "vec_id", "embedding")
    some = rows_of(spark, [[1, 2], [3, 4]])
    assert index.search(some, 3, "vec_id", "embedding", probes=1).collect() == []
    full = vectors.build_index(some, "vec_id", "embedding")
    assert full.search(rows, 3, "vec_id", "embedding").collect() == []
    assert [tuple(r)[:3] for r in full.search(some, 3, "vec_id", "embedding").orderBy("id").collect()] == [(0, 1, 1), (1, 1, 0)]
    with pytest.raises(ValueError, match="positive"):
        full.search(some, 0, "vec_id", "embedding")
    with pytest.raises(ValueError, match="no array"):
        vectors.build_index(some, "vec_id", "vec_id")
    with pytest.raises(Exception, match="different lengths"):
        vectors.build_index(rows_of(spark, [[1], [1, 2]]).coalesce(1), "vec_id", "embedding")

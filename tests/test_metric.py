import numpy as np
import pytest

from pairlens.operators import metric, retrieve

SCHEMA = "id long, venue string, v array<double>"


def rows_of(spark, vectors, venues, extra=()):
    return spark.createDataFrame([(i, v, [float(x) for x in m]) for i, (m, v) in enumerate(zip(vectors, venues))] + list(extra), SCHEMA).repartition(3)


def clustered(rng, n, clusters=40, width=16, spread=0.08):
    centres = rng.normal(size=(clusters, width))
    return centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, width))


def equal(spark, frame, **options):
    report = {}
    got = metric.similar(frame, "id", "venue", "v", report=report, **options).collect()
    options.pop("cells", None)
    want = retrieve.similar(frame, "id", "venue", "v", **options).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    return len(want), report["visited"]


def test_equal_to_the_grid_and_cells_are_skipped(spark):
    rng = np.random.default_rng(2)
    vectors = clustered(rng, 900)
    found, visited = equal(spark, rows_of(spark, vectors, rng.choice(["a", "b", "c"], 900)), k=5, least=0.3, cells=40)
    assert found == 4500 and visited < 0.5


def test_vectors_without_clusters_and_few_candidates(spark):
    rng = np.random.default_rng(3)
    frame = rows_of(spark, rng.normal(size=(300, 8)), rng.choice(["a", "b"], 300, p=[0.97, 0.03]))
    assert equal(spark, frame, k=20, least=-1.0, cells=12)[0] > 300
    assert equal(spark, frame, k=3, least=0.9, cells=12)[1] < 1.0


def test_ties_copies_nulls_and_lengths(spark):
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(5, 6)), 40, axis=0)
    extra = [(1000, "a", None), (1001, "b", [None, 1.0]), (1002, "b", [0.0] * 6), (1003, None, [1.0, 2.0]), (1004, "a", [1.0])]
    frame = rows_of(spark, vectors, rng.choice(["a", "b"], 200), extra)
    assert equal(spark, frame, k=7, least=0.3, cells=6)[0] > 1000


def test_empty_and_single(spark):
    frame = rows_of(spark, np.ones((1, 4)), ["a"])
    assert metric.similar(frame, "id", "venue", "v").collect() == [] and metric.similar(frame.limit(0), "id", "venue", "v").collect() == []


def test_a_cell_of_all_rows_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(metric, "PART_ROWS", 30)
    rng = np.random.default_rng(5)
    frame = rows_of(spark, clustered(rng, 200, clusters=1), rng.choice(["a", "b"], 200))
    assert equal(spark, frame, k=4, least=0.3, cells=4)[0] == 800


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = metric.centroids_of(x, 20)
    cosine = x @ centre.T
    cell = cosine.argmax(1)
    apart = metric._apart(cosine[np.arange(500), cell])
    radius = np.array([apart[cell == c].max(initial=0.0) for c in range(len(centre))]) + 1e-9
    bounds = metric.Index(centre, radius, np.bincount(cell, minlength=len(centre))).bounds(x)
    assert (x @ x.T <= bounds[:, cell] + 1e-12).all() and bounds.min() < 0.9
    with pytest.raises(ValueError, match="components"):
        metric._fitted(np.zeros((1, 5)), 4)

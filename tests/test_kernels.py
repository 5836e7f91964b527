"""Kernels against hand-computed values and brute force; no Spark."""
import itertools

import numpy as np
import pytest

from vicinal.functions.distance import gemm_sqeuclidean, pairwise
from vicinal.operators import geometry, partitioned, paths, transport, trees
from vicinal.operators.transforms import KMeans, RandomProjection


def test_distances():
    a, b = np.array([[3.0, 4.0], [0.0, 0.0]]), np.array([[0.0, 0.0]])
    assert pairwise(a, b)[:, 0].tolist() == [5.0, 0.0]
    assert pairwise(a, b, "cityblock")[0, 0] == 7 and pairwise(a, b, "chebyshev")[0, 0] == 4
    assert pairwise(a, b, "sqcosine")[0, 0] == 2.0  # a zero vector
    assert np.allclose(gemm_sqeuclidean(a, a), pairwise(a, a, "sqeuclidean"))


def test_assignment_and_transport_agree_with_brute_force():
    rng = np.random.default_rng(0)
    for n in range(1, 6):
        c = rng.random((n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert c[np.arange(n), transport.assignment(c)].sum() == pytest.approx(best)
        a = np.full(n, 1 / n)
        assert transport.exact_transport(a, a, c) == pytest.approx(best / n)
    for n, m in ((2, 3), (4, 6), (5, 3)):
        a, b, c = np.full(n, 1 / n), np.full(m, 1 / m), rng.random((n, m))
        exact = transport.exact_transport(a, b, c)
        assert exact == pytest.approx(transport.reference_transport(a, b, c))
        assert transport.greedy(a, b, c) >= exact - 1e-12
        assert transport.sinkhorn(a, b, c) == pytest.approx(exact, abs=0.02)


def test_curvature_of_a_line():
    cost = lambda x, y: np.abs(np.subtract.outer(np.array(x, float), np.array(y, float)))
    assert transport.wasserstein([1, 3, 4], [2, 4, 5], cost, "hungarian") == pytest.approx(1.0)


def test_routing():
    assert partitioned.select_buckets([0.9, 0.8, 0.7, 0.6, 0.5, 0.1, 0.2], 5, 3) == [5, 4, 3]
    assert partitioned.select_buckets([0.4, 0.3, 0.2, 0.1], 4, 10) == [4, 3, 2, 1]
    assert partitioned.select_buckets([0.1], 0, 2) == []
    with pytest.raises(ValueError):
        partitioned.select_buckets([], 2, 2)


def test_shortest_paths_by_hand():
    e = np.array([(1, 2), (2, 3), (3, 4), (4, 5)])
    g = paths.Adjacency(e[:, 0], e[:, 1], np.ones(4))
    assert g.dijkstra({g.place(1): 0.0})[0].tolist() == [0, 1, 2, 3, 4]
    assert np.isinf(g.dijkstra({g.place(5): 0.0})[0][:4]).all()
    dist, prev = g.dijkstra({0: 0.0})
    assert g.path(prev, 0, 4) == [1, 2, 3, 4, 5] and g.path(g.dijkstra({4: 0.0})[1], 4, 0) == []


def test_paths_refine():
    assert paths.subdivide(np.array([[0.0], [1.0], [3.0]]), 2)[:, 0].tolist() == [0, 0.5, 1, 2, 3]
    line = np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]])
    flat = paths.Geometries(line, [np.eye(2)] * 3, np.zeros(3))
    assert paths.length(paths.smooth(line, flat, 4, 60)) < paths.length(line)
    # The nearest of all geometries counts, also those off the path, and points move within their tangent space only.
    flat = paths.Geometries(np.array([[0.0, 0], [1, 0.9], [1, 1], [2, 0]]), [np.eye(2)[:, :1]] * 4, np.zeros(4))
    assert paths.smooth(line, flat, 1, 5)[1].tolist() == [1.0, 1.0]
    assert paths.corrected(2.0, 0.0, 1.0) == 2.0


def test_geometry():
    x, near = np.zeros(3), np.array([[1.0, 0, 0], [-1, 0, 0], [0, 2, 0]])
    basis, eig = geometry.PcaMethod(2).fit(x, near)
    assert np.allclose(basis.T @ basis, np.eye(2)) and geometry.fit_error(x, basis, np.array([0, 0, 5.0])) == pytest.approx(5)
    assert geometry.subspace_angle(np.eye(3)[:, :1], np.eye(3)[:, 1:2]) == pytest.approx(np.pi / 2)
    assert geometry.curvature_indicator([1.0]) == 0 and geometry.curvature_indicator([4.0, 3.0]) == pytest.approx(0.5)


def test_trees_partition_all_points():
    x = np.random.default_rng(1).standard_normal((300, 5))
    for split in (trees.widest_axis, trees.cyclic_axis, trees.two_points, trees.pca_splitter(), trees.pca_forest_splitter(), trees.pca_splitter(trees.randomized_spectrum(3), trees.random_top(2), trees.mean_value)):
        tree = trees.Tree.grow(x, split, trees.max_leaf_size(16), 0)
        sizes = np.bincount(tree.route(x), minlength=tree.leaves)
        assert sizes.sum() == 300 and (sizes > 0).all()
    assert trees.Tree.grow(np.ones((40, 2)), trees.two_points, trees.max_leaf_size(4), 0).leaves == 1
    assert trees.all_of()(x) is False


def test_small_things():
    assert RandomProjection.suggested_dimension(1000, 0.5) == 222
    assert paths.torus_distance(0, 0, 0, np.pi) == pytest.approx(np.pi, rel=1e-3) and paths.torus_distance(0, np.pi, np.pi, np.pi) == pytest.approx(np.pi, rel=1e-3)
    assert len(np.unique(KMeans.plus_plus(np.arange(10.0)[:, None], 4, 0))) == 4

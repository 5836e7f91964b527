"""Known point sets and hand-computed values: geodesics, curvature, transforms, tree rules, graphs of neighbours."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import curvature, geometry, graph, knn, nndescent, paths, transforms, trees
from vicinal.sources import io


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, vec array<double>")


def pairs_of(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src long, dst long")


def test_geodesics_of_known_shapes(spark):
    line = paths.GeodesicModel.build(frame(spark, [(i, (i, 0)) for i in range(1, 21)]), 2)
    assert line.node_to_node(pairs_of(spark, (1, 20))).first()["d"] == pytest.approx(19)
    circle = frame(spark, [(i, (np.cos(2 * np.pi * i / 50), np.sin(2 * np.pi * i / 50))) for i in range(50)])
    model = paths.GeodesicModel.build(circle, 6, geometry.PcaMethod(1), weight="curvature_free", candidate_k=8)
    assert 2 < model.node_to_node(pairs_of(spark, (0, 25))).first()["d"] < 4
    outside = frame(spark, [(7, (1.01, 0)), (8, (-1.01, 0))], "qid")
    d = model.point_to_node(outside.where("qid = 7"), circle.where("id = 25").select("id")).first()["d"]
    assert 2.5 < d < 4
    both = model.point_to_point(outside, spark.createDataFrame([(7, 8)], "a long, b long")).first()["d"]
    assert 2.5 < both < 4
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.random((40, 2)), np.zeros(40)])
    plane = paths.GeodesicModel.build(frame(spark, enumerate(x)), 10)
    got = plane.node_to_node(pairs_of(spark, (0, 1), (5, 30))).collect()
    assert all(r["d"] == pytest.approx(np.linalg.norm(x[r["src"]] - x[r["dst"]]), rel=0.5) for r in got)


def test_shortest_ways_by_hand(spark):
    square = [(1, 2), (2, 3), (3, 4), (4, 1), (1, 5), (2, 5), (3, 5), (4, 5)]
    weights = {p: 1.0 if 5 not in p else 0.5**0.5 for p in square}
    edges = spark.createDataFrame([(a, b, w) for (x, y), w in weights.items() for a, b in ((x, y), (y, x))], "src long, dst long, dist double")
    got = {(r["src"], r["dst"]): (r["d"], r["path"]) for r in paths.pair_paths(edges, pairs_of(spark, (1, 2), (1, 3), (2, 4), (1, 9))).collect()}
    assert got[1, 2] == (1.0, [1, 2]) and got[1, 3][0] == pytest.approx(2**0.5) and got[2, 4][1] == [2, 5, 4] and got[1, 9] == (float("inf"), [])
    parts = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0)], "src long, dst long, dist double")
    found = {(r["src"], r["dst"]) for r in paths.shortest_paths(parts, spark.range(1, 5)).collect()}
    assert found == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4)}


def test_smoothing_leaves_ends_and_shortens(spark):
    p = frame(spark, [(0, (0, 0)), (1, (1, 0.4)), (2, (2, 0)), (3, (1, 0))])
    edges = graph.symmetrize(spark.createDataFrame([(0, 1, 1.1), (1, 2, 1.1), (2, 3, 1.0)], "src long, dst long, dist double"))
    found = spark.createDataFrame([(0, 2, [0, 1, 2])], "src long, dst long, path array<long>")
    flat = geometry.local_geometry(edges, p, geometry.PcaMethod(2))
    r = paths.refine_paths(found, p, flat).first()
    assert 2.0 <= r["d_refined"] < r["d_path"] == pytest.approx(2 * 1.16**0.5)
    own = paths.refine_paths(found, p, flat, base=False, edges=edges).first()
    assert own["d_refined"] == pytest.approx(2.2)
    longer = paths.refine_paths(found, p, flat, base=False, edges=edges, corrections=True, length_scale=0.5).first()
    assert longer["d_refined"] >= own["d_refined"]
    with pytest.raises(ValueError):
        paths.refine_paths(found, p, flat, length_scale=0.0)


def test_curvature_of_a_line_and_of_other_profiles(spark):
    p = frame(spark, [(i, (i, 0)) for i in range(8)])
    edges = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(8) for j in (i - 1, i + 1) if 0 <= j < 8], "src long, dst long, dist double")
    k = {(r["src"], r["dst"]): r["kappa"] for r in curvature.curvatures(edges, p, 2).collect()}
    assert k[3, 4] == pytest.approx(0) and k[4, 3] == pytest.approx(0)
    both = [sorted((r["src"], r["dst"], round(r["kappa"], 9)) for r in curvature.curvatures(edges, p, 2, curvature.Manifold(curvature.Profile(x))).collect()) for x in (False, True)]
    assert all(len(b) == edges.count() and all(np.isfinite(x[2]) for x in b) for b in both)


def test_adaptive_neighbourhoods_drop_what_is_off_the_plane(spark):
    rng = np.random.default_rng(9)
    near = [(*xy, 0.0) for xy in rng.uniform(-1, 1, (8, 2))]
    x, y = np.zeros(3), np.array([*near, (0.1, 0.1, 3.0), (0.2, -0.1, 3.5)])
    y = y[np.argsort(np.linalg.norm(y, axis=1))]
    fixed = geometry.estimate(geometry.PcaMethod(2), x, y)
    adaptive = geometry.estimate(geometry.PcaMethod(2), x, y, "adaptive", limit=0.2)
    assert fixed[2] == 10 and adaptive[2] == 8 and adaptive[3] == 1 and adaptive[4] < 1e-9 < fixed[4]


def test_transforms_by_hand(spark):
    p = frame(spark, [(i, (i, 2 * i)) for i in range(4)])
    assert transforms.identity(p).collect() == p.collect()
    model = transforms.Pca.fit(p)
    assert model.target_dimension == 1 and model.explained_variance_ratio.tolist() == [1.0]
    assert [r["vec"] for r in model.inverse_transform(model.transform(p)).orderBy("id").collect()] == [pytest.approx([i, 2 * i]) for i in range(4)]
    sparse = transforms.RandomProjection.make(50, 4, 1, density=0.2)
    values = {round(abs(x), 6) for row in sparse.rows for x in row}
    assert len(values) == 2 and 0.0 in values and np.mean([x != 0 for row in sparse.rows for x in row]) == pytest.approx(0.2, abs=0.1)
    with pytest.raises(ValueError):
        transforms.KMeans.fit(p, 9)


def test_tree_rules_by_hand():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((200, 3)) * [5.0, 1.0, 0.1]
    exact, axes = trees.exact_spectrum(x, None)
    for other in (trees.randomized_spectrum(2), trees.subsampled_spectrum(150)):
        values, found = other(x, np.random.default_rng(1))
        assert abs(found[0] @ axes[0]) > 0.99 and values[0] / values[1] > 5
    assert exact[0] / exact[1] > 10 and trees.top_component(exact, axes, None) is axes[0] or abs(axes[0][0]) > 0.99
    draws = np.random.default_rng(2)
    assert {abs(trees.random_top(2)(exact, axes, draws)).argmax() for _ in range(20)} == {0, 1}
    assert np.linalg.norm(trees.random_combination(3)(exact, axes, draws)) == pytest.approx(1)
    line = np.arange(11.0)
    assert trees.median_value(line, draws) == 5 and trees.mean_value(line, draws) == 5 and all(4 <= trees.between_quantiles()(line, draws) <= 6 for _ in range(20))
    flat = np.column_stack([np.arange(100.0), *np.zeros((19, 100))])
    assert trees.intrinsic_dim_ratio(0.1, 256)(flat) and not trees.intrinsic_dim_ratio(0.1, 50)(flat) and not trees.intrinsic_dim_ratio(0.1, 256)(rng.standard_normal((100, 5)))
    assert trees.any_of(trees.max_leaf_size(5))(line[:5]) and not trees.all_of()(line)


def test_sampled_and_pruned_neighbour_graphs(spark):
    rng = np.random.default_rng(11)
    p = frame(spark, enumerate(rng.standard_normal((120, 4))))
    truth = knn.search(p, p.withColumnRenamed("id", "qid"), 5, exclude_self=True)
    built = nndescent.build(p, 8, 8, sampling=nndescent.Sampling(0.7), symmetry="none")
    found = built.select(F.col("src").alias("qid"), F.col("dst").alias("id"), F.lit(1).alias("rank"))
    assert knn.recall(found, truth, 5).agg(F.avg("recall")).first()[0] > 0.85
    sizes = [r["count"] for r in nndescent.build(p, 4, 3, symmetry="pruned").groupBy("src").count().collect()]
    assert max(sizes) <= 6
    assert max(r["count"] for r in nndescent.symmetrized(built, 4, strict_reference=True).groupBy("src").count().collect()) == 4


def test_results_are_written_as_json(spark, tmp_path):
    io.write_json(spark.createDataFrame([(1, "a")], "run long, name string"), f"{tmp_path}/out")
    lines = [json.loads(x) for f in tmp_path.glob("out/*.json") for x in f.read_text().splitlines()]
    assert lines == [{"run": 1, "name": "a"}]
    io.write_csv(spark.createDataFrame([(1, "a")], "run long, name string"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["name"] == "a"

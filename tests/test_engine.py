"""Operators on small tables: fixtures by hand and brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import curvature, evaluate, geometry, graph, hashing, hnsw, knn, nndescent, partitioned, paths, trees
from vicinal.operators.transforms import KMeans
from vicinal.sources import io

POINTS = "id long, vec array<double>"


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, vec array<double>")


def test_brute_force(spark):
    p = frame(spark, [(1, (0, 0)), (2, (1, 0)), (3, (2, 0))])
    q = frame(spark, [(7, (0.25, 0))], "qid")
    assert [r["id"] for r in knn.search(p, q, 2).orderBy("rank").collect()] == [1, 2]
    assert knn.search(p, q, 0).count() == 0 and knn.search(p, q, 9).count() == 3
    with pytest.raises(ValueError):
        knn.check_dimensions(p, frame(spark, [(7, (1, 2, 3))], "qid"))


def test_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(0)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((200, 3)).round(1))])
    q = p.withColumnRenamed("id", "qid")
    whole = sorted(map(tuple, knn.search(p, q, 5).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 64)
    assert sorted(map(tuple, knn.search(p, q, 5).collect())) == whole
    assert sorted(map(tuple, trees.KdTree.build(p, leaf_size=8).search(q, 5).collect())) == whole


def test_graph_rules(spark):
    p = frame(spark, [(i, (i * 3 + 1, i * 3 + 2, i * 3 + 3)) for i in range(4)])
    assert graph.knn_graph(p, 2).groupBy("src").count().where("count <> 2").count() == 0
    for k in (0, 4):
        with pytest.raises(ValueError):
            graph.knn_graph(p, k)


def test_effective_epsilon_of_a_chain(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 4.0)], "src long, dst long, dist double")
    both = graph.symmetrize(edges)
    for exact, want in ((False, [2, 4, 2]), (True, [2, 4, 4])):
        got = graph.effective_epsilon(both, 1, exact).where("src < dst").orderBy("src").collect()
        assert [r["eps"] for r in got] == want


def test_empty_clusters_take_far_points(spark):
    p = frame(spark, [(i, (i, 0)) for i in range(5)])
    fit = KMeans(np.array([[0.0, 0], [1e9, 1e9], [1e9, 1e9], [1e9, 1e9]])).step(p)
    assert len({tuple(c) for c in fit.centroids[1:]}) == 3 and all(0 <= c[0] <= 4 for c in fit.centroids[1:])


def test_hyperplane_key(spark):
    p = frame(spark, [(3, (1, 1)), (0, (-1, -1)), (1, (1, -1))])
    key = hashing.RandomHyperplane([[1.0, 0.0], [0.0, 1.0]]).key("vec")
    assert all(int(r["k"]) == r["id"] for r in p.select("id", key.alias("k")).collect())


def test_hnsw_finds_itself(spark):
    rng = np.random.default_rng(2)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((150, 8)))])
    found = hnsw.HnswIndex.build(p, hnsw.Params(m=8, ef_construction=50)).search(p.withColumnRenamed("id", "qid"), 1)
    assert found.where("qid = id").count() >= 148


def test_curvature_is_symmetric(spark):
    p = frame(spark, [(i, (i % 5, i // 5)) for i in range(25)])
    edges = graph.symmetrize(graph.knn_graph(p, 4))
    for variant in (curvature.Standard(), curvature.Manifold(), curvature.Manifold(curvature.Profile(True))):
        k = {(r["src"], r["dst"]): r["kappa"] for r in curvature.curvatures(edges, p, 4, variant).collect()}
        assert len(k) == edges.count() and all(k[a, b] == k[b, a] for a, b in k)


def test_auroc_and_bridges(spark):
    rows = spark.createDataFrame([(0.1, False), (0.4, False), (0.35, True), (0.8, True), (float("nan"), True)], "s double, y boolean")
    assert evaluate.auroc(rows, "s", "y").first()[0] == 0.75
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert [tuple(r) for r in evaluate.bridges(e).collect()] == [(3, 4)]


def test_pending_and_merge(spark):
    jobs = spark.range(5).withColumnRenamed("id", "run")
    assert io.pending(jobs, jobs.where("run < 3"), ["run"]).count() == 2
    assert io.merge_shards([jobs, jobs.withColumn("error", F.lit("x"))]).where("error is null").count() == 5


def test_hops_have_no_limit(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(30)], "src long, dst long, dist double")
    found = paths.hop_relax(edges, spark.createDataFrame([(0,), (25,)], "id long")).collect()
    assert {(r["src"], r["dst"]): r["d"] for r in found} == {(s, t): float(t - s) for s in (0, 25) for t in range(s, 31)}


def test_every_search_checks_dimensions(spark):
    rng = np.random.default_rng(3)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((40, 3)))])
    bad = frame(spark, [(1, (1.0, 2.0))], "qid")
    none = spark.createDataFrame([], "qid long, vec array<double>")
    config = partitioned.Transformed(2)
    hyper = [hashing.RandomHyperplane.make(3, 2, 1)]
    indexes = [knn.BruteForce(p), trees.KdTree.build(p), trees.Forest.build(p, n_trees=2), hashing.LshIndex.build(p, hyper), partitioned.IvfFlat.build(p, 2, rounds=1), partitioned.MultiLevel.build(p, config, 1)]
    for index in indexes:
        with pytest.raises(ValueError):
            index.search(bad, 2)
        assert index.search(none, 2).count() == 0
    with pytest.raises(ValueError):
        knn.search(p.union(bad.withColumnRenamed("qid", "id")), none, 0)
    with pytest.raises(ValueError):
        nndescent.search(nndescent.build(p, 3, 1), p, bad, 2)


def test_capabilities_and_inserts(spark):
    rng = np.random.default_rng(4)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((30, 3)))])
    more = frame(spark, [(30 + i, v) for i, v in enumerate(rng.standard_normal((5, 3)))])
    brute, index = knn.BruteForce(p), hnsw.HnswIndex.build(p, hnsw.Params(m=6))
    assert (brute.mutable, brute.layered, brute.configured_k()) == (True, False, None)
    assert (index.mutable, index.layered, index.metadata, index.configured_k()) == (True, True, True, 6)
    assert brute.insert(more).points.count() == 35 and index.insert(more).nodes().count() == 35
    for spoilt in (frame(spark, [(3, (0, 0, 0))]), frame(spark, [(99, (0, 0)), (100, (0, 0))])):
        with pytest.raises(ValueError):
            brute.insert(spoilt)
    for ids in ((31,), (30, 32), (30, 30), (29, 30)):
        with pytest.raises(ValueError):
            index.insert(frame(spark, [(i, (0, 0, 0)) for i in ids]))
    descent = nndescent.NnDescentIndex.build(p, 4, 4)
    assert descent.configured_k() == 4 and descent.edges().columns == ["src", "dst", "dist", "rank"] and not descent.mutable
    assert descent.search(p.withColumnRenamed("id", "qid"), 1).where("qid = id").count() == 30
    for lacking in (lambda: trees.KdTree.build(p).insert(more), lambda: trees.KdTree.build(p).edges()):
        with pytest.raises(NotImplementedError):
            lacking()


def test_first_rows_are_found_by_counting(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 4, 500) / 3, rng.integers(-(1 << 62), 1 << 62, 500), range(500), strict=True)]
    df = spark.createDataFrame(rows, "a double, b long, c long")
    for columns in (["a", "b", "c"], ["b", "c"], ["a", "c"]):
        at = [("a", "b", "c").index(x) for x in columns]
        order = sorted(rows, key=lambda r: tuple(r[k] for k in at))
        for n in (0, 1, 130, 499, 500, 600):
            got = df.where(evaluate.among_first(df, columns, n, few=8)).collect()
            assert sorted(map(tuple, got)) == sorted(order[:n]), (columns, n)


def test_ranks_and_windows_stay_distributed(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(s), bool(y)) for g, s, y in zip(rng.integers(0, 3, 3000), rng.integers(0, 900, 3000) / 7, rng.random(3000) < 0.4, strict=True)]
    df = spark.createDataFrame(rows, "g long, s double, y boolean")
    ranked = {r["s"]: r["rk"] for r in evaluate.ranks_by_counts(df, "s", "rk").collect()}
    values = np.array([r[1] for r in rows])
    assert all(rk == (values < s).sum() + ((values == s).sum() + 1) / 2 for s, rk in ranked.items())
    for by, groups in (([], [rows]), (["g"], [[r for r in rows if r[0] == k] for k in range(3)])):
        got = sorted(r["auroc"] for r in evaluate.auroc(df, "s", "y", by).collect())
        want = []
        for own in groups:
            good, other = (np.array([r[1] for r in own if r[2] == y]) for y in (True, False))
            want.append(((good[:, None] > other).sum() + (good[:, None] == other).sum() / 2) / (len(good) * len(other)))
        assert got == pytest.approx(sorted(want))
    edges = df.select(F.monotonically_increasing_id().alias("src"), F.lit(1).cast("long").alias("dst"), F.col("s").alias("kappa"))
    points = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((50, 3)))])
    start = nndescent.build(points, 3, 0)
    for plan in (evaluate.rank_prune(edges, 0.2), evaluate.random_prune(edges, 0.2), evaluate.ranks_by_counts(df, "s", "rk").drop("rk"), start, trees.Forest.build(points, n_trees=2).search(points.withColumnRenamed("id", "qid"), 2)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit" not in text and "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in evaluate.rank_prune(edges, 0.2)._jdf.queryExecution().executedPlan().toString()


def test_large_leaves_are_split_and_dealt(spark, monkeypatch):
    rng = np.random.default_rng(7)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((400, 3)).round(1))])
    q = p.withColumnRenamed("id", "qid")
    whole = sorted(map(tuple, knn.search(p, q, 4).collect()))
    monkeypatch.setattr(trees, "LEAF_ROWS", 30)
    monkeypatch.setattr(trees, "SAMPLE", 20)
    assert sorted(map(tuple, trees.KdTree.build(p, leaf_size=8).search(q, 4).collect())) == whole
    found = trees.Forest.build(p, n_trees=12).search(q, 4)
    assert knn.recall(found, knn.search(p, q, 4), 4).agg(F.avg("recall")).first()[0] > 0.8


def test_metadata_and_accessors(spark):
    p = frame(spark, [(i, (i, 0)) for i in range(4)])
    edges = graph.knn_graph(p, 2)
    names = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "id long, label string")
    nodes = graph.with_metadata(p, names)
    assert graph.has_metadata(nodes, ("id", "vec")) and not graph.has_metadata(p, ("id", "vec"))
    for spoilt in (names.limit(1), names.union(names)):
        with pytest.raises(ValueError):
            graph.with_metadata(p, spoilt)
    own = {r["id"]: (r["neighbors"], r["weights"]) for r in graph.node_neighbors(edges, p).collect()}
    assert own[0] == ([1, 2], [1.0, 2.0]) and own[1] == ([0, 2], [1.0, 1.0])
    with pytest.raises(ValueError):
        geometry.weighted_graph(p, 3, candidate_k=2)


def test_edge_weights_by_hand(spark):
    g = "id long, center array<double>, basis array<array<double>>"
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    made = spark.createDataFrame([(1, [0.0, 0.0, 0.0], [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]), (2, [1.0, 0.0, 1.0], [[1.0, 0.0], [0.0, 0.0], [0.0, 1.0]])], g)
    w = geometry.edge_weights(e, made).first()
    assert w["tangent_mean"] == pytest.approx((1 + 2**0.5) / 2) and w["curvature_free"] == pytest.approx((8 * 2**0.5 - 1 - 2**0.5) / 6) and not w["negative"]
    wide = spark.createDataFrame([(i, [float(i - 1), 0.0], [[5.0, 0.0], [0.0, 5.0]]) for i in (1, 2)], g)
    w = geometry.edge_weights(e, wide).first()
    assert w["negative"] and w["curvature_free"] == 1.0
    assert geometry.diagnostics(geometry.edge_weights(e, wide)).first()["n_negative_fallbacks"] == 1


def test_recentred_geometries_rebuild_points(spark):
    p = frame(spark, [(i, (i, i % 2, 0)) for i in range(6)])
    g = geometry.local_geometry(graph.knn_graph(p, 3), p, geometry.PcaMethod(3))
    moved = geometry.recenter(g, frame(spark, [(i, (9, 9, 9)) for i in range(6)]))
    x = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    back = geometry.reconstruct(F.col("center"), F.col("basis"), geometry.project("basis", F.zip_with(x, "center", lambda a, b: a - b)))
    rows = moved.select(back.alias("x"), geometry.local_distance("basis", F.col("center"), x).alias("d")).collect()
    assert all(r["x"] == pytest.approx([1, 2, 3]) and r["d"] == pytest.approx((64 + 49 + 36) ** 0.5) for r in rows)


def test_wide_enough_shells(spark):
    # A line with a far bend: the shells along the line are flat, the next ones are not.
    p = frame(spark, [(i, (min(i, 6), max(0, i - 6) * 3.0)) for i in range(10)])
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(10) for j in (i - 1, i + 1) if 0 <= j < 10], "src long, dst long, dist double")
    got = {r["id"]: (r["used"], r["rounds"]) for r in geometry.expanding_geometry(edges, p, geometry.PcaMethod(1), limit=0.05, rounds=3).collect()}
    assert got[2] == (5, 2) and got[4] == (4, 1) and got[6][1] == 0


def test_csv_results_resume(spark, tmp_path):
    schema, path = "run long, value double", f"{tmp_path}/out"
    assert io.completed_keys(spark, path, ["run"], schema).count() == 0
    for k in range(2):
        io.append_csv(spark.createDataFrame([(k, k / 2)], schema), path)
    jobs = spark.range(4).withColumnRenamed("id", "run")
    assert sorted(r["run"] for r in io.pending(jobs, io.completed_keys(spark, path, ["run"], schema), ["run"]).collect()) == [2, 3]
    train, test = io.split(spark.range(10).withColumn("vec", F.array(F.lit(1.0))), 6, 3)
    assert train.count() == 6 and sorted(r["qid"] for r in test.collect()) == [6, 7, 8]


def test_directed_graphs_are_warned_of(spark):
    p = frame(spark, [(i, (i, 0)) for i in range(4)])
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, dist double")
    pairs = spark.createDataFrame([(0, 3), (3, 0)], "src long, dst long")
    with pytest.warns(UserWarning):
        got = {(r["src"], r["dst"]): r["d"] for r in curvature.pair_distances(pairs, edges, p, "geodesic_unit", 1).collect()}
    assert got == {(0, 3): 3.0, (3, 0): float("inf")}
    with pytest.raises(ValueError):
        curvature.pair_distances(pairs, edges, p, "other", 1)


def test_entry_survives_a_missing_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "vicinal.llm", None)
    with pytest.warns(UserWarning):
        assert "knn_euclidean" in entry.queries()

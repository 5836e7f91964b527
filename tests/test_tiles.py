"""Tiles of many queries in few dimensions: equal to brute force, with copies, ties and vectors that are not finite."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import evaluate, geometry, graph, hnsw, knn, nndescent, partitioned, tiles, trees
from vicinal.plans import catalogue

from test_engine import frame


def brute(rows, k, self_too=False):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    dist = knn.pairwise(x, x)
    out = set()
    for a, i in enumerate(ids.tolist()):
        near = sorted((d, j) for d, j in zip(dist[a].tolist(), ids.tolist(), strict=True) if np.isfinite(d) and (self_too or i != j))[:k]
        out |= {(i, r + 1, j, d) for r, (d, j) in enumerate(near)}
    return out


def test_f1_tiles_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), v) for i, v in zip(rng.permutation(1500), [*rng.integers(0, 12, (700, 2)) / 4, *rng.standard_normal((799, 2)), np.array([np.nan, 1.0])], strict=True)]
    monkeypatch.setattr(tiles, "TILE", 64)
    monkeypatch.setattr(tiles, "LEAF", 8)
    monkeypatch.setattr(knn, "block_best", None)  # blocks of all pairs are not met
    p = frame(spark, rows)
    q = p.withColumnRenamed("id", "qid")
    for self_too in (False, True):
        assert set(map(tuple, knn.search(p, q, 4, exclude_self=not self_too).collect())) == brute(rows, 4, self_too)
    monkeypatch.setattr(tiles, "TILE", 8192)
    assert {(r["src"], r["rank"], r["dst"], r["dist"]) for r in graph.knn_graph(p, 4).collect()} == brute(rows, 4)


#: Queries that are run on copies of parts, more than a block of queries holds, without blocks of all pairs, and compared with their SQL.
BY_TILES = [
    "f1_sweep",
    "auroc",
    "canonical_edges",
    "effective_epsilon_default",
    "jaccard_scores",
    "local_pca",
    "mirror_edges",
    "oracle_prune",
    "prune_graph",
    "spearman_rank",
    "tangent_angles",
    "rank_prune",
    "random_prune",
    "rank_prune_around_bridges",
    "best_f1_threshold",
    "curvature_free_diagnostics",
    "edge_weight_tangent",
    "edge_weight_stats",
    "effective_epsilon_exact",
    "filter_graph",
    "gabriel_mask",
]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    folder = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"copy (select * replace (p_partkey + i * 200 as p_partkey) from '/root/testdata/sf0.001/part.parquet', range(6) r(i)) to '{folder}/part.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", BY_TILES)
def test_queries_by_tiles_equal_sql(spark, copies, monkeypatch, name):
    monkeypatch.setattr(tiles, "TILE", 128)
    monkeypatch.setattr(knn, "block_best", None)
    found = catalogue.QUERIES[name](spark, copies)
    with duckdb.connect() as c:
        c.execute(f"create view part as select * from '{copies}/part.parquet'")
        want = c.execute(catalogue.ORACLE_SQL[name])
        columns, rows = [d[0] for d in want.description], want.fetchall()
    shown = lambda rs: sorted(tuple(str(v + 0.0 if isinstance(v, float) else v) for v in r) for r in rs)
    assert shown(found.select(*columns).collect()) == shown(rows)


def test_f12_ranks_without_variance(spark):
    """All lengths are 0 where every point has copies enough."""
    edges = spark.createDataFrame([(0.0, r) for r in (1, 2, 3)], "dist double, rank int")
    assert np.isnan(evaluate.spearman(edges, "dist", "rank").first()[0])


def test_f14_sharing_equals_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    p = frame(spark, [(int(i), v) for i, v in enumerate(rng.standard_normal((60, 2)))])
    edges = graph.knn_graph(p, 4)
    own = geometry.local_geometry(edges, p, geometry.PcaMethod(1))
    basis = {r["id"]: np.array(r["basis"]) for r in own.collect()}
    beside: dict[int, list[int]] = {}
    for r in edges.collect():
        beside.setdefault(r["src"], []).append(r["dst"])
    donor: dict[int, int] = {}
    for i in sorted(basis):
        fit = [j for j in beside[i] if donor.get(j) == j and geometry.subspace_angle(basis[i], basis[j]) <= 0.3]
        donor[i] = min(fit, default=i)
    assert {r["id"]: r["donor"] for r in geometry.share_tangents(own, edges, 0.3).collect()} == donor
    assert len(set(donor.values())) < len(donor)


def test_f5_pairs_without_a_way_are_counted(spark):
    found = spark.createDataFrame([(1, 2, 2.0), (3, 4, 3.0), (3, 5, 1.0)], "src long, dst long, d double")
    truth = spark.createDataFrame([(1, 2, 1.0), (3, 4, 3.0), (3, 5, 0.0)], "src long, dst long, d_true double")
    r = evaluate.geodesic_error(found, truth, 10).first()
    assert (r["mean_error"], r["median_error"], r["n_disconnected"]) == (0.5, 0.5, 8)


def test_f9_nested_lists_score_inside_tasks(spark):
    rng = np.random.default_rng(6)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.integers(0, 4, (300, 6)))])
    q = p.withColumnRenamed("id", "qid")
    found = partitioned.MultiLevel.build(p, partitioned.Transformed(4, partitioned.Transformed(2)), rounds=2).search(q, 7)
    assert set(map(tuple, found.collect())) == set(map(tuple, knn.search(p, q, 7).collect()))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()  # no row for each pair


def test_f30_layers_hold_one_of_equal_vectors(spark):
    """40 copies of 40 points on two lines: lists of neighbours full of copies would lead nowhere else."""
    rows = [(c * 40 + i, (i / 10, i % 2 * 3)) for c in range(40) for i in range(40)]
    p, q = frame(spark, rows), frame(spark, rows[:20], "qid")
    index = hnsw.HnswIndex.build(p, hnsw.Params(m=4, ef_construction=20, policy="closest"))
    assert set(map(tuple, index.search(q, 50, ef=60).collect())) == set(map(tuple, knn.search(p, q, 50).collect()))
    assert index.nodes().distinct().count() == index.nodes().count() == len(rows)


@pytest.mark.parametrize("symmetry", ["full", "continuous"])
def test_f27_f29_descent_holds_one_of_equal_vectors(spark, symmetry):
    rows = [(c * 40 + i, (i / 10, i % 2 * 3)) for c in range(12) for i in range(40)]
    p, q = frame(spark, rows), frame(spark, rows[:20], "qid")
    built = nndescent.build(p, 6, 4, metric="euclidean", symmetry=symmetry)
    assert set(map(tuple, nndescent.search(built, p, q, 20, beam=24, metric="euclidean").collect())) == set(map(tuple, knn.search(p, q, 20).collect()))
    assert built.select("src").distinct().count() == len(rows)


def test_f25_f26_forests_read_leaves_until_recall_is_reached(spark):
    rng = np.random.default_rng(8)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((1200, 16)))])
    q = p.where("id < 200").withColumnRenamed("id", "qid")
    truth = knn.search(p, q, 10)
    for splitter in (trees.two_points, trees.pca_forest_splitter()):
        found = trees.Forest.build(p, splitter, trees.max_leaf_size(64), 3).search(q, 10)
        assert knn.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_f28_descent_lengthens_lists_until_recall_is_reached(spark):
    """Directions without structure: lists of 10 find some 0.7 of the nearest."""
    rng = np.random.default_rng(9)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((1500, 48)))])
    truth = knn.search(p, p.withColumnRenamed("id", "qid"), 6, exclude_self=True)
    share = lambda built: knn.recall(built.select(F.col("src").alias("qid"), F.col("dst").alias("id"), F.lit(1).alias("rank")), truth, 6).agg(F.avg("recall")).first()[0]
    built = nndescent.build(p, 6, 6, symmetry="none")
    assert share(built) >= 0.9 > share(nndescent.build(p, 6, 6, symmetry="none", recall=None))
    assert built.groupBy("src").count().where("count <> 6").isEmpty()


@pytest.mark.parametrize("metric", ["sqeuclidean", "euclidean", "cosine", "cityblock"])
def test_f28_pairs_of_a_pivot_are_scored_as_in_columns(spark, metric):
    rng = np.random.default_rng(10)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((60, 5)))])
    meets = spark.createDataFrame([(0, i, i % 3 == 0) for i in range(40)], "pivot long, x long, fresh boolean")
    empty = spark.createDataFrame([], "src long, dst long, dist double")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(40) if i != j and (i % 3 == 0 or j % 3 == 0)], "src long, dst long")
    found = nndescent.nearer_pairs(meets, empty, p, 60, 100, metric, None, 0)
    assert set(map(tuple, found.collect())) == set(map(tuple, nndescent.score(pairs, p, metric).collect()))


def test_f31_beams_widen_until_recall_is_reached(spark):
    """Directions without structure, in graphs of few links: beams of 10 miss much of what the shards hold."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((800, 24))
    p = frame(spark, [(i, v) for i, v in enumerate(x)]).withColumn("bucket", F.col("id") % 2)
    q = p.where("id < 100").select(F.col("id").alias("qid"), "vec", F.lit(0).cast("long").alias("shard"))
    truth = knn.search(p.where("bucket = 0"), q, 10)
    index = hnsw.HnswIndex.build(p, hnsw.Params(m=4, ef_construction=12, ef=10), "bucket")
    share = lambda **options: knn.recall(index.search(q, 10, routed=True, **options), truth, 10).agg(F.avg("recall")).first()[0]
    assert share() < 0.9 < 0.95 <= share(recall=0.98)
    assert index.search(q.where("qid < 0"), 10, routed=True, recall=0.98).isEmpty()


def test_f32_walks_widen_until_recall_is_reached(spark):
    """Directions without structure, in a graph of short lists: a beam of 10 misses much."""
    rng = np.random.default_rng(13)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((1500, 48)))])
    q = p.where("id < 100").withColumnRenamed("id", "qid")
    truth = knn.search(p, q, 10)
    built = nndescent.build(p, 6, 6, recall=None)
    share = lambda **options: knn.recall(nndescent.search(built, p, q, 10, beam=10, **options), truth, 10).agg(F.avg("recall")).first()[0]
    assert share() < 0.9 <= share(recall=0.95)
    assert nndescent.search(built, p, q.where("qid < 0"), 10, recall=0.95).isEmpty()


@pytest.mark.parametrize("metric", ["sqeuclidean", "euclidean", "cosine", "cityblock"])
def test_f32_pairs_of_a_walk_are_scored_as_in_columns(spark, monkeypatch, metric):
    monkeypatch.setattr(nndescent, "FEW_PIVOTS", 16)
    rng = np.random.default_rng(14)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((60, 5)))])
    pairs = spark.createDataFrame([(i, j) for i in range(0, 60, 3) for j in range(i % 7, 60, 2)] * 2, "qid long, id long")
    asks = p.where("id % 3 = 0").select(F.col("id").alias("qid"), "vec", F.when(F.col("id") < 30, 2.0).otherwise(float("inf")).alias("reach"))
    found = nndescent._scored(pairs, p, 60, asks, 100, metric)
    scored = nndescent.score(pairs.distinct().toDF("src", "dst"), p, metric)
    want = {(a, b, d) for a, b, d in scored.collect() if a >= 30 or d <= 2.0}
    rows = list(map(tuple, found.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_r03_f2_closest_links_are_checked(spark, tmp_path):
    """Groups of 40 points that are linked to nothing but themselves: those without a point in a higher layer are on no walk."""
    duckdb.sql(f"copy (select i as s_suppkey, (i // 40) % 25 as s_nationkey, (i // 1000) * 2500.0::double + i % 40 + (i * 7919 % 1000) / 1000 as s_acctbal from range(4000) r(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    found = catalogue.QUERIES["hnsw_closest"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
        want = c.execute(catalogue.ORACLE_SQL["hnsw_closest"]).fetchall()
    assert sorted(map(tuple, found.select("qid", "rank", "id", "dist").collect())) == sorted(want)


@pytest.mark.parametrize("metric", ["sqeuclidean", "euclidean"])
def test_r03_f2_checks_equal_scans(metric):
    """Also where a walk finds nothing, or there are fewer points than k."""
    rng = np.random.default_rng(15)
    graph = hnsw.Graph(hnsw.Params(metric=metric), 3)
    for n in (0, 5, 500):
        for i in range(len(graph.ids), n):
            graph.insert(7 * i, rng.integers(0, 6, 3) / 4)
        boxes = graph.boxes()
        assert len(graph.x) == n and sorted(np.concatenate([np.zeros(0, int), *boxes[0]]).tolist()) == list(range(n))
        for q in rng.integers(0, 6, (20, 3)) / 4:
            assert graph.checked(q, 10, [], boxes) == graph.checked(q, 10, graph.search(q, 10, 10), boxes) == graph.scan(q, 10)


def test_r03_f1_exact_blocks_go_by_products(monkeypatch):
    """In many dimensions only what products don't leave out is added up; batches are bounded by those before them."""
    rng = np.random.default_rng(16)
    x, ids = np.concatenate([rng.integers(0, 3, (300, 20)) / 2, rng.standard_normal((300, 20)) + 1e3]), rng.permutation(600)
    far = knn.pairwise(x, x)
    far[ids[:, None] == ids[None, :]] = np.inf
    want = [(int(ids[a]), int(ids[b]), float(far[a, b])) for a in range(600) for b in np.lexsort((ids, far[a]))[:7]]
    monkeypatch.setattr(knn, "pairwise", None)
    rows = lambda batch: list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    assert rows(knn.block_best(x, ids, x, ids, 7, True, metric="euclidean")) == want
    monkeypatch.setattr(knn, "QUERY_BLOCK", 100)
    monkeypatch.setattr(knn, "POINT_ROWS", 64)
    assert rows(knn.cell_best(x, ids, x, ids, 7, True, metric="euclidean")) == want


def test_r03_f1_lists_start_from_leaves(spark, monkeypatch):
    """Directions without structure: lists of twice the length are enough, and leaves are met without a join of pairs with vectors."""
    rng = np.random.default_rng(17)
    p = frame(spark, [(i, v) for i, v in enumerate(rng.standard_normal((1500, 48)))])
    truth = knn.search(p, p.withColumnRenamed("id", "qid"), 6, exclude_self=True)
    lists, descend = [], nndescent._descend
    monkeypatch.setattr(nndescent, "_descend", lambda *a: lists.append(a[3]) or descend(*a))
    monkeypatch.setattr(nndescent, "score", None)
    built = nndescent.build(p, 6, 6, init="rptree", symmetry="none")
    found = built.select(F.col("src").alias("qid"), F.col("dst").alias("id"), F.lit(1).alias("rank"))
    assert knn.recall(found, truth, 6).agg(F.avg("recall")).first()[0] >= 0.9 and max(lists) <= 12
    assert built.groupBy("src").count().where("count <> 6").isEmpty()

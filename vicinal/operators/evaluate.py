"""Evaluation of graphs, scores and benchmark runs: aggregations and windows."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance
from .graph import canonical
from .paths import MOST_EDGES, adjacency_of
from .knn import stream
from .nndescent import cut


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks; NaN without variance."""
    ranked = ranks_by_counts(ranks_by_counts(df.select(a, b), a, "ra"), b, "rb")
    r = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
    return ranked.agg(F.coalesce(r, F.lit(float("nan"))).alias("spearman"))


#: Ranges of values that ranks are added up over.
RANGES = 64


def range_of(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """The number of a value's range, with bounds that are fixed as literals, so that a task that runs again finds the same. Equal values share a range."""
    bounds = sorted({float(b) for b in df.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.5 / ranges)})
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column))) if bounds else F.lit(0)


def before_in_order(counts: DataFrame, column: str, value: str, by: list[str] | None = None) -> DataFrame:
    """counts with _before, the sum of `value` over all rows of the group with a lesser `column` (distinct in a group). Windows hold one range of a group; the second step has RANGES rows a group."""
    groups = by or []
    ranged = counts.withColumn("_range", range_of(counts, column))
    sizes = ranged.groupBy(*groups, "_range").agg(F.sum(value).alias("_size"))
    lesser = sizes.withColumn("_lesser", F.sum("_size").over(Window.partitionBy(*groups, F.lit(0)).orderBy("_range")) - F.col("_size")).drop("_size")
    within = F.sum(value).over(Window.partitionBy(*groups, "_range").orderBy(column)) - F.col(value)
    own = ranged.withColumn("_within", within).withColumnRenamed("_range", "_own")
    on = [F.col("_own") == F.col("_range"), *(F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups)]
    for g in groups:
        lesser = lesser.withColumnRenamed(g, f"_{g}")
    joined = own.join(lesser, on)
    return joined.withColumn("_before", F.col("_lesser") + F.col("_within")).drop("_own", "_range", "_lesser", "_within", *(f"_{g}" for g in groups))


def ranks_by_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    """Mean ranks without a window over all rows: counts of distinct values, added up over ranges of values in two steps."""
    placed = before_in_order(df.groupBy(column).agg(F.count("*").alias("_n")), column, "_n")
    return df.join(placed.select(F.col(column).alias("_v"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(name)), F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the curve by the rank sum; groups with one class, and NaN scores, drop out."""
    groups = by or []
    clean = df.where(~F.isnan(score) & F.col(score).isNotNull())
    per = clean.groupBy(*groups, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    total = before_in_order(per, score, "q", groups).withColumn("u", F.col("p") * (F.col("_before") + F.col("q") / 2)).groupBy(*groups).agg(F.sum("u").alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return total.where("np > 0 and nq > 0").select(*groups, (F.col("u") / (F.col("np") * F.col("nq"))).alias("auroc"))


def threshold_sweep(df: DataFrame, score: str, label: str, grid: list[float]) -> DataFrame:
    """(threshold, tp, fp, tn, fn, precision, recall, f1): an edge counts as found where its score is below the threshold."""
    cols = []
    for k, t in enumerate(grid):
        low = F.col(score) < F.lit(t)
        cols += [F.count_if(low & F.col(label)).alias(f"tp{k}"), F.count_if(low & ~F.col(label)).alias(f"fp{k}"), F.count_if(~low & ~F.col(label)).alias(f"tn{k}"), F.count_if(~low & F.col(label)).alias(f"fn{k}")]
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "tn", "fn")]) for k, t in enumerate(grid)]))
    one = df.agg(*cols).select(rows.alias("r")).select("r.*")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def best_f1(sweep: DataFrame) -> DataFrame:
    """The first threshold of the greatest f1."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def stats_by_label(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))


def pareto(runs: DataFrame, by: list[str], recall: str = "recall", qps: str = "qps") -> DataFrame:
    """Runs that are faster than all with at least their recall."""
    order = Window.partitionBy(*by).orderBy(F.desc(recall), F.desc(qps)).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_best", F.max(qps).over(order)).where(F.col("_best").isNull() | (F.col(qps) > F.col("_best"))).drop("_best")


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def frontier_aggregate(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Successful runs by their settings: mean qps and recall, summed repetitions, run ids."""
    return runs.where("status = 'success'").groupBy(*keys).agg(F.avg("qps").alias("qps"), F.avg("recall").alias("recall"), F.sum("reps").alias("reps"), F.count("*").alias("n_runs"), F.array_join(F.array_sort(F.collect_set(F.col("run").cast("string"))), ",").alias("runs"))


def parameter_grid(spark, **values: list) -> DataFrame:
    """All combinations of settings."""
    grid = spark.range(1).select()
    for name, options in values.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(o) for o in options])).alias(name))
    return grid


def keep_one(edges: DataFrame, removed: DataFrame, score: str = "kappa") -> DataFrame:
    """edges without removed ones; a source that would lose all keeps the one of highest score (missing counts as 0)."""
    left = edges.join(removed.select("src", "dst").withColumn("_gone", F.lit(True)), ["src", "dst"], "left")
    order = Window.partitionBy("src").orderBy(F.col("_gone").isNotNull(), F.coalesce(F.col(score), F.lit(0.0)).desc(), "dst")
    return left.withColumn("_r", F.row_number().over(order)).where("_gone is null or _r = 1").drop("_gone", "_r")


def prune_graph(edges: DataFrame, threshold: float) -> DataFrame:
    return keep_one(edges, edges.where(F.coalesce("kappa", F.lit(0.0)) < threshold))


def oracle_prune(edges: DataFrame, label: str = "shortcut") -> DataFrame:
    return keep_one(edges, edges.where(label))


def rank_prune(scored: DataFrame, fraction: float, bridges: DataFrame | None = None) -> DataFrame:
    """Without the lowest bround(fraction * scored) edges by (kappa, src, dst); bridges and edges without a score stay."""
    open_edges = scored.where("kappa is not null")
    take = int(round(fraction * open_edges.count()))
    if bridges is not None:
        open_edges = open_edges.join(bridges.select("src", "dst"), ["src", "dst"], "left_anti")
    gone = open_edges.where(among_first(open_edges, ["kappa", "src", "dst"], take))
    return scored.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def among_first(df: DataFrame, columns: list[str], n: int, few: int = 4096) -> Column:
    """Whether a row is among the first n in the order of number columns without nulls. The bound is found by counting in ever finer bins, so no task sorts all rows;
    rows that agree in all columns are taken or left together."""
    if n <= 0:
        return F.lit(False)
    c = F.col(columns[0])
    low, high, below = *df.agg(F.min(c), F.max(c)).first(), 0
    while True:
        if low is None:
            return F.lit(True)
        inside = df.where(c.between(F.lit(low), F.lit(high)))
        step = (float(high) - float(low)) / few
        # Numbers that are one in double precision are told apart by themselves; there are few of them.
        bin_of = F.floor((c.cast("double") - F.lit(float(low))) / F.lit(step)) if step > 0 else c
        bins = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy("low").collect()
        for r in bins:
            if below + r["n"] >= n:
                break
            below += r["n"]
        else:
            return F.lit(True)
        low, high = r["low"], r["high"]
        if low == high:  # all of the bin are equal
            equal = c == F.lit(low)
            rest = F.lit(True) if below + r["n"] == n or len(columns) == 1 else among_first(df.where(equal), columns[1:], n - below, few)
            return (c < F.lit(low)) | (equal & rest)


def random_prune(edges: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Without round(fraction * edges) edges, those that come first by a seeded draw (60 bits of an md5)."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "src", "dst", F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long")
    drawn = edges.withColumn("_draw", draw)
    take = int(round(fraction * edges.count()))
    return drawn.where(~among_first(drawn, ["_draw", "src", "dst"], take)).drop("_draw")


def bridges(edges: DataFrame) -> DataFrame:
    """Edges (src < dst) without which their component falls apart, by one depth-first walk with low marks; the graph is checked to fit one task."""
    if edges.count() > MOST_EDGES:
        raise ValueError("the walk is sequential; the graph must fit one task")
    own = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("one", F.lit(1))

    def run(key, rows):
        beside: dict[int, list[int]] = {}
        for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True):
            beside.setdefault(a, []).append(b)
            beside.setdefault(b, []).append(a)
        number, low, found, clock = {}, {}, [], 0
        for root in sorted(beside):
            if root in number:
                continue
            stack = [(root, None, iter(sorted(beside[root])))]
            number[root] = low[root] = (clock := clock + 1)
            while stack:
                node, parent, rest = stack[-1]
                for other in rest:
                    if other not in number:
                        number[other] = low[other] = (clock := clock + 1)
                        stack.append((other, node, iter(sorted(beside[other]))))
                        break
                    if other != parent:
                        low[node] = min(low[node], number[other])
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[node])
                        if low[node] > number[parent]:
                            found.append((min(node, parent), max(node, parent)))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    return own.groupBy("one").applyInArrow(run, "src long, dst long")


def geodesic_error(graph_d: DataFrame, true_d: DataFrame, pairs: int | None = None) -> DataFrame:
    """Of pairs (src, dst, d_true) with graph distances (src, dst, d): mean and median relative error, pairs without a way or true length, rank correlation.
    With the number of all pairs, true_d needs only those that have a way."""
    both = true_d.join(graph_d, ["src", "dst"], "left").withColumn("ok", F.col("d").isNotNull() & (F.col("d") < F.lit(float("inf"))) & (F.col("d_true") >= 1e-12))
    both = cut(both.select("d", "d_true", "ok"))
    good = both.where("ok").withColumn("e", F.abs(F.col("d") - F.col("d_true")) / F.col("d_true"))
    nan = F.lit(float("nan"))
    stats = good.agg(F.coalesce(F.avg("e"), nan).alias("mean_error"), F.coalesce(F.percentile("e", 0.5), nan).alias("median_error"))
    lost = both.agg((F.count_if(~F.col("ok")) if pairs is None else F.lit(pairs) - F.count_if("ok")).alias("n_disconnected"))
    return stats.join(lost, F.lit(True)).join(spearman(good, "d", "d_true"), F.lit(True))


def shortcut_labels(edges: DataFrame, ratio: float = 0.67, stretch: float = 2.0, most: float = 100.0) -> DataFrame:
    """(src, dst, s, label) of canonical edges (src, dst, dist, r): s is the way round without the edge over the chord, at most `most`."""
    own = canonical(edges.where("src <> dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "dist", "r").groupBy("src", "dst").agg(F.avg("dist").alias("dist"), F.avg("r").alias("r"))
    graph = adjacency_of(own.select("src", "dst", "dist").union(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")))
    shared = edges.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        g = shared.value
        for batch in batches:
            out = []
            for a, b, w in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                i, j = g.place(a), g.place(b)
                d = g.dijkstra({i: 0.0}, j, skip=(i, j))[0][j]
                out.append(min(d / w, most) if w > 0 else most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "s"])

    return stream(own, run, "src long, dst long, dist double, r double, s double", rows=256).withColumn("label", (F.col("r") < ratio) & (F.col("s") > stretch))


def edge_ratios(edges: DataFrame, geodesic: DataFrame) -> DataFrame:
    """edges (src, dst, dist) with r, their length over the true distance of their ends (src, dst, d_true); 1 where that is at most 1e-12."""
    return edges.join(geodesic.select("src", "dst", "d_true"), ["src", "dst"]).withColumn("r", F.when(F.col("d_true") > 1e-12, F.col("dist") / F.col("d_true")).otherwise(F.lit(1.0))).drop("d_true")


def sample_pairs(nodes: DataFrame, n: int, seed: int = 0, draws: int = 4) -> DataFrame:
    """(src, dst), src < dst: about n distinct pairs of nodes (column id), at most all. Each node draws partners' numbers by hash, so no task sees all pairs."""
    count = nodes.count()
    n = min(n, count * (count - 1) // 2)
    if n < 1:
        return nodes.sparkSession.createDataFrame([], "src long, dst long")
    numbered = before_in_order(nodes.select("id").distinct().withColumn("_one", F.lit(1)), "id", "_one").select("id", F.col("_before").alias("number"))
    each = -(-draws * n // count)
    drawn = numbered.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws(":", "number", "k", F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long"))
    met = drawn.select("id", F.pmod("h", F.lit(count)).alias("other"), "h").join(numbered.select(F.col("id").alias("to"), F.col("number").alias("other")), "other").where("id <> to")
    pairs = met.groupBy(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst")).agg(F.min("h").alias("h"))
    return pairs.where(among_first(pairs, ["h", "src", "dst"], n)).select("src", "dst")


def select_band(pairs: DataFrame, low: float, high: float, n: int, seed: int = 0) -> DataFrame:
    """At most n of the pairs (src, dst, d_true) whose distance lies in the band, by a seeded draw."""
    inside = pairs.where(F.col("d_true").between(low, high)).withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws(":", "src", "dst", F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long"))
    return inside.where(among_first(inside, ["_h", "src", "dst"], n)).drop("_h")


def auroc_table(df: DataFrame, ratio: str, scores: dict[str, bool], grid: list[float], by: list[str]) -> DataFrame:
    """by, tau, n_pos, n_neg, frac_pos and <score>_auroc for each score (true: higher is likelier): rows with a ratio below tau are positive. Groups with one class
    drop out; scores that are null or NaN are left out for themselves."""
    rows = df.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in grid]))).withColumn("_positive", F.col(ratio) < F.col("tau"))
    keys = [*by, "tau"]
    out = rows.groupBy(*keys).agg(F.count_if("_positive").alias("n_pos"), F.count_if(~F.col("_positive")).alias("n_neg")).where("n_pos > 0 and n_neg > 0").withColumn("frac_pos", F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))
    for name, higher in scores.items():
        signed = rows.withColumn("_score", F.col(name).cast("double") * (1 if higher else -1))
        out = out.join(auroc(signed, "_score", "_positive", keys).withColumnRenamed("auroc", f"{name}_auroc"), keys, "left")
    return out


def verify_truth(truth: DataFrame, points: DataFrame, queries: DataFrame, metric: str = "euclidean", tolerance: float = 1e-6) -> DataFrame:
    """The rows of truth (qid, rank, id, dist) whose distance is not that of their query and point, or that lie nearer than the rank before."""
    both = truth.join(points.select("id", F.col("vec").alias("_x")), "id", "left").join(queries.select("qid", F.col("vec").alias("_q")), "qid", "left")
    scored = both.withColumn("found", distance("_q", "_x", metric)).withColumn("before", F.lag("dist").over(Window.partitionBy("qid").orderBy("rank")))
    wrong = F.col("found").isNull() | (F.abs(F.col("found") - F.col("dist")) > tolerance) | (F.col("dist") < F.col("before"))
    return scored.where(F.coalesce(wrong, F.lit(False))).select("qid", "rank", "id", "dist", "found")


def cluster_bootstrap(errors: DataFrame, replicate: str, value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(mean, low, high): the mean of all values, and the interval of the means of resampled replicates, whose values are pooled. NaN without rows. Only sums and counts of
    replicates are resampled: each draw takes as many replicates as there are, by a seeded hash of draw and place."""
    sums = before_in_order(errors.where(F.col(value).isNotNull()).groupBy(replicate).agg(F.sum(value).alias("s"), F.count("*").alias("n")).withColumn("_one", F.lit(1)), replicate, "_one")
    sums = sums.select("s", "n", F.col("_before").alias("at"))
    count = sums.count()
    nan = F.lit(float("nan"))
    total = sums.agg(F.coalesce(F.sum("s") / F.sum("n"), nan).alias("mean"))
    if not count:
        return total.select("mean", nan.alias("low"), nan.alias("high"))
    picks = errors.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("place"))
    picks = picks.withColumn("at", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "place", F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(count)))
    means = picks.join(sums, "at").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    ends = means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))
    return total.join(ends, F.lit(True))

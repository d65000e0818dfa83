"""Clustering, naming, outliers and layout as distributed jobs.

What reaches the driver is at most a table of micro-centroids or of clusters, whose size
is a parameter; items stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.functions.relevance import l2_normalized
from kinfolio.functions.tags import normalize_tags
from kinfolio.functions.text import STOP_WORDS, sanitize_name, title_case
from kinfolio.operators.layout import resolve_collisions
from kinfolio.operators.lists import ListIndex
from kinfolio.operators.quantiles import LARGE_GROUP, nth_smallest, percentiles
from kinfolio.operators.report import first_seen_top, first_seen_top_of_many
from kinfolio.operators.ward import cut_tree, tree, ward_labels
from kinfolio.session import cut


def centered_pca(items: DataFrame, k: int, column: str = "x", out: str = "z") -> DataFrame:
    """Adds the first ``k`` principal components of centred vectors, padded with zeros.

    A component's sign is that with which its largest loading is positive.
    """
    first = items.select(F.size(column).alias("d")).head()
    width = min(k, first.d) if first else k
    vectors = items.withColumn("_v", array_to_vector(column))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vectors)
    centred = scaler.transform(vectors)
    model = PCA(k=width, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    values = F.zip_with(vector_to_array("_p"), F.array(*(F.lit(float(x or 1.0)) for x in signs)), lambda x, y: x * y)
    padded = F.concat(values, F.array_repeat(F.lit(0.0), k - width)) if width < k else values
    return model.transform(centred).withColumn(out, padded).drop("_v", "_c", "_p")


def hierarchical(items: DataFrame, k: int, column: str = "x", micro: int | None = None, seed: int = 5) -> DataFrame:
    """``item_id, cluster_id``: Ward clusters of vectors, numbered from 0 by their smallest item.

    Exact at any size, by rounds that compare all pairs of centroids left. With ``micro``,
    a distributed KMeans first makes so many weighted centroids and Ward merges those: an
    approximation for collections that all pairs are too many for.
    """
    rows = items.select("item_id", column)
    n = rows.count()
    if n < 3:
        return rows.select("item_id", F.lit(0).cast("long").alias("cluster_id"))
    if micro is None or n <= micro:
        return contiguous(cut(cut_tree(rows, tree(rows, column), min(k, n))))
    vectors = rows.withColumn("_v", array_to_vector(column))
    model = KMeans(featuresCol="_v", predictionCol="micro", k=micro, seed=seed, maxIter=8).fit(vectors)
    placed = model.transform(vectors).select("item_id", "micro")
    sizes = {r.micro: r.n for r in placed.groupBy("micro").agg(F.count("*").alias("n")).collect()}  # at most ``micro`` rows
    centers = np.array(model.clusterCenters())
    labels = ward_labels(centers, np.array([sizes.get(i, 1) for i in range(len(centers))]), k)
    mapping = items.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(labels)], "micro int, cluster_id long")
    return placed.join(F.broadcast(mapping), "micro").select("item_id", "cluster_id")


def centroids(items: DataFrame, labels: DataFrame, column: str = "x") -> DataFrame:
    """``cluster_id, size, center``: unit mean vectors; noise (-1) is left out."""
    rows = items.join(labels, "item_id").where("cluster_id >= 0")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("size"))
    means = rows.select("cluster_id", F.posexplode(column).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg("x").alias("m"))
    center = means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("m"))
    return sizes.join(center, "cluster_id").select("cluster_id", "size", l2_normalized(F.col("m")).alias("center"))


def merge_map(table: pd.DataFrame, threshold: float = 0.9, most: int | None = None, forced: float = 0.5) -> dict[int, int]:
    """Old to new cluster ids after merging the closest pair again and again.

    Works on the cluster table (one row a cluster). Sums of unit-mean vectors would lose
    lengths, so ``center`` has to be the plain mean here.
    """
    sums = {int(r.cluster_id): np.array(r.center, dtype=float) * r.size for r in table.itertuples()}
    sizes = {int(r.cluster_id): int(r.size) for r in table.itertuples()}
    goes = {c: c for c in sums}
    while len(sums) > 1:
        ids = sorted(sums)
        unit = np.array([sums[c] / max(np.linalg.norm(sums[c]), 1e-300) for c in ids])
        cos = np.triu(unit @ unit.T, 1) + np.tril(np.full((len(ids), len(ids)), -2.0))
        i, j = np.unravel_index(np.argmax(cos), cos.shape)
        if cos[i, j] < threshold and not (most is not None and len(ids) > most and cos[i, j] >= forced):
            break
        a, b = ids[i], ids[j]
        keep, drop = (a, b) if sizes[a] >= sizes[b] else (b, a)
        sums[keep] += sums.pop(drop)
        sizes[keep] += sizes.pop(drop)
        goes = {c: keep if g == drop else g for c, g in goes.items()}
    order = {c: i for i, c in enumerate(sorted(sums))}
    return {c: order[g] for c, g in goes.items()}


def merged(items: DataFrame, labels: DataFrame, column: str = "x", threshold: float = 0.9, most: int | None = None, forced: float = 0.5) -> DataFrame:
    """Labels after merging clusters with similar centroids, numbered from 0; noise stays -1."""
    rows = items.join(labels, "item_id").where("cluster_id >= 0")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("size"))
    means = rows.select("cluster_id", F.posexplode(column).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg("x").alias("m"))
    center = means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("center"))
    goes = merge_map(sizes.join(center, "cluster_id").toPandas(), threshold, most, forced)
    mapping = items.sparkSession.createDataFrame([*goes.items(), (-1, -1)], "cluster_id long, new long")
    return labels.join(F.broadcast(mapping), "cluster_id").select("item_id", F.col("new").alias("cluster_id"))


def contiguous(labels: DataFrame) -> DataFrame:
    """Labels numbered 0, 1, ... in their order; -1 stays. The order is over the distinct labels."""
    ids = labels.select("cluster_id").where("cluster_id <> -1").distinct()
    ids = ids.withColumn("new", (F.row_number().over(W.orderBy("cluster_id")) - 1).cast("long"))
    return labels.join(ids, "cluster_id", "left").select("item_id", F.coalesce("new", F.lit(-1)).cast("long").alias("cluster_id"))


def outlier_scores(items: DataFrame, labels: DataFrame, column: str = "x", least: int = 8, large: int = LARGE_GROUP) -> DataFrame:
    """``item_id, cluster_id, score``: distance to the cluster's mean in MADs above its median.

    With a cluster of more than ``large`` items, medians are found by refined histograms.
    """
    rows = items.select("item_id", column).join(labels.where("cluster_id <> -1"), "item_id")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    means = rows.select("cluster_id", F.posexplode(column).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg("x").alias("m"))
    center = means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("center"))
    gap = F.aggregate(F.zip_with(column, "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = cut(rows.join(center, "cluster_id").join(sizes, "cluster_id", "left_semi").select("item_id", "cluster_id", F.sqrt(gap).alias("dist")))
    median = percentiles(near, "cluster_id", "dist", 0.5, "median", large)
    off = near.join(median, "cluster_id").withColumn("off", F.abs(F.col("dist") - F.col("median")))
    mad = percentiles(off, "cluster_id", "off", 0.5, "mad", large)
    return off.join(mad, "cluster_id").select("item_id", "cluster_id", ((F.col("dist") - F.col("median")) / (F.col("mad") + 1e-6)).alias("score"))


def mark_outliers(items: DataFrame, labels: DataFrame, column: str = "x", limit: float = 3.5, ratio: float = 0.15) -> DataFrame:
    """Labels with the worst outliers as -1: those beyond the limit, at most a share of all items."""
    scores = cut(outlier_scores(items, labels, column).where(F.col("score") > limit))
    total = labels.count()
    found = scores.count()
    most = int(max(1, min(found, total * ratio)))
    worst = scores
    if found > most:
        # The least score that still goes, and where it is shared, the least item of those.
        edge = nth_smallest(scores, "score", found - most)
        tied = scores.where(F.col("score") == edge)
        stay = tied.count() + scores.where(F.col("score") > edge).count() - most
        first = nth_smallest(tied, "item_id", stay)
        worst = scores.where((F.col("score") > edge) | ((F.col("score") == edge) & (F.col("item_id") >= first)))
    worst = worst.select("item_id", F.lit(True).alias("out"))
    return labels.join(worst, "item_id", "left").select("item_id", F.when(F.col("out"), F.lit(-1)).otherwise(F.col("cluster_id")).cast("long").alias("cluster_id"))


def topic_and_word_counts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Top 5 normalised topics and top 3 description words of each cluster, ties by first appearance.

    Appearance is by falling stars, then full name, then place.
    """
    order = F.struct((-F.col("stars")).alias("s"), "full_name", "item_id", "pos").alias("seen")
    topics = items.select("cluster_id", "stars", "full_name", "item_id", F.posexplode(normalize_tags(F.col("topics"))).alias("pos", "value"))
    text = F.split(F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    words = items.select("cluster_id", "stars", "full_name", "item_id", F.posexplode(text).alias("pos", "value"))
    words = words.where((F.length("value") > 2) & ~F.col("value").isin(STOP_WORDS))
    return first_seen_top(topics.select("cluster_id", "value", order), 5, "cluster_id"), first_seen_top_of_many(words.select("cluster_id", "value", order), 3, "cluster_id")


def heuristic_names(items: DataFrame) -> DataFrame:
    """``cluster_id, item_count, name, description, keywords`` from topics and description words."""
    topics, words = topic_and_word_counts(items)
    ranked = lambda df, name: df.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias(name)
    )
    empty = F.array().cast("array<string>")
    sizes = items.groupBy("cluster_id").agg(F.count("*").alias("item_count"))
    out = sizes.join(ranked(topics, "t"), "cluster_id", "left").join(ranked(words, "w"), "cluster_id", "left")
    out = out.withColumns({"t": F.coalesce("t", empty), "w": F.coalesce("w", empty)})
    n = F.col("item_count").cast("string")
    raw = (
        F.when(F.size("t") > 0, title_case(F.array_join(F.slice("t", 1, 2), " / ")))
        .when(F.size("w") > 0, title_case(F.array_join(F.slice("w", 1, 2), " ")))
        .otherwise(F.concat(F.lit("Cluster ("), n, F.lit(" repos)")))
    )
    about = F.when(F.size("t") > 0, F.concat(F.lit(" related to "), F.array_join(F.slice("t", 1, 3), ", "))).otherwise("")
    description = F.concat(F.lit("A cluster of "), n, F.lit(" repositories"), about)
    return out.select("cluster_id", "item_count", sanitize_name(raw).alias("name"), description.alias("description"), F.array_distinct(F.concat("t", "w")).alias("keywords"))


def unique_names(clusters: DataFrame) -> DataFrame:
    """Clusters with distinct names: the largest keeps a name, others get a keyword and then a number.

    Works on the cluster table, which has one row a cluster.
    """
    def run(_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        pdf = pdf.sort_values(["item_count", "cluster_id"], ascending=[False, True], kind="stable")
        names = []
        for r in pdf.itertuples():
            name = r.name
            if name in used:
                words = [k for k in (r.keywords if r.keywords is not None else []) if k]
                suffix = (words[0] if words else str(r.item_count)).replace(" ", "")[:12]
                name = base = f"{r.name} · {suffix}"
                n = 2
                while name in used:
                    name = f"{base}{n}"
                    n += 1
            used.add(name)
            names.append(name)
        return pdf.assign(name=names)[["cluster_id", "name", "item_count"]]

    rows = clusters.select("cluster_id", sanitize_name(F.col("name")).alias("name"), "keywords", F.col("item_count").cast("long").alias("item_count"))
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "cluster_id long, name string, item_count long")


def cluster_context(items: DataFrame) -> DataFrame:
    """Per cluster: 10 most starred names, up to 20 topics and the languages, by count and name."""
    best = W.partitionBy("cluster_id").orderBy(F.desc("stars"), "item_id")
    names = items.withColumn("rank", F.row_number().over(best)).where("rank <= 10").select("cluster_id", "rank", F.col("full_name").alias("value"))

    def top(value, limit):
        counted = items.select("cluster_id", value.alias("value")).where("value is not null").groupBy("cluster_id", "value").agg(F.count("*").alias("n"))
        order = W.partitionBy("cluster_id").orderBy(F.desc("n"), "value")
        return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    out = items.select("cluster_id").distinct()
    for name, rows in (("top_items", names), ("topics", top(F.explode("topics"), 20)), ("languages", top(F.col("language"), 1000))):
        listed = rows.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias(name))
        out = out.join(listed, "cluster_id", "left")
    return out


def assign_incrementally(new: DataFrame, existing: DataFrame, k: int = 5, noise: float = 0.15, candidates: str | ListIndex = "exact") -> DataFrame:
    """Place new items by their ``k`` nearest: the nearest one's cluster, and the weighted mean of coordinates.

    Noise is drawn from the item's hash, so a retried task places an item as before.
    """
    from kinfolio.operators.pairs import knn

    near = knn(new, existing, k, candidates)
    known = existing.select(F.col("item_id").alias("target"), "cluster_id", "x", "y", "z")
    weight = F.greatest(F.lit(0.01), F.least(F.lit(1.0), "semantic"))
    met = near.join(known, "target").withColumn("w", weight)
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    out = met.groupBy(F.col("source").alias("item_id")).agg(F.min_by("cluster_id", "rank").alias("cluster_id"), *(mean(c).alias(c) for c in "xyz"))
    uniform = lambda c, i: (F.pmod(F.xxhash64("item_id", F.lit(f"{c}{i}")), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = lambda c: F.sqrt(-2 * F.log(uniform(c, 0))) * F.cos(2 * np.pi * uniform(c, 1))
    return out.withColumns({c: F.col(c) + noise * normal(c) for c in "xyz"}) if noise else out


def cluster_hulls(points: DataFrame) -> DataFrame:
    """``cluster_id, pos, x, y``: the corners of each cluster's convex hull, counter-clockwise.

    A point inside the hull of its own batch can't be a corner, so each task sends only
    its batches' hulls on, and one small group a cluster is left.
    """
    def hull(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) <= 2:
            return p

        def chain(q):
            out: list = []
            for x in q:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(x)
            return out[:-1]

        return np.array(chain(p) + chain(p[::-1]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, g in pdf.groupby("cluster_id"):
                h = hull(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({"cluster_id": c, "x": h[:, 0], "y": h[:, 1]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[0], "pos": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    rows = points.select(F.col("cluster_id").cast("long").alias("cluster_id"), "x", "y").where("cluster_id is not null and x is not null and y is not null")
    few = rows.mapInPandas(partial, "cluster_id long, x double, y double")
    return few.groupBy("cluster_id").applyInPandas(final, "cluster_id long, pos long, x double, y double")


def cluster_centers(placed: DataFrame) -> DataFrame:
    """``cluster_id, center_x, center_y, center_z``: mean coordinates of each cluster; noise (below 0) is left out."""
    return placed.where("cluster_id >= 0").groupBy("cluster_id").agg(*(F.avg(c).alias(f"center_{c}") for c in "xyz"))


def naming_order(items: DataFrame, most: int | None = None) -> DataFrame:
    """``cluster_id, item_id, full_name, rank``: the order in which a cluster's items name it, by falling stars, name and id."""
    order = W.partitionBy("cluster_id").orderBy(F.desc("stars"), "full_name", "item_id")
    ranked = items.select("cluster_id", "item_id", "full_name", F.row_number().over(order).alias("rank"))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def build_clusters(items: DataFrame, k: int | None = None, least: int | None = 3, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The whole job: unit vectors, PCA, Ward, merging, outliers, layout and names.

    Returns ``item_id, cluster_id, x, y, z, size`` and the cluster table. The bounds wanted
    are made fit by :func:`cluster_params`; if outliers and merging leave fewer clusters than
    its least number, Ward alone makes that many.
    """
    from kinfolio.functions.numbers import cluster_params, layout_size

    rows = cut(items.where("embedding is not null").select("item_id", l2_normalized(F.col("embedding")).alias("x")))
    n = rows.count()
    wanted = cluster_params(F.lit(n), F.lit(most), F.lit(least).cast("long"))
    bounds = items.sparkSession.range(1).select(wanted.alias("p")).select("p.*").first()
    least, most = bounds.min_clusters, bounds.target_max_clusters
    k = k or min(max(least, min(int(n**0.5), 20)), max(n, 1))
    features = cut(centered_pca(rows.select("item_id", "x"), 30).select("item_id", F.col("z").alias("x")))
    labels = hierarchical(features, min(k, n))
    labels = cut(mark_outliers(features, merged(rows, labels, most=most)))
    if labels.where("cluster_id >= 0").select("cluster_id").distinct().count() < min(least, n):
        labels = cut(contiguous(hierarchical(features, min(least, n))))
    flat = centered_pca(rows.select("item_id", "x"), 3).select("item_id", *((F.col("z")[i] * 2.0).alias(c) for i, c in enumerate("xyz")))
    sized = flat.join(items.select("item_id", layout_size(F.col("stars")).alias("size")), "item_id")
    placed = resolve_collisions(sized)
    # Cut off here: names are read twice, and they come from all texts.
    named = cut(heuristic_names(items.drop("cluster_id").join(labels.where("cluster_id >= 0"), "item_id")))
    out = placed.join(labels, "item_id")
    table = named.drop("name").join(unique_names(named).select("cluster_id", "name"), "cluster_id").join(cluster_centers(out), "cluster_id")
    return out, table

"""What charts and tables show: labels, filters, ranks and scales, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from aptaforge.operators.ranges import join_on, positions

# The score above which a clustering counts as strong and as moderate, by criterion; silhouettes count from the bound on.
QUALITY = {"silhouette": (0.5, 0.25), "davies_bouldin": (-1.0, -2.0), "calinski_harabasz": (10.0, 5.0)}


def quality_label(score: Column, criterion: str = "silhouette") -> Column:
    strong, moderate = QUALITY[criterion]
    over = (lambda x: score >= x) if criterion == "silhouette" else (lambda x: score > x)
    return F.when(over(strong), "strong").when(over(moderate), "moderate").otherwise("weak")


def cluster_filter(clusters: DataFrame, which: str) -> DataFrame:
    """Clusters (size, passes, mfe) of several members (``multi``), two passed scores (``g4pos``) or an energy of -5 and below (``stable``)."""
    keep = {"all": F.lit(True), "multi": F.col("size") > 1, "g4pos": F.col("passes") >= 2, "stable": F.col("mfe") <= -5}[which]
    return clusters.filter(keep)


def z_ranked(clusters: DataFrame, z: str = "z", key: str = "cluster_id") -> DataFrame:
    """``clusters`` plus z_rank by falling z; those without one come last."""
    return positions(clusters, [], [f"-{z}", key], "z_rank", "z-ranks")


def remapped(clusters: DataFrame, *stats: DataFrame, z: str = "z", key: str = "cluster_id") -> DataFrame:
    """Clusters under new ids by falling z, with what ``stats`` (keyed by the old id) say of them; those they leave out keep nulls."""
    out = z_ranked(clusters, z, key)
    for s in stats:
        out = join_on(out, s, [key], "left")
    return out.withColumnRenamed(key, "old_id").withColumnRenamed("z_rank", key)


def best_setting(scores: DataFrame, score: str = "silhouette") -> DataFrame:
    """(method, points, full_scan, best_k, best_score, is_best) of search scores (method, k, score): six points make a full scan; the smaller k wins ties."""
    first = F.max(F.struct(F.col(score).alias("s"), (-F.col("k")).alias("k")))
    out = scores.filter(F.col(score).isNotNull()).groupBy("method").agg(F.count("*").alias("points"), first.alias("b"))
    top = out.agg(F.max(F.struct("b", F.col("method").alias("m"))).alias("top"))
    out = out.join(F.broadcast(top))  # one row
    return out.select("method", "points", (F.col("points") >= 6).alias("full_scan"), (-F.col("b.k")).alias("best_k"), F.col("b.s").alias("best_score"), (F.col("method") == F.col("top.m")).alias("is_best"))


def visible(clusters: DataFrame, most: int, rank: str = "z_rank") -> DataFrame:
    """The first ``most`` clusters; all for 0."""
    return clusters.filter(F.col(rank) <= most) if most else clusters


def silhouette_bars(scores: DataFrame) -> DataFrame:
    """``scores`` (id, cluster, silhouette) plus bar, the place within the cluster, best first."""
    return positions(scores, ["cluster"], ["-silhouette", "id"], "bar", "bars")


def edge_width(similarity: Column) -> Column:
    """0.8 at a similarity of 0.7, rising to 2.3 at 1; none below."""
    return F.when(similarity >= 0.7, 0.8 + F.least((similarity - 0.7) / 0.3, F.lit(1.0)) * 1.5)


def cluster_hue(index: Column) -> Column:
    """(hue, lightness, chroma) by golden-angle steps from a 0-based index."""
    hue = F.round((index * 137.508) % 360, 1)
    return F.struct(hue.alias("hue"), F.when(index % 2 == 0, 0.58).otherwise(0.72).alias("lightness"), F.when(index % 3 == 0, 0.26).otherwise(0.22).alias("chroma"))


def shape_index(cluster_id: Column, shapes: int = 5) -> Column:
    """Shapes change every five clusters."""
    return F.pmod(F.floor((cluster_id - 1) / 5), F.lit(shapes)).cast("int")


def palette_index(cluster_id: Column, colours: int) -> Column:
    return F.pmod(cluster_id - 1, F.lit(colours)).cast("int")


def bubble_label(cluster_id: Column, size: Column, risk: Column, motif: Column) -> Column:
    tail = F.when(F.coalesce(motif, F.lit("")) != "", F.concat(F.lit(", "), motif, F.lit(" motif"))).otherwise("")
    text = lambda c: c.cast("string")
    return F.concat(F.lit("Cluster "), text(cluster_id), F.lit(" ("), text(size), F.lit(" members, "), F.coalesce(risk, F.lit("Low")), F.lit(" G4"), tail, F.lit(")"))


def thinned(values: Column, most: int = 200) -> Column:
    """Every n-th of an array's values, n = max(1, floor(size / most))."""
    step = F.greatest(F.lit(1), F.floor(F.size(values) / most).cast("int"))
    return F.filter(values, lambda x, i: i % step == 0)


def strided_sample(nodes: DataFrame, per_cluster: int = 200, most: int = 2000) -> DataFrame:
    """Nodes (id, cluster) without reads: every n-th of each cluster's ids, then every n-th of what is left."""
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("_n"))
    ranked = positions(nodes, ["cluster"], ["id"], "_i", "strides", sizes).withColumn("_i", F.col("_i") - 1)
    step = F.when(F.col("_n") > per_cluster, F.greatest(F.lit(1), F.floor(F.col("_n") / per_cluster))).otherwise(F.lit(1))
    kept = ranked.filter((F.col("_i") % step == 0) & (F.col("_i") < per_cluster * step)).drop("_i", "_n")
    n = kept.count()
    if n <= most:
        return kept
    stride = max(1, n // most)
    placed = positions(kept, [], ["cluster", "id"], "_i", "strided").withColumn("_i", F.col("_i") - 1)
    return placed.filter((F.col("_i") % stride == 0) & (F.col("_i") < most * stride)).drop("_i")


def size_distribution(clusters: DataFrame) -> DataFrame:
    """(size, risk, n) of clusters (size, passes)."""
    risk = F.when(F.col("passes") >= 2, "High").when(F.col("passes") == 1, "Medium").otherwise("Low")
    return clusters.groupBy("size", risk.alias("risk")).agg(F.count("*").alias("n"))

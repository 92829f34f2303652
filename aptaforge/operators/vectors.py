"""Cluster validation on vectors by cosine algebra: sums of unit vectors replace pairwise matrices.

``vecs``: id, v (array of double, all of one length), cluster. Arrow batches are reduced to one sum for each cluster that they
hold; the sums of all batches meet in a long-form aggregation, so no task gathers a cluster. The table of sums (clusters times
dimensions) is broadcast up to ``BROADCAST_BYTES``; beyond, it is cut into blocks of clusters, and every row meets every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from aptaforge.operators.ranges import materialize, positions

BROADCAST_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1 if len(column) else 0)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 0))


def cluster_sums(vecs: DataFrame, unit: bool = False) -> DataFrame:
    """(cluster, n, total, squares): size, vector sum and sum of squared norms of ``v``, of its unit vectors with ``unit``."""
    kind = vecs.schema["cluster"].dataType
    schema = StructType([StructField("cluster", kind), StructField("n", LongType()), StructField("total", ArrayType(DoubleType())), StructField("squares", DoubleType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            x = units(x) if unit else x
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            sums = np.add.reduceat(x[order], starts, axis=0)
            squares = np.add.reduceat((x[order] ** 2).sum(1), starts)
            size = np.diff(np.r_[starts, len(code)])
            held = names.dictionary.take(pa.array(code[order][starts]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * x.shape[1], pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([held, pa.array(size, pa.int64()), lists, pa.array(squares)], names=["cluster", "n", "total", "squares"])

    parts = vecs.select("cluster", "v").mapInArrow(partial, schema)
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    sums = parts.select("cluster", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"))
    both = sizes.withColumnRenamed("cluster", "_c").join(sums, F.col("_c").eqNullSafe(F.col("cluster")))
    return both.select("cluster", "n", "total", "squares")


def against(rows: DataFrame, table: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: StructType | str) -> tuple[DataFrame, bool]:
    """``fn`` of batches of ``rows`` and ``table`` (cluster, total, and more), and whether it saw the table in blocks, so that a row has a result for each.

    The table's bytes are computed first: it is broadcast if they are few, and else joined block by block, in salted groups of rows.
    """
    table = materialize(table, "cluster-table")
    n, width = table.agg(F.count("*"), F.max(F.size("total"))).first()
    size = (n or 0) * 8 * ((width or 0) + 8)
    if size <= BROADCAST_BYTES:
        held = rows.sparkSession.sparkContext.broadcast(table.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield fn(pdf, held.value)

        return rows.mapInPandas(run, schema), False
    blocks = -(-size // BROADCAST_BYTES)
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    numbered = positions(table, [], ["cluster"], "_block", "cluster-blocks").withColumn("_block", (F.col("_block") % blocks).cast("int"))
    right = numbered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("id", "cluster")]), F.lit(salts)).cast("int"))
    left = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.drop(columns=["_salt", "_block"]), b.drop(columns=["_salt", "_block"])
        parts = [fn(a[i : i + 10_000], b) for i in range(0, len(a), 10_000)] if len(b) else []
        return pd.concat(parts) if parts else fn(a[:0], b)

    return left.groupBy("_block", "_salt").cogroup(right.groupBy("_block", "_salt")).applyInPandas(pair, schema), True


def typed(schema: str, vecs: DataFrame, *names: str) -> StructType:
    """A schema whose columns ``names`` have the type of the clusters."""
    out = StructType.fromDDL(schema)
    return StructType([StructField(f.name, vecs.schema["cluster"].dataType if f.name in names else f.dataType) for f in out])


def compactness(vecs: DataFrame) -> DataFrame:
    """(cluster, observed): mean of the full cosine matrix of each cluster, which is |S|^2 / n^2."""
    s = cluster_sums(vecs, unit=True)
    return s.select("cluster", (dot(F.col("total"), F.col("total")) / (F.col("n") * F.col("n"))).alias("observed"))


def cluster_distances(vecs: DataFrame, order: str | None = None) -> DataFrame:
    """(a, b, distance): mean cosine distance between clusters, and within (over pairs; 0 for one row).

    Clusters pair as a <= b; with ``order``, a column of the rows' places, in the order in which they are first seen.
    """
    s = cluster_sums(vecs, unit=True)
    if order:
        seen = first_seen(vecs, order).select(F.col("cluster").alias("_c"), "place")
        s = s.join(seen, F.col("cluster").eqNullSafe(F.col("_c"))).drop("_c")
    else:
        s = s.withColumn("place", F.lit(0).cast("long"))

    def gaps(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        inner = stacked(rows["total"]) @ stacked(table["total"]).T
        n, m = rows["n"].to_numpy(dtype=float), table["n"].to_numpy(dtype=float)
        a, b = rows["cluster"].to_numpy()[:, None], table["cluster"].to_numpy()[None]
        own = a == b
        within = 1 - np.divide(np.diag(stacked(rows["total"]) @ stacked(rows["total"]).T) - rows["squares"].to_numpy(), n * (n - 1), out=np.ones(len(n)), where=n > 1)
        d = np.where(own, within[:, None], 1 - inner / (n[:, None] * m))
        before = rows["place"].to_numpy()[:, None] < table["place"].to_numpy()[None] if order else a < b
        i, j = np.nonzero(own | before)
        return pd.DataFrame({"a": a[i, 0], "b": b[0, j], "distance": d[i, j]})

    return against(s, s, gaps, typed("a int, b int, distance double", vecs, "a", "b"))[0]


def first_seen(rows: DataFrame, order: str = "id") -> DataFrame:
    """(cluster, place): clusters from 1 in the order of their first row by ``order``, ties by cluster."""
    firsts = rows.groupBy("cluster").agg(F.min(order).alias("_first"))
    return positions(firsts, [], ["_first", "cluster"], "place", "first-seen").drop("_first")


def cosine_silhouette(vecs: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) without a pairwise matrix; rows alone in their cluster have 0; no rows for a single cluster."""

    def scores(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        u, n = units(stacked(rows["v"])), table["n"].to_numpy(dtype=float)
        dots = u @ stacked(table["total"]).T if len(table) else np.zeros((len(u), 0))
        own = rows["cluster"].to_numpy()[:, None] == table["cluster"].to_numpy()[None]
        far = np.where(own, np.inf, 1 - dots / n)
        mine = own.any(1)
        return pd.DataFrame({
            "id": rows["id"], "cluster": rows["cluster"], "uu": (u * u).sum(1), "n": np.where(mine, (own * n).sum(1), np.nan), "own": np.where(mine, np.where(own, dots, 0).sum(1), np.nan),
            "b": far.min(1, initial=np.inf),
        })

    out, blocks = against(vecs.select("id", "v", "cluster"), cluster_sums(vecs, unit=True), scores, typed("id long, cluster int, uu double, n double, own double, b double", vecs, "cluster"))
    if blocks:
        best = [F.max(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in ("n", "own")]
        out = out.groupBy("id", "cluster").agg(F.max("uu").alias("uu"), *best, F.min("b").alias("b"))
    out = out.filter(F.col("b") < float("inf"))
    a = ((F.col("n") - F.col("own")) - (1 - F.col("uu"))) / (F.col("n") - 1)
    wide = F.greatest(a, F.col("b"))
    return out.select("id", "cluster", F.when((F.col("n") > 1) & (wide > 0), (F.col("b") - a) / wide).otherwise(0.0).alias("silhouette"))


def nearest_centroid(vecs: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, nearest, similarity) by cosine; ``centroids``: cluster, n, total. Ties go to the smallest cluster."""

    def best(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("cluster")
        s = units(stacked(rows["v"])) @ units(stacked(table["total"])).T
        at = s.argmax(1)
        return pd.DataFrame({"id": rows["id"], "nearest": table["cluster"].to_numpy()[at], "similarity": s[np.arange(len(s)), at]})

    out, blocks = against(vecs.select("id", "v"), centroids, best, typed("id long, nearest int, similarity double", centroids, "nearest"))
    if blocks:
        first = F.min(F.struct((-F.col("similarity")).alias("s"), "nearest"))
        out = out.groupBy("id").agg(first.alias("f")).select("id", "f.nearest", (-F.col("f.s")).alias("similarity"))
    return out


def spread_scores(vecs: DataFrame) -> DataFrame:
    """One row: davies_bouldin and calinski_harabasz, Euclidean, in two passes over the vectors; null for fewer than two clusters."""
    sums = materialize(cluster_sums(vecs), "cluster-sums")

    def off_centre(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        place = pd.Series(np.arange(len(table)), index=table["cluster"])
        at = place.reindex(rows["cluster"]).to_numpy()
        known = ~np.isnan(at)
        at = at[known].astype(int)
        centre = stacked(table["total"]) / table["n"].to_numpy()[:, None]
        gap = np.linalg.norm(stacked(rows["v"][known]) - centre[at], axis=1) if len(at) else np.zeros(0)
        got = pd.DataFrame({"cluster": rows["cluster"][known], "s": gap}).groupby("cluster", as_index=False, dropna=False)["s"].sum()
        return got

    scatter = against(vecs.select("cluster", "v"), sums, off_centre, typed("cluster int, s double", vecs, "cluster"))[0].groupBy(F.col("cluster").alias("_c")).agg(F.sum("s").alias("s"))
    full = sums.join(scatter, F.col("cluster").eqNullSafe(F.col("_c"))).withColumn("s", F.col("s") / F.col("n")).drop("_c")

    def worst(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        c, d = (stacked(t["total"]) / t["n"].to_numpy()[:, None] for t in (rows, table))
        gap = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (d * d).sum(1) - 2 * c @ d.T, 0))
        ratio = np.divide(rows["s"].to_numpy()[:, None] + table["s"].to_numpy()[None], gap, out=np.full(gap.shape, -np.inf), where=rows["cluster"].to_numpy()[:, None] != table["cluster"].to_numpy()[None])
        return pd.DataFrame({"cluster": rows["cluster"], "r": ratio.max(1, initial=-np.inf)})

    ratios = against(full, full, worst, typed("cluster int, r double", vecs, "cluster"))[0].groupBy("cluster").agg(F.max("r").alias("r"))
    db = ratios.agg(F.avg("r").alias("davies_bouldin"), F.count("*").alias("k"))
    long = sums.select(F.posexplode("total").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    mean = long.agg(F.sum(F.col("x") * F.col("x")).alias("all2"))
    parts = sums.agg(F.sum("n").alias("n"), F.sum("squares").alias("q"), F.sum(dot(F.col("total"), F.col("total")) / F.col("n")).alias("c2"))
    one = parts.join(F.broadcast(mean)).join(F.broadcast(db))  # one row each
    ch = (F.col("c2") - F.col("all2") / F.col("n")) / (F.col("k") - 1) / ((F.col("q") - F.col("c2")) / (F.col("n") - F.col("k")))
    several = F.col("k") > 1
    return one.select(F.when(several, F.col("davies_bouldin")).alias("davies_bouldin"), F.when(several & (F.col("n") > F.col("k")), ch).alias("calinski_harabasz"))


def balanced_sample(nodes: DataFrame, per_cluster: int = 200, most: int = 2000) -> DataFrame:
    """The most read ``per_cluster`` nodes (id, cluster, reads) of each cluster, then the most read ``most``."""
    by = Window.partitionBy("cluster").orderBy(F.col("reads").desc(), "id")  # limited before the shuffle, as only the first ranks are asked for
    kept = nodes.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= per_cluster).drop("_rank")
    return kept.orderBy(F.col("reads").desc(), "id").limit(most)


def cosine_edges(vecs: DataFrame, threshold: float = 0.7, per_node: int = 8) -> DataFrame:
    """(source, target, similarity): each node's ``per_node`` most similar at ``threshold`` or above, undirected.

    Rows meet in blocks: every block of ids is compared with every other by one matrix product in a
    worker, and only edges leave it. The blocks' number grows with the rows, a block's size does not.
    """
    n_blocks = max(1, -(-vecs.count() // 1000))
    base = vecs.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    pairs = base.select("id", "v", "block", F.explode(others).alias("o")).withColumn("p", F.least("block", "o") * n_blocks + F.greatest("block", "o"))

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        x = units(stacked(pdf["v"]))
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        ids, block = pdf["id"].to_numpy(), pdf["block"].to_numpy()
        if len(set(block)) > 1:
            sim[block[:, None] == block[None, :]] = -2
        i, j = np.nonzero(sim >= threshold)
        return pd.DataFrame({"i": ids[i], "j": ids[j], "similarity": sim[i, j]})

    directed = pairs.groupBy("p").applyInPandas(edges, "i long, j long, similarity double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.round("similarity", 9).desc(), "j"))
    kept = directed.withColumn("_rank", rank).filter(F.col("_rank") <= per_node)
    return kept.groupBy(F.least("i", "j").alias("source"), F.greatest("i", "j").alias("target")).agg(F.max("similarity").alias("similarity"))

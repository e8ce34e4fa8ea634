"""K-means on the healthy rows: distortion by k, cluster labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import clean
from panelspark.schema import MISSING_CONTINUOUS
from panelspark.session import materialize


def _distance(point: Column, center: Sequence[float]) -> Column:
    parts = F.zip_with(point, F.array(*[F.lit(float(x)) for x in center]), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def nearest_center(df: DataFrame, point: str, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``cluster_label`` and ``distance`` of the closest of a few given centres."""
    options = F.array(*[F.struct(_distance(F.col(point), c).alias("distance"), F.lit(i).alias("label")) for i, c in enumerate(centers)])
    best = df.withColumn("__best", F.array_min(options))
    return best.select(*df.columns, F.col("__best.label").alias("cluster_label"), F.col("__best.distance").alias("distance"))


def _point(columns: Sequence[str]) -> Column:
    """The columns as an array, missing values at the constant for missing sensors."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(MISSING_CONTINUOUS)) for c in columns])


def fit_centers(
    df: DataFrame, columns: Sequence[str], k: int, seed: int = 1, rounds: int = 20, weight: str | None = None, starts: int = 1
) -> list[list[float]]:
    """Centres of k clusters, the best of several ``starts``; a single cluster has its centre at the mean.
    ``weight``: column with row weights."""
    filled = clean.fill_constant(df, continuous=columns)
    if k == 1:
        w = F.col(weight) if weight else F.lit(1.0)
        row = filled.agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in columns]).first()
        return [[row[c] for c in columns]]
    own = [*columns, weight] if weight else list(columns)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled.select(*own))
    means = KMeans(k=k, maxIter=rounds, initMode="k-means||")
    means = means.setWeightCol(weight) if weight else means
    fits = [means.setSeed(seed + i).fit(vectors.drop(*columns)) for i in range(starts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def coreset(df: DataFrame, columns: Sequence[str], size: int = 20_000, seed: int = 1, weight: str = "weight") -> DataFrame:
    """At most about ``size`` weighted rows that stand for all of them, for any number of clusters.

    Equal rows are folded. A row is drawn with a chance of half its share of the rows and half its share of the
    squared distances to the mean, by a hash of its values, and weighs the inverse of it, so that for any centres
    the weighted sum of squared distances is right in the mean, and far rows, which decide it, are seldom left out
    (lightweight coresets). Up to ``size`` different rows nothing is left out. Missing values are filled first.
    """
    filled = clean.fill_constant(df.select(*columns), continuous=columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    folded = materialize(filled.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")), "folded")
    n = F.sum("__n")
    row = folded.agg(
        n.alias("n"), F.count(F.lit(1)).alias("__different"), *[(F.sum(F.col(c) * F.col("__n")) / n).alias(c) for c in columns]
    ).first()
    if row["__different"] <= size:
        return folded.withColumnRenamed("__n", weight).withColumn(weight, F.col(weight).cast("double"))
    spread = sum(((F.col(c) - F.lit(row[c])) * (F.col(c) - F.lit(row[c])) for c in columns), F.lit(0.0))
    total = folded.agg(F.sum(spread * F.col("__n"))).first()[0]
    share = F.col("__n") / F.lit(2.0 * row["n"]) + spread * F.col("__n") / F.lit(2.0 * max(total, 1e-300))
    drawn = folded.withColumn("__chance", F.least(F.lit(1.0), F.lit(float(size)) * share))
    spot = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return drawn.filter(spot < F.col("__chance")).select(*columns, (F.col("__n") / F.col("__chance")).alias(weight))


def kmeans_elbow(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(1, 10), seed: int = 1, rounds: int = 20, size: int = 20_000, starts: int = 2
) -> DataFrame:
    """Mean distance of the healthy rows to their closest centre, for each number of clusters.

    All numbers are fitted on one :func:`coreset` of ``size`` rows, each from several ``starts``; a single cluster has the mean of all
    rows, and the distances are measured over all rows in one pass.
    """
    normal = df.filter(F.col("tag") == 0).select(*columns)
    points = normal.select(_point(columns).alias("__point"))
    small = materialize(coreset(normal, columns, size, seed), "coreset")
    centers = {k: fit_centers(normal, columns, 1) if k == 1 else fit_centers(small, columns, k, seed, rounds, "weight", starts) for k in ks}
    nearest = [F.array_min(F.array(*[_distance(F.col("__point"), c) for c in cs])) for cs in centers.values()]
    # One pass measures all of them.
    wide = points.agg(F.array(*[F.avg(d) for d in nearest]).alias("d"))
    names = F.array(*[F.lit(k) for k in centers])
    return wide.select(F.explode(F.arrays_zip(names.alias("k"), F.col("d").alias("distortion"))).alias("e")).select("e.k", "e.distortion")


def attach_cluster_label(df: DataFrame, columns: Sequence[str], centers: Sequence[Sequence[float]]) -> DataFrame:
    """Healthy rows with their cluster, faulty rows without one. One pass, no join."""
    placed = nearest_center(df.withColumn("__point", _point(columns)), "__point", centers)
    healthy = F.when(F.col("tag") == 0, F.col("cluster_label"))
    return placed.select(*df.columns, healthy.alias("cluster_label"))

"""Classes of scores."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classify(scores: DataFrame, score: str = "score", method: str = "kmeans", classes: int = 3, into: str = "cluster", seed: int = 42) -> DataFrame:
    """scores with a class from 0 up by the mean score of classes, -1 where the score is null. kmeans, gmm, or mean
    (1 above the mean)."""
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    if method == "mean":
        m = scores.where(ok).agg(F.avg(score).alias("_m"))
        return scores.join(F.broadcast(m)).withColumn(into, F.when(ok, (F.col(score) > F.col("_m")).cast("int")).otherwise(-1)).drop("_m")
    if method == "hdbscan":
        raise ImportError("hdbscan isn't part of this engine, as Spark has no density clustering; take 'kmeans', 'gmm' or 'mean'")
    if method not in ("kmeans", "gmm"):
        raise ValueError("method is 'kmeans', 'gmm' or 'mean'")
    x = VectorAssembler(inputCols=[score], outputCol="_x", handleInvalid="skip")
    known = x.transform(scores.where(ok))
    model = (KMeans if method == "kmeans" else GaussianMixture)(k=classes, seed=seed, featuresCol="_x", predictionCol="_c").fit(known)
    got = model.transform(known).select(*scores.columns, "_c")
    # As many rows as classes.
    order = got.groupBy("_c").agg(F.avg(score).alias("_m")).withColumn(into, F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("_m")) - 1)
    out = got.join(F.broadcast(order.select("_c", into)), "_c").select(*scores.columns, into)
    return out.unionByName(scores.where(~ok).withColumn(into, F.lit(-1)))


def describe(classed: DataFrame, score: str = "score", by: str = "cluster") -> DataFrame:
    s = F.col(score)
    return classed.groupBy(by).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"),
        *(F.percentile(s, F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)), F.max(s).alias("max"),
    )


def dotplot(scores: DataFrame, score: str = "score", id_col: str = "item_id") -> DataFrame:
    """scores with the row of each in a plot by score, from 1; ranks by ranges of the score, so that no task sorts all."""
    from prefscale.operators.pairing import ranked

    lo, hi = scores.agg(F.min(score), F.max(score)).first()
    width = (hi - lo) or 1.0 if lo is not None else 1.0
    share = F.floor((F.col(score) - F.lit(lo)) / F.lit(width) * 4095).cast("int")
    out = scores.where(F.col(score).isNotNull()).withColumn("_s", F.col(score))
    return ranked(out, F.concat(F.lpad(F.hex(share), 3, "0")), "_s", id_col, into="row").withColumn("row", F.col("row") + 1).drop("_s")

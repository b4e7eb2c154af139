"""A text scorer from pairs: a linear model on hashed words, trained on differences of winners and losers."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscale.functions import decisions as D
from prefscale.operators.pairing import split_items


def reward_pairs(decisions: DataFrame, texts: DataFrame, scores: DataFrame | None = None, compat: bool = False, id_col: str = "item_id") -> DataFrame:
    """(item1, item2, text_w, text_l, margin): the winner's text, the loser's and the difference of their scores (1
    without scores). ``compat`` takes item1 as the winner of every row, and the margin of item2 over it."""
    d = D.normalize("decision", "reward")
    out = decisions.withColumn("_d", d)
    out = out if compat and scores is not None else out.where("_d in ('Text1', 'Text2')")
    for k in (1, 2):
        out = out.join(texts.select(F.col(id_col).alias(f"item{k}"), F.col("text").alias(f"t{k}")), f"item{k}", "left")
        if scores is not None:
            out = out.join(scores.select(F.col(id_col).alias(f"item{k}"), F.col("score").alias(f"s{k}")), f"item{k}", "left")
    one = F.lit(True) if compat and scores is not None else F.col("_d") == "Text1"
    gap = F.lit(1.0) if scores is None else F.col("s2") - F.col("s1") if compat else F.when(one, F.col("s1") - F.col("s2")).otherwise(F.col("s2") - F.col("s1"))
    split = [c for c in ("item1_split", "item2_split") if c in decisions.columns]
    out = out.where("item1_split = item2_split") if len(split) == 2 and not decisions.where("item1_split is not null").isEmpty() else out
    return out.select("item1", "item2", F.when(one, F.col("t1")).otherwise(F.col("t2")).alias("text_w"), F.when(one, F.col("t2")).otherwise(F.col("t1")).alias("text_l"), gap.alias("margin"), *split[:1])


def split_pairs(pairs: DataFrame, test_size: float = 0.15, eval_size: float = 0.15, seed: int = 42) -> DataFrame:
    if pairs.isEmpty():
        raise ValueError("there are no pairs")
    keyed = pairs.withColumn("_p", F.md5(F.concat_ws("|", "text_w", "text_l", F.col("margin").cast("string"))))
    return split_items(keyed, test_size, eval_size, seed, "_p").drop("_p")


class RewardModel:
    """score(text) = weights . features(text); the loss of a pair is -log sigmoid(score of the winner - of the loser)."""

    def __init__(self, features: int = 1 << 12, penalty: float = 0.01):
        self.features, self.penalty, self.pipeline, self.model = features, penalty, None, None

    def _vectors(self, df: DataFrame, text: str, into: str) -> DataFrame:
        return self.pipeline.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))).withColumn(into, vector_to_array("_f")).drop("_text", "_w", "_tf", "_f")

    def fit(self, pairs: DataFrame) -> RewardModel:
        texts = pairs.select(F.explode(F.array("text_w", "text_l")).alias("_text")).where("_text is not null")
        self.pipeline = Pipeline(stages=[RegexTokenizer(inputCol="_text", outputCol="_w", pattern=r"\s+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=self.features), IDF(inputCol="_tf", outputCol="_f")]).fit(texts)
        both = self._vectors(self._vectors(pairs, "text_w", "a"), "text_l", "b")
        # Either order of a pair is one example, so that the model has no bias to learn.
        diff = both.select(F.explode(F.array(F.struct(F.zip_with("a", "b", lambda x, y: x - y).alias("d"), F.lit(1.0).alias("label")), F.struct(F.zip_with("b", "a", lambda x, y: x - y).alias("d"), F.lit(0.0).alias("label")))).alias("x")).select(array_to_vector("x.d").alias("features"), "x.label")
        self.model = LogisticRegression(fitIntercept=False, regParam=self.penalty, maxIter=50).fit(diff)
        return self

    def score(self, df: DataFrame, text: str = "text", into: str = "reward") -> DataFrame:
        if self.model is None:
            raise ValueError("the model isn't trained")
        vectors = self.pipeline.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
        out = self.model.setFeaturesCol("_f").setRawPredictionCol("_raw").setProbabilityCol("_pr").setPredictionCol("_pd").transform(vectors)
        return out.withColumn(into, F.get(vector_to_array("_raw"), F.lit(1))).select(*df.columns, into)

    def evaluate(self, pairs: DataFrame) -> DataFrame:
        """(n, loss, accuracy, margin_corr) on pairs."""
        s = self.score(self.score(pairs, "text_w", "_a"), "text_l", "_b").withColumn("_g", F.col("_a") - F.col("_b"))
        return s.agg(F.count("*").alias("n"), F.avg(F.log1p(F.exp(-F.col("_g")))).alias("loss"), F.avg((F.col("_g") > 0).cast("double")).alias("accuracy"), F.corr("_g", "margin").alias("margin_corr"))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/features")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> RewardModel:
        from pyspark.ml.classification import LogisticRegressionModel

        out = cls()
        out.pipeline, out.model = PipelineModel.load(f"{path}/features"), LogisticRegressionModel.load(f"{path}/model")
        return out


def rescaled(scored: DataFrame, lo: float = 0.0, hi: float = 1.0, column: str = "reward") -> DataFrame:
    """Scores between lo and hi; the middle where all are equal."""
    ends = scored.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5))
    return scored.join(F.broadcast(ends)).withColumn(column, F.lit(lo) + share * (hi - lo)).drop("_lo", "_hi")

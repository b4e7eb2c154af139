"""Rater reliability by expectation-maximisation over confusion matrices.

Instances with the same labels behave alike, so that the fit runs over the distinct label patterns and their counts. The
number of patterns is checked before they come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefscale.functions import decisions as D
from prefscale.operators.alt_test import benjamini_yekutieli, t_tested

MOST_PATTERNS = 1_000_000


def _class(decision: str):
    d = D.normalize(decision, "dawid_skene")
    return F.when(d == "Text1", 0).when(d == "Text2", 1).when(d == "Tie", 2)


def patterns(decisions: DataFrame, raters: list[str], decision: str = "decision", by: str = "rater", unit: str = "pair_id") -> DataFrame:
    """(labels, n): label vectors in the order of raters, -1 where one is missing."""
    wide = decisions.where(F.col(by).isin(raters)).groupBy(unit).pivot(by, raters).agg(F.first(_class(decision)))
    label = F.array(*(F.coalesce(F.col(f"`{r}`"), F.lit(-1)) for r in raters))
    return wide.groupBy(label.alias("labels")).agg(F.count("*").alias("n"))


def fit(labels: np.ndarray, n: np.ndarray, classes: int = 2, most_rounds: int = 100, tol: float = 1e-6, seed: int | None = None, align: bool = False):
    """(posterior by pattern, reliability, confusion[rater, true, seen], rounds). Seeded noise on uniform confusions
    breaks the symmetry of classes; ``align`` names classes so that the diagonals are largest."""
    raters = labels.shape[1]
    noise = np.random.RandomState(seed).randn(raters, classes, classes)
    conf = 1 / classes + np.abs(0.01 * noise)
    conf /= conf.sum(2, keepdims=True)
    seen = labels >= 0
    one = [(labels == y) for y in range(classes)]
    before, done = None, most_rounds
    for step in range(most_rounds):
        like = np.ones((len(labels), classes))
        for r in range(raters):
            pick = conf[r][:, np.maximum(labels[:, r], 0)].T
            like *= np.where(seen[:, r, None], pick, 1.0)
        total = like.sum(1, keepdims=True)
        post = np.where(total > 0, like / np.where(total > 0, total, 1), 1 / classes)
        for r in range(raters):
            num = np.stack([(post * (n * one[y][:, r])[:, None]).sum(0) for y in range(classes)], 1)
            den = (post * (n * seen[:, r])[:, None]).sum(0)[:, None]
            conf[r] = np.where(den > 0, num / np.where(den > 0, den, 1), 1 / classes)
        if before is not None and np.sqrt((n[:, None] * (post - before) ** 2).sum()) < tol:
            done = step
            break
        before = post
    if align and classes == 2 and conf[:, [0, 1], [0, 1]].mean() < 0.5:
        conf, post = conf[:, ::-1], post[:, ::-1]
    return post, conf[:, range(classes), range(classes)].mean(1), conf, done


def _fitted(decisions, raters, classes, most_rounds, tol, seed, align, **columns):
    p = patterns(decisions, raters, **columns)
    if classes < 3 and p.where(F.exists("labels", lambda x: x >= classes)).limit(1).count():
        raise ValueError("decisions hold ties; ask for three classes")
    rows = p.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} label patterns; fit fewer raters at a time")
    labels, n = np.array([r.labels for r in rows]).reshape(len(rows), len(raters)), np.array([r.n for r in rows], float)
    order = np.lexsort(labels.T[::-1]) if len(rows) else []
    return labels[order], n[order], fit(labels[order], n[order], classes, most_rounds, tol, seed, align)


def ranking(decisions: DataFrame, raters: list[str], classes: int = 2, most_rounds: int = 100, tol: float = 1e-6, seed: int = 42, align: bool = False, **columns) -> DataFrame:
    """(rater, type, reliability, rank): best first, equal ones share the better rank; names in ``decision*`` are models."""
    _, _, (_, rel, _, _) = _fitted(decisions, raters, classes, most_rounds, tol, seed, align, **columns)
    df = decisions.sparkSession.createDataFrame([(r, "LLM" if r.startswith("decision") else "Human", float(x)) for r, x in zip(raters, rel)], "rater string, type string, reliability double")
    # One row a rater.
    return df.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("reliability"))))


def alt_test(decisions: DataFrame, humans: list[str], model: str, classes: int = 2, most_rounds: int = 1000, tol: float = 1e-6, seed: int = 42, alpha: float = 0.05, correct: bool = True, decision: str = "decision", by: str = "rater", unit: str = "pair_id") -> DataFrame:
    """(rater, n, mean_diff, p_value, rejected): where the model agrees with the other humans, weighted by their
    reliability, more than the human does."""
    _, _, (_, rel, _, _) = _fitted(decisions, humans, classes, most_rounds, tol, seed, False, decision=decision, by=by, unit=unit)
    weight = F.create_map(*(x for r, v in zip(humans, rel) for x in (F.lit(r), F.lit(float(v)))))
    h = decisions.where(F.col(by).isin(humans)).select(unit, F.col(by).alias("rater"), _class(decision).alias("y")).where("y is not null").withColumn("w", F.element_at(weight, F.col("rater")))
    w = Window.partitionBy(unit)
    h = h.withColumns({"all": F.sum("w").over(w), "n": F.count("*").over(w), **{f"w{k}": F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)).over(w) for k in range(3)}})
    m = decisions.where(F.col(by) == model).select(unit, _class(decision).alias("l")).where("l is not null")
    x = h.where("n >= 2").join(m, unit)
    of = lambda v: F.when(v == 0, F.col("w0")).when(v == 1, F.col("w1")).otherwise(F.col("w2"))
    rest = F.col("all") - F.col("w")
    human = F.try_divide(of(F.col("y")) - F.col("w"), rest)
    llm = F.try_divide(of(F.col("l")) - F.when(F.col("l") == F.col("y"), F.col("w")).otherwise(0.0), rest)
    s = x.withColumn("d", llm - human).where("d is not null").groupBy("rater").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.var_samp("d").alias("var_diff"))
    t = t_tested(s, 0.0, "greater")
    t = benjamini_yekutieli(t, alpha) if correct else t.withColumn("rejected", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    return t.select("rater", "n", "mean_diff", "p_value", "rejected")


def winning_rate(tests: DataFrame, humans: int) -> DataFrame:
    return tests.agg((F.count_if("rejected") / F.lit(humans)).alias("winning_rate"))



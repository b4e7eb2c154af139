"""May a model replace human raters? Leave-one-out comparison, t-tests and control of false discoveries.

No rater is joined with the others: an instance's label counts say how many of the others agree with the left-out human
and with the model, as both divide by the same number. One pass gives each human's n, mean and variance of the
difference, and every margin epsilon is tested on those.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefscale.functions import decisions as D
from prefscale.functions import distributions as P


def _score(kind: str, own: Column, n: Column, s: Column, q: Column, same: Column, less: Column) -> Column:
    """What ``own`` scores against the other humans, up to a monotone map: their matches, or minus the squared error."""
    if kind == "accuracy":
        return same
    return -(own * own * (n - 1) - 2 * own * (s - less) + (q - less * less))


def instance_stats(humans: DataFrame, model: DataFrame, scoring: str | Callable[[float, list[float]], float] = "accuracy", least_humans: int = 2, decision: str = "decision", by: str = "rater", unit: str = "pair_id") -> DataFrame:
    """(unit, by, llm_wins, human_wins): for each human and instance, 1 if the model (the human) scores at least as well
    against the other humans as the human (the model) does. A callable gets a value (0, 1, 0.5 for ties) and those of the
    other humans; it runs on the distinct cases, which are few."""
    if not callable(scoring) and scoring not in ("accuracy", "neg_rmse"):
        raise ValueError("scoring is 'accuracy', 'neg_rmse' or a callable")
    h = humans.select(unit, by, D.value(D.normalize(decision, "alt_test")).alias("y")).where("y is not null")
    m = model.select(unit, D.value(D.normalize(decision, "alt_test")).alias("l")).where("l is not null")
    w = Window.partitionBy(unit)
    h = h.withColumns({"n": F.count("*").over(w), "s": F.sum("y").over(w), "q": F.sum(F.col("y") * F.col("y")).over(w), **{f"c{k}": F.count_if(F.col("y") == v).over(w) for k, v in enumerate((0.0, 1.0, 0.5))}})
    x = h.where((F.col("n") >= least_humans) & (F.col("n") >= 2)).join(m, unit)
    count = lambda v: F.when(v == 0.0, F.col("c0")).when(v == 1.0, F.col("c1")).otherwise(F.col("c2"))
    y, l = F.col("y"), F.col("l")
    if callable(scoring):
        less = lambda v, k: F.col(f"c{k}") - (y == v).cast("int")
        case = [F.col(unit), F.col(by), y, l, *(less(v, k).alias(f"o{k}") for k, v in enumerate((0.0, 1.0, 0.5)))]
        x = x.select(*case)

        @F.pandas_udf("double")
        def scored(own: pd.Series, o0: pd.Series, o1: pd.Series, o2: pd.Series) -> pd.Series:
            return pd.Series([float(scoring(v, [0.0] * a + [1.0] * b + [0.5] * c)) for v, a, b, c in zip(own, o0, o1, o2)], dtype="float64")

        kinds = x.select("y", "l", "o0", "o1", "o2").distinct()
        kinds = kinds.withColumns({"human": scored("y", "o0", "o1", "o2"), "llm": scored("l", "o0", "o1", "o2")})
        x = x.join(kinds, ["y", "l", "o0", "o1", "o2"])
        return x.select(unit, by, (F.col("llm") >= F.col("human")).cast("int").alias("llm_wins"), (F.col("human") >= F.col("llm")).cast("int").alias("human_wins"))
    human = _score(scoring, y, F.col("n"), F.col("s"), F.col("q"), count(y) - 1, y)
    llm = _score(scoring, l, F.col("n"), F.col("s"), F.col("q"), count(l) - (l == y).cast("int"), y)
    return x.select(unit, by, (llm >= human).cast("int").alias("llm_wins"), (human >= llm).cast("int").alias("human_wins"))


def stats(humans: DataFrame, model: DataFrame, least_instances: int = 30, by: str = "rater", **options) -> DataFrame:
    """(by, n, mean_diff, var_diff, advantage) of humans with enough instances; differences are human less model."""
    x = instance_stats(humans, model, by=by, **options).withColumn("d", (F.col("human_wins") - F.col("llm_wins")).cast("double"))
    out = x.groupBy(by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.var_samp("d").alias("var_diff"), F.avg(F.col("llm_wins").cast("double")).alias("advantage"))
    return out.where(F.col("n") >= least_instances)


def t_tested(stats_: DataFrame, epsilon: Column | float, alternative: str = "less") -> DataFrame:
    eps = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))

    @F.pandas_udf("double")
    def p(n: pd.Series, mean: pd.Series, var: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([P.t_test(int(a), b, c, d, alternative) for a, b, c, d in zip(n, mean, var, e)], dtype="float64")

    return stats_.withColumn("p_value", p("n", "mean_diff", "var_diff", eps))


def benjamini_yekutieli(tests: DataFrame, q: float = 0.05, by: tuple[str, ...] = (), p: str = "p_value") -> DataFrame:
    """tests with ``rejected``: all up to the largest rank i whose p is at most i / m * q / (1 + 1/2 + ... + 1/m)."""
    own = Window.partitionBy(*by)
    ranked = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    m = F.count("*").over(own)
    out = tests.withColumns({"_m": m, "_i": F.row_number().over(ranked)})
    harmonic = F.sum(1.0 / F.col("_i")).over(own)
    out = out.withColumn("_pass", F.when(F.col(p) <= F.col("_i") / F.col("_m") * (F.lit(q) / harmonic), F.col("_i")))
    return out.withColumn("rejected", F.coalesce(F.col("_i") <= F.max("_pass").over(own), F.lit(False))).drop("_m", "_i", "_pass")


def alt_test(humans: DataFrame, model: DataFrame, epsilon: float = 0.1, q: float = 0.05, by: str = "rater", **options) -> DataFrame:
    """(winning_rate, advantage, tested): the share of humans over whom the model wins, and its mean advantage."""
    t = benjamini_yekutieli(t_tested(stats(humans, model, by=by, **options), epsilon), q)
    return t.agg(F.try_divide(F.count_if("rejected"), F.count("*")).alias("winning_rate"), F.avg("advantage").alias("advantage"), F.count("*").alias("tested"))


def alt_test_models(humans: DataFrame, models: DataFrame, names: list[str], by: str = "rater", **options) -> DataFrame:
    """(model, winning_rate, advantage, tested) of each named model."""
    out = None
    for name in names:
        t = alt_test(humans, models.where(F.col(by) == name), by=by, **options).select(F.lit(name).alias("model"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def epsilon_sweep(humans: DataFrame, model: DataFrame, lo: float = -0.1, hi: float = 0.25, step: float = 0.01, q: float = 0.05, by: str = "rater", **options) -> DataFrame:
    """(epsilon, winning_rate) over a range of margins, all from one aggregation. The range may pass hi by a step."""
    import math

    n = math.ceil((hi + step - lo) / step - 1e-9)
    s = stats(humans, model, by=by, **options)
    eps = s.sparkSession.range(n).select((F.lit(lo) + F.col("id") * step).alias("epsilon"))
    t = benjamini_yekutieli(t_tested(s.join(F.broadcast(eps)), F.col("epsilon")), q, ("epsilon",))
    return t.groupBy("epsilon").agg(F.try_divide(F.count_if("rejected"), F.count("*")).alias("winning_rate"))

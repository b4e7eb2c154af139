"""Consistency of raters: transitivity, Cohen, Fleiss and Krippendorff agreement, intraclass correlation.

Everything rests on counts that are aggregated on the executors: label histograms of items, confusion counts of two
raters, and sums of squares. Decisions come in long form (pair_id, item1, item2, rater, decision).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefscale.functions import decisions as D
from prefscale.functions import distributions as P
from prefscale.operators.graph import checkpointed


def transitivity(decisions: DataFrame, decision: str = "decision", by: str = "rater", order: str | None = None) -> DataFrame:
    """(by, score, violations, triples): the last decision of a pair counts; a triple needs all three pairs.

    Pairs are directed from the smaller id, and of three edges the two from a triple's ends meet at the middle item
    before the third closes it, so that work follows the paths of length two, not the cube of the items."""
    d = decisions.withColumn("_d", D.normalize(decision, "transitivity")).where("_d is not null and item1 <> item2")
    up = F.col("item1") < F.col("item2")
    r = F.when(F.col("_d") == "Tie", 0.5).when((F.col("_d") == "Text1") == up, 1.0).otherwise(0.0)
    rank = F.col(order) if order else F.lit(0)
    e = d.select(by, F.least("item1", "item2").alias("a"), F.greatest("item1", "item2").alias("b"), F.struct(rank.alias("o"), r.alias("r")).alias("s"))
    e = checkpointed(e.groupBy(by, "a", "b").agg(F.max("s")["r"].alias("r")))
    ab, bc, ac = (e.select(by, F.col("a").alias(x), F.col("b").alias(y), F.col("r").alias(x + y)) for x, y in ("ab", "bc", "ac"))
    t = ab.join(bc, [by, "b"]).join(ac, [by, "a", "c"])
    x, y, z = F.col("ab"), F.col("bc"), F.col("ac")
    bad = ((x == y) & (z != x)) | ((x == 0.5) & (y != 0.5) & (z != y)) | ((y == 0.5) & (x != 0.5) & (z != x))
    got = t.groupBy(by).agg(F.count("*").alias("triples"), F.count_if(bad).alias("violations"))
    out = decisions.select(by).distinct().join(got, by, "left").na.fill(0, ["triples", "violations"])
    return out.select(by, F.coalesce(1 - F.try_divide("violations", "triples"), F.lit(0.0)).alias("score"), "violations", "triples")


def _rated(decisions: DataFrame, decision: str, by: str, unit: str, dialect: str = "irr") -> DataFrame:
    return decisions.select(unit, by, D.normalize(decision, dialect).alias("label")).where("label is not null")


def cohen_kappa(decisions: DataFrame, rater_a: str, rater_b: str, decision: str = "decision", by: str = "rater", unit: str = "pair_id") -> DataFrame:
    """(n, observed, expected, kappa) of two raters over the units both rated."""
    r = _rated(decisions, decision, by, unit)
    a, b = (r.where(F.col(by) == x).select(unit, F.col("label").alias(y)) for x, y in ((rater_a, "a"), (rater_b, "b")))
    c = a.join(b, unit).groupBy("a", "b").agg(F.count("*").alias("n"))
    one = c.groupBy().agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ra, rb = c.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), c.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    chance = ra.join(rb, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    n = F.col("n").cast("double")
    po, pe = F.try_divide("same", n), F.try_divide("xy", n * n)
    return one.join(F.broadcast(chance)).select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def label_histogram(decisions: DataFrame, decision: str = "decision", by: str = "rater", unit: str = "pair_id", dialect: str = "irr") -> DataFrame:
    """(unit, n, c0, c1, c2): how many raters gave each label."""
    r = _rated(decisions, decision, by, unit, dialect)
    return r.groupBy(unit).agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == x).alias(f"c{k}") for k, x in enumerate(("Text1", "Text2", "Tie"))))


def fleiss_kappa(decisions: DataFrame, raters: int, decision: str = "decision", by: str = "rater", unit: str = "pair_id") -> DataFrame:
    """(n, observed, expected, kappa) over the units that all ``raters`` rated."""
    h = label_histogram(decisions, decision, by, unit).where(F.col("n") == raters)
    sq = sum((F.col(f"c{k}") * F.col(f"c{k}") for k in range(1, 3)), F.col("c0") * F.col("c0"))
    s = h.agg(F.count("*").alias("n"), F.sum(sq).alias("sq"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(3)))
    n, k = F.col("n").cast("double"), float(raters)
    po = F.try_divide(F.col("sq") - n * k, n * k * (k - 1))
    pe = F.try_divide(sum((F.col(f"c{x}") * F.col(f"c{x}") for x in range(1, 3)), F.col("c0") * F.col("c0")).cast("double"), n * n * k * k)
    return s.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def krippendorff_alpha(decisions: DataFrame, level: str = "nominal", compat: bool = True, decision: str = "decision", by: str = "rater", unit: str = "pair_id") -> DataFrame:
    """(units, observed, expected, alpha) over units of two ratings at least; levels nominal, ordinal (difference of
    places), interval and ratio. ``compat`` takes the marginals twice, as the measured programme does, so that alpha is
    0.75 + 0.25 of the standard."""
    if level not in ("nominal", "ordinal", "interval", "ratio"):
        raise ValueError("level is 'nominal', 'ordinal', 'interval' or 'ratio'")
    h = label_histogram(decisions, decision, by, unit).where("n >= 2")
    delta = {(i, j): (1.0 if level == "nominal" else ((i - j) / (i + j)) ** 2 if level == "ratio" and i + j else float((i - j) ** 2)) for i in range(3) for j in range(3) if i != j}
    off = sum((F.col(f"c{i}") * F.col(f"c{j}") * F.lit(d) for (i, j), d in delta.items()), F.lit(0.0)) / (F.col("n") - 1)
    s = h.agg(F.count("*").alias("units"), F.sum(off).alias("off"), F.sum("n").alias("n"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(3)))
    n = F.col("n").cast("double")
    do = F.try_divide("off", n)
    de = F.try_divide(sum((F.col(f"c{i}") * F.col(f"c{j}") * F.lit(d) for (i, j), d in delta.items()), F.lit(0.0)), n * (n - 1))
    de = de * 4 if compat else de
    return s.select("units", do.alias("observed"), de.alias("expected"), F.when(de == 0, 1.0).otherwise(1 - F.try_divide(do, de)).alias("alpha"))


def irr(decisions: DataFrame, groups: dict[str, list[str]], method: str = "auto", level: str = "nominal", by: str = "rater", **columns) -> DataFrame:
    """(group, method, score, interpretation) for each group of raters: Cohen's kappa for two, else Krippendorff's."""
    out = None
    for name, raters in groups.items():
        d = decisions.where(F.col(by).isin(raters))
        own = method if method != "auto" else "cohens_kappa" if len(raters) == 2 else "krippendorff_alpha"
        if own == "cohens_kappa":
            s = cohen_kappa(d, *raters, by=by, **columns).select(F.col("kappa").alias("score"))
        elif own == "fleiss_kappa":
            s = fleiss_kappa(d, len(raters), by=by, **columns).select(F.col("kappa").alias("score"))
        elif own == "krippendorff_alpha":
            s = krippendorff_alpha(d, level, by=by, **columns).select(F.col("alpha").alias("score"))
        else:
            raise ValueError(f"unknown method {method}")
        s = s.select(F.lit(name).alias("group"), F.lit(own).alias("method"), "score", D.band(F.col("score"), D.KAPPA_BANDS, "poor").alias("interpretation"))
        out = s if out is None else out.unionByName(s)
    return out


def icc_components(decisions: DataFrame, decision: str = "decision", by: str = "rater", unit: str = "pair_id", mapping: dict[str, float] | None = None) -> DataFrame:
    """(n, k, msr, msc, mse): mean squares of units, raters and the rest over units of two ratings at least."""
    if mapping is None:
        v = D.value(D.normalize(decision, "icc"))
    else:
        v = F.lit(None).cast("double")
        for code, x in mapping.items():
            v = F.when(F.col(decision).cast("string") == str(code), F.lit(float(x))).otherwise(v)
    r = decisions.select(unit, F.col(by).alias("rater"), v.alias("v")).where("v is not null")
    # Three aggregations read it.
    r = checkpointed(r.withColumn("m", F.count("*").over(Window.partitionBy(unit))).where("m >= 2"))
    rows, cols = r.groupBy(unit).agg(F.avg("v").alias("mean")), r.groupBy("rater").agg(F.avg("v").alias("mean"))
    one = r.agg(F.avg("v").alias("grand"), F.sum(F.col("v") * F.col("v")).alias("sq"), F.sum("v").alias("s"), F.count("*").alias("cells"))
    rr = rows.agg(F.count("*").alias("n"), F.sum("mean").alias("rs"), F.sum(F.col("mean") * F.col("mean")).alias("rq"))
    cc = cols.agg(F.count("*").alias("k"), F.sum("mean").alias("cs"), F.sum(F.col("mean") * F.col("mean")).alias("cq"))
    x = one.join(F.broadcast(rr)).join(F.broadcast(cc))
    n, k, g = F.col("n").cast("double"), F.col("k").cast("double"), F.col("grand")
    ssr = k * (F.col("rq") - 2 * g * F.col("rs") + n * g * g)
    ssc = n * (F.col("cq") - 2 * g * F.col("cs") + k * g * g)
    sst = F.col("sq") - 2 * g * F.col("s") + F.col("cells") * g * g
    return x.select(
        "n", "k", F.try_divide(ssr, n - 1).alias("msr"), F.try_divide(ssc, k - 1).alias("msc"), F.try_divide(sst - ssr - ssc, (n - 1) * (k - 1)).alias("mse")
    )


def icc(decisions: DataFrame, alpha: float = 0.05, **columns) -> DataFrame:
    """ICC(2,1) with F test and interval: (n, k, icc, f_stat, p_value, ci_lo, ci_hi, interpretation)."""

    def finish(batches):
        for t in batches:
            out = []
            for r in t.itertuples():
                n, k, msr, msc, mse = r.n, r.k, r.msr, r.msc, r.mse
                if not n or n < 2 or k < 2:
                    out.append((n, k, None, None, None, None, None))
                    continue
                den = msr + (k - 1) * mse + k * (msc - mse) / n
                v = max(-1.0, min(1.0, (msr - mse) / den)) if den else None
                if mse <= 1e-15:
                    out.append((n, k, v, None, None, None, None))
                    continue
                f, d1, d2 = msr / mse, n - 1, (n - 1) * (k - 1)
                q = P.f_ppf(1 - alpha / 2, d1, d2)
                q2 = P.f_ppf(1 - alpha / 2, d2, d1)
                lo, hi = (f / q - 1) / (f / q + k - 1), (f * q2 - 1) / (f * q2 + k - 1)
                out.append((n, k, v, f, P.f_sf(f, d1, d2), max(-1.0, min(1.0, lo)), max(-1.0, min(1.0, hi))))
            yield pd.DataFrame(out, columns=["n", "k", "icc", "f_stat", "p_value", "ci_lo", "ci_hi"])

    got = icc_components(decisions, **columns).mapInPandas(finish, "n long, k long, icc double, f_stat double, p_value double, ci_lo double, ci_hi double")
    return got.withColumn("interpretation", D.band(F.col("icc"), D.ICC_BANDS, "poor"))


def tie_share(decisions: DataFrame, decision: str = "decision", by: str = "rater") -> DataFrame:
    """(by, n, ties, share, rated): how often each rater ties, and on how many pairs there is a decision at all."""
    d = D.normalize(decision, "score")
    return decisions.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(d == "Tie").alias("ties"), F.try_divide(F.count_if(d == "Tie"), F.count(d)).alias("share"), F.count(d).alias("rated")
    )


def has_errors(decision: Column) -> Column:
    return F.coalesce(decision.contains("ERROR"), F.lit(False))

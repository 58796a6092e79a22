"""Normality, one-way ANOVA and Tukey HSD over per-fold scores.

Input: a long table of observations ``(group, value)`` -- e.g. fold F1
scores with ``group = variant``.  Sums, means and squares are Spark
aggregates; only distribution functions (p-values, critical values) run in
pandas UDFs.  Group summaries have one row per
treatment (bounded by the number of variants), which is what is paired.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from postresp.functions import distributions as dist
from postresp.operators.frame import rank_within


def melt_scores(fold_scores: DataFrame) -> DataFrame:
    """K2: ``(index, treatments, value)`` -- one value per (variant, fold)."""
    return fold_scores.select(F.col("fold").alias("index"), F.col("variant").alias("treatments"),
                              F.col("f1").alias("value"))


@F.pandas_udf(DoubleType())
def _normal_score(rank1: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(dist.normal_scores(rank1.to_numpy(), n.to_numpy()))


@F.pandas_udf(StructType().add("W", DoubleType()).add("pval", DoubleType()))
def _shapiro(n: pd.Series, low: pd.Series, low2: pd.Series, high2: pd.Series, high: pd.Series,
             mm: pd.Series, mx: pd.Series, ss: pd.Series) -> pd.DataFrame:
    rows = [dist.shapiro_wilk(int(r[0]), *map(float, r[1:])) if r[0] >= 3 else (math.nan, math.nan)
            for r in zip(n, low, low2, high2, high, mm, mx, ss)]
    return pd.DataFrame(rows, columns=["W", "pval"])


def normality(obs: DataFrame, group: str = "treatments", value: str = "value",
              alpha: float = 0.05) -> DataFrame:
    """K1: Shapiro-Wilk per group -> ``(group, W, pval, normal)``, one test for
    every size: values are ranked by a distributed sort, their normal scores
    come from Arrow batches, and W needs only sums and the four outermost
    values of a group (fewer than three values: null)."""
    obs = obs.select(group, F.col(value).cast("double").alias(value))
    groups = obs.select(group).distinct()
    obs = obs.where(F.col(value).isNotNull() & ~F.isnan(value))
    ranked = rank_within(obs, group, value, name="_r")
    summ = obs.groupBy(group).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"))
    at = ranked.join(summ, group)
    # centred values: the sums lose no digits to a large mean
    x, r, n = F.col(value) - F.col("_mean"), F.col("_r"), F.col("_n")
    m = _normal_score((r + 1).cast("double"), n.cast("double"))
    at = at.withColumn("_x", x).withColumn("_m", m)
    sums = at.groupBy(group).agg(
        F.max("_n").alias("n"), F.max(F.when(r == 0, F.col("_x"))).alias("low"), F.max(F.when(r == 1, F.col("_x"))).alias("low2"),
        F.max(F.when(r == n - 2, F.col("_x"))).alias("high2"), F.max(F.when(r == n - 1, F.col("_x"))).alias("high"),
        F.sum(F.col("_m") * F.col("_m")).alias("mm"), F.sum(F.col("_m") * F.col("_x")).alias("mx"),
        F.sum(F.col("_x") * F.col("_x")).alias("ss"))
    tested = sums.select(group, _shapiro("n", *[F.coalesce(c, F.lit(0.0)) for c in ("low", "low2", "high2", "high", "mm", "mx", "ss")]).alias("t"))
    tested = tested.select(group, F.nanvl("t.W", F.lit(None)).alias("W"), F.nanvl("t.pval", F.lit(None)).alias("pval"))
    return groups.join(tested, group, "left").select(group, "W", "pval", (F.col("pval") > alpha).alias("normal"))


def _group_summary(obs: DataFrame, group: str, value: str) -> DataFrame:
    """One row per group, in one pass: ``n, mean, ss`` (squares around the mean),
    each with the totals of all groups: ``k, n_tot, grand, ss_w``.

    The window spans the k summary rows, never observations."""
    obs = obs.select(group, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    summ = obs.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  (F.var_pop(value) * F.count(value)).alias("ss"))
    every = Window.partitionBy()
    return summ.select("*", F.count(F.lit(1)).over(every).alias("k"), F.sum("n").over(every).alias("n_tot"),
                       (F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)).alias("grand"),
                       F.sum("ss").over(every).alias("ss_w"))


def _ratio(a, b):
    """a / b; infinite over zero, null for zero over zero."""
    return F.when(b == 0, F.when(a > 0, F.lit(math.inf))).otherwise(a / b)


def anova_oneway(obs: DataFrame, group: str = "treatments", value: str = "value",
                 with_p: bool = True) -> DataFrame:
    """K3: type-2 one-way ANOVA table ``(source, sum_sq, df, F[, p_value])``.

    Without variance within the groups F is infinite (null if there is none
    between them either); without degrees of freedom it is null."""
    t = _group_summary(obs, group, value).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ss_b"), F.max("ss_w").alias("ss_w"),
        (F.max("k") - 1).cast("double").alias("df_b"), (F.max("n_tot") - F.max("k")).cast("double").alias("df_w"))
    ms_b = F.when(F.col("df_b") > 0, F.col("ss_b") / F.col("df_b"))
    ms_w = F.when(F.col("df_w") > 0, F.col("ss_w") / F.col("df_w"))
    t = t.withColumn("F", _ratio(ms_b, ms_w))
    rows = t.select(F.explode(F.array(
        F.struct(F.lit("C(treatments)").alias("source"), F.col("ss_b").alias("sum_sq"),
                 F.col("df_b").alias("df"), F.col("F").alias("F"), F.col("df_w").alias("_dfw")),
        F.struct(F.lit("Residual").alias("source"), F.col("ss_w").alias("sum_sq"),
                 F.col("df_w").alias("df"), F.lit(None).cast("double").alias("F"),
                 F.col("df_w").alias("_dfw")))).alias("r")).select("r.*")
    if with_p:
        rows = rows.withColumn("p_value", _f_pvalue(F.col("F"), F.col("df"), F.col("_dfw")))
    return rows.drop("_dfw")


@F.pandas_udf(DoubleType())
def _f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else 0.0 if a == math.inf else dist.f_sf(a, b, c)
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


def tukey_pairs(obs: DataFrame, group: str = "treatments", value: str = "value") -> DataFrame:
    """K4 (SQL part): every pair of treatments with mean difference and q.

    ``meandiff = mean(group2) - mean(group1)``, ``q = |meandiff| / se`` with
    ``se = sqrt(MSE / 2 * (1/n1 + 1/n2))`` and the pooled within-group MSE
    (q is infinite, or null for equal means, without variance; null without
    degrees of freedom).
    Pairs are built from the per-treatment summary (one row per treatment).
    """
    summ = _group_summary(obs, group, value)
    df_w = F.col("n_tot") - F.col("k")
    a = summ.select(F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("k").cast("int").alias("k"),
                    df_w.cast("double").alias("df_w"), F.when(df_w > 0, F.col("ss_w") / df_w).alias("mse"))
    b = summ.select(F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    # the test compares every pair of treatments: pairs of the k summary rows
    # (k = number of variants), never of observations
    pairs = a.join(b, F.col("group1") < F.col("group2"))
    se = F.sqrt(F.col("mse") / 2.0 * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    return pairs.select("group1", "group2", (F.col("m2") - F.col("m1")).alias("meandiff"),
                        se.alias("se"), "k", "df_w") \
        .withColumn("q", _ratio(F.abs(F.col("meandiff")), F.col("se")))


def tukey_hsd(obs: DataFrame, group: str = "treatments", value: str = "value",
              alpha: float = 0.05) -> DataFrame:
    """K4: Tukey HSD: meandiff, p_adj, lower, upper, reject for all pairs."""
    pairs = tukey_pairs(obs, group, value)
    crit = _q_crit(F.lit(1.0 - alpha), F.col("k"), F.col("df_w"))
    out = (pairs.withColumn("p_adj", _tukey_p(F.col("q"), F.col("k"), F.col("df_w")))
           .withColumn("_qc", crit))
    return out.select("group1", "group2", "meandiff", "p_adj",
                      (F.col("meandiff") - F.col("_qc") * F.col("se")).alias("lower"),
                      (F.col("meandiff") + F.col("_qc") * F.col("se")).alias("upper"),
                      (F.col("q") > F.col("_qc")).alias("reject"))


@F.pandas_udf(DoubleType())
def _tukey_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else 0.0 if a == math.inf else 1.0 - dist.ptukey(float(a), int(b), float(c))
                      for a, b, c in zip(q, k, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def _q_crit(p: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    cache: dict = {}
    out = []
    for a, b, c in zip(p, k, df):
        key = (float(a), int(b), float(c))
        if key not in cache:
            cache[key] = dist.qtukey(*key) if key[2] > 0 else math.nan
        out.append(cache[key])
    return pd.Series(out, dtype="float64")

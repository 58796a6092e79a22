"""Metrics (J) and statistical tests (K): golden values and closed forms."""
import math

import numpy as np
from pyspark.sql import functions as F

from postresp.functions import distributions as dist
from postresp.operators import metrics as J
from postresp.operators import stats as K


def _pred(spark):
    rows = [("v", 0, i, t, p) for i, (t, p) in enumerate(zip("aabc", "abbc"))]
    return spark.createDataFrame(rows, "variant string, fold int, row long, truth string, prediction string")


def test_micro_f1_and_mcc_golden(spark):
    p = _pred(spark)
    assert J.micro_f1(p).first().f1 == 0.75
    assert J.mcc(p).first().mcc == 0.7


def test_weighted_f1(spark):
    p = _pred(spark)
    # per class F1: a=2/3, b=2/3, c=1; support 2,1,1 -> (4/3 + 2/3 + 1)/4 = 0.75
    assert J.weighted_f1(p).first().f1_weighted == 0.75


def test_mcc_undefined_is_zero(spark):
    rows = [("v", 0, i, "a", "a") for i in range(4)]
    p = spark.createDataFrame(rows, "variant string, fold int, row long, truth string, prediction string")
    assert J.mcc(p).first().mcc == 0.0


def _normality(spark, groups):
    obs = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs], "treatments string, value double")
    return {r.treatments: r for r in K.normality(obs).collect()}


def test_shapiro_known_values(spark):
    r = np.random.default_rng(5)
    got = _normality(spark, {"a": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "three": [1, 2, 4], "two": [1, 2],
                             "same": [3, 3, 3, 3], "gaps": [None, 1, None, 2, 4], "five": [1, 2, 3, 5, 9],
                             "normal": r.normal(1e6, 2, 6000), "skewed": r.exponential(1, 6000)})
    assert abs(got["a"].W - 0.7888) < 1e-3 and abs(got["a"].pval - 0.0067) < 5e-4 and not got["a"].normal
    assert 0 < got["three"].W <= 1 and got["gaps"].W == got["three"].W
    assert got["two"].W is None and got["two"].pval is None and got["same"].W == 1.0
    assert abs(got["five"].W - 0.9013) < 2e-2
    # one test at every size
    assert got["normal"].W > 0.999 and got["normal"].normal and got["skewed"].W < 0.9 and not got["skewed"].normal


def test_missing_predictions_are_misses(spark):
    rows = [("v", 0, 0, "a", "a"), ("v", 0, 1, "a", None), ("v", 0, 2, "b", None), ("v", 0, 3, "b", "a")]
    p = spark.createDataFrame(rows, "variant string, fold int, row long, truth string, prediction string")
    assert J.micro_f1(p).first().f1 == 0.25
    assert J.mcc(p).count() == 1 and J.weighted_f1(p).first().f1_weighted is not None


def test_large_counts_do_not_overflow(spark):
    n = 4_000_000_000
    conf = spark.createDataFrame([("v", "a", "a", n), ("v", "b", "b", n), ("v", "a", "b", 0)], "variant string, truth string, prediction string, n long")
    assert J.mcc(conf, conf=conf).first().mcc == 1.0


def test_no_variance_within_groups(spark):
    two = spark.createDataFrame([(g, v) for g, v in (("a", 1.0), ("b", 2.0)) for _ in range(4)], "treatments string, value double")
    t = {r.source: r for r in K.anova_oneway(two).collect()}
    assert t["C(treatments)"].F == math.inf and t["C(treatments)"].p_value == 0.0
    r = K.tukey_hsd(two).first()
    assert r.reject and r.p_adj == 0.0 and r.lower == r.upper == r.meandiff == 1.0
    same = two.withColumn("value", F.lit(1.0))
    assert {x.F for x in K.anova_oneway(same).collect()} == {None} and K.tukey_hsd(same).first().p_adj is None
    single = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "treatments string, value double")
    assert K.anova_oneway(single).collect()[0].F is None and K.tukey_pairs(single).first().q is None


def test_f_and_studentized_range_tables():
    assert abs(dist.f_sf(4.965, 1, 10) - 0.05) < 1e-3
    assert abs(dist.qtukey(0.95, 3, 10) - 3.877) < 2e-3
    assert abs(dist.qtukey(0.95, 10, 30) - 4.824) < 2e-3


def test_anova_two_groups_equals_t_squared(spark):
    a = [0.51, 0.55, 0.49, 0.53, 0.50]
    b = [0.58, 0.61, 0.57, 0.60, 0.62]
    obs = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "treatments string, value double")
    t = {r.source: r for r in K.anova_oneway(obs).collect()}
    sp = math.sqrt(((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / 8)
    tstat = (np.mean(b) - np.mean(a)) / (sp * math.sqrt(2 / 5))
    assert abs(t["C(treatments)"].F - tstat ** 2) < 1e-9
    assert t["C(treatments)"].df == 1 and t["Residual"].df == 8
    assert 0 <= t["C(treatments)"].p_value < 0.001


def test_tukey_and_normality(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.normal(mu, 0.01))) for g, mu in (("a", 0.5), ("b", 0.5), ("c", 0.6)) for _ in range(5)]
    obs = spark.createDataFrame(rows, "treatments string, value double")
    tk = {(r.group1, r.group2): r for r in K.tukey_hsd(obs).collect()}
    assert tk[("a", "c")].reject and not tk[("a", "b")].reject
    assert tk[("a", "c")].lower < tk[("a", "c")].meandiff < tk[("a", "c")].upper
    nm = K.normality(obs).collect()
    assert len(nm) == 3 and all(0 < r.W <= 1 for r in nm)

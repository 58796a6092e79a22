"""Quantile labels (E), structured features (D) and splits (F)."""
import numpy as np
from pyspark.sql import functions as F

from postresp.functions import features as D
from postresp.operators import labels as L
from postresp.operators import splits as S


def test_cut_points_golden(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "x long")
    r = L.cut_points(df, ["x"]).first()
    assert (r.x_q1, r.x_q2) == (2.0, 4.0)


def test_labels_golden(spark):
    df = spark.createDataFrame([(v,) for v in (2.0, 2.9, 3.0, 4.0, 5.0, None)], "x double")
    cuts = spark.createDataFrame([(2.0, 4.0)], "x_q1 double, x_q2 double")
    got = [r.x_class for r in L.add_labels(df, ["x"], cuts=cuts).collect()]
    assert got == ["small", "small", "moderate", "moderate", "high", None]


def test_encode_decode(spark):
    df = spark.createDataFrame([("small",), ("moderate",), ("high",), ("x",)], "c string")
    out = df.select(L.encode_label(F.col("c")).alias("k")).select("k", L.decode_label(F.col("k")).alias("d"))
    assert [tuple(r) for r in out.collect()] == [(0, "small"), (1, "moderate"), (2, "high"), (None, None)]


def test_box_stats_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 200).tolist() + [400]
    df = spark.createDataFrame([(2018, int(v), 0, 0) for v in vals], "year int, replies long, likes long, retweets long")
    r = L.box_stats(df, ["replies"]).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    hi = max(v for v in vals if v <= q3 + 1.5 * (q3 - q1))
    assert (r.q1, r.median, r.q3, r.whisker_high, r.n) == (q1, med, q3, hi, 201)


def test_has_items_and_ym(spark):
    df = spark.createDataFrame([(None,), ("[]",), ("['a']",)], "h string")
    assert [r[0] for r in df.select(D.has_items(df, "h")).collect()] == [False, False, True]
    ts = spark.createDataFrame([("2017-01-05",), ("2019-12-01",), ("2020-01-01",)], "d string") \
        .select(F.to_timestamp("d").alias("t"))
    assert [r[0] for r in ts.select(D.year_month_index(F.col("t"))).collect()] == [1, 36, 37]
    assert [r[0] for r in ts.select(D.year_month_index(F.col("t"), compat=True)).collect()] == [1, 36, -83]


def test_folds_partition_rows(spark):
    df = spark.range(4498).select(F.col("id").alias("row"))
    f = S.assign_folds(df)
    sizes = sorted((r["count"] for r in f.groupBy("fold").count().collect()), reverse=True)
    assert sizes == [900, 900, 900, 899, 899] and f.select("row").distinct().count() == 4498


def test_split_table_sizes(spark):
    df = spark.range(100).select(F.col("id").alias("row"))
    sp = S.split_table(S.assign_folds(df))
    c = {(r.fold, r.split): r.n_rows for r in S.split_counts(sp).collect()}
    assert c[(0, "test")] == 20 and c[(0, "val")] == 10 and c[(0, "train")] == 70
    # every row is test exactly once
    assert sp.where("split = 'test'").groupBy("row").count().where("count != 1").count() == 0


def test_exact_quantiles_equal_percentile(spark, monkeypatch):
    """Ties, nulls, one-value and one-row groups, null groups, extreme and many distinct values."""
    import random
    rng = random.Random(3)
    rows = [(g, v) for g, values in {
        "ties": [rng.choice([1.0, 1.0, 2.0, 5.0]) for _ in range(500)], "same": [7.0] * 90, "one": [3.5], "two": [1.0, 2.0],
        "wide": [rng.gauss(0, 1) * 10 ** rng.randrange(-300, 300) for _ in range(3000)], "nulls": [None, 4.0, None, 6.0, -0.0], "none": [None],
        None: [float(k) for k in range(37)], "inf": [float("inf"), float("-inf"), 1.0, 2.0, 3.0]}.items() for v in values]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    expected = {r.g: (r.n, r.p) for r in df.groupBy("g").agg(F.count("value").alias("n"), F.percentile("value", F.array(*map(F.lit, shares))).alias("p")).collect()}
    for sketch in (10_000, 20):                       # a coarse sketch: wide brackets, the same result
        monkeypatch.setattr(L, "SKETCH", sketch)
        got = {r.g: (r.n, r.q) for r in L.exact_quantiles(df, ["g"], quantiles=shares).collect()}
        assert got == {g: v for g, v in expected.items() if v[0]}
    plan = L.cut_points(df.withColumnRenamed("value", "x"), ["x"])._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_set" not in plan
    empty = L.cut_points(df.limit(0).withColumnRenamed("value", "x"), ["x"]).collect()
    assert [tuple(r) for r in empty] == [(None, None)]


def test_train_cut_points_leave_the_fold_out(spark):
    rows = [(i, i % 5, float((i * 37) % 101)) for i in range(200)] + [(200, 0, 1e9), (201, 1, None)]
    df = spark.createDataFrame(rows, "row long, fold int, x double")
    import numpy as np
    cuts = {r.fold: (r.x_q1, r.x_q2) for r in L.fold_cut_points(df, ["x"]).collect()}
    for k in range(5):
        values = [v for _, f, v in rows if f != k and v is not None]
        assert np.allclose(cuts[k], np.quantile(values, [0.25, 0.75]))
    labels = {(r.row, r.fold): r.x_class for r in L.fold_labels(df, ["x"]).collect()}
    assert len(labels) == 5 * 202 and labels[201, 3] is None and labels[200, 0] == "high"
    for i, _, v in rows[:200]:
        assert labels[i, 2] == ("small" if v <= cuts[2][0] else "moderate" if v <= cuts[2][1] else "high")

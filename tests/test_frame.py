"""Exact distributed numbering, dedup and frame helpers."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from postresp.operators import frame as B
from postresp.operators.clean import after_year, dedup_first


def test_row_number_exact_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = B.row_number_exact(df, "k", "rn", num_partitions=7).select("k", "rn")
    ref = df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("rn"))
    assert got.exceptAll(ref).count() == 0 and got.count() == 5000


def test_rank_within_groups(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), F.col("id"))
    got = B.rank_within(df, "g", ["id"], "r")
    ref = df.select("g", "id", (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).alias("r"))
    assert got.select("g", "id", "r").exceptAll(ref).count() == 0


def test_ntile_index_matches_sql_ntile(spark):
    n = 4498
    df = spark.range(n).select(F.col("id").alias("r"))
    got = df.select("r", B.ntile_index(F.col("r"), F.lit(n), 5).alias("f"))
    ref = df.select("r", (F.ntile(5).over(Window.orderBy("r")) - 1).alias("f"))
    assert got.exceptAll(ref).count() == 0
    sizes = sorted((r["count"] for r in got.groupBy("f").count().collect()), reverse=True)
    assert sizes == [900, 900, 900, 899, 899]


def test_dedup_keeps_first_and_handles_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "post_id long, text string").repartition(6)
    out = {r.text: r.post_id for r in dedup_first(df).collect()}
    assert out["hot"] == 0 and out["t1"] == 1 and len(out) == 1 + len({i % 50 for i in range(3000) if i % 3})


def test_after_year_keeps_nulls(spark):
    df = spark.createDataFrame([(2015,), (2017,), (None,)], "year int")
    assert sorted(r.year or 0 for r in after_year(df, 2016).collect()) == [0, 2017]


def test_drop_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    out = B.drop_duplicate_columns(df)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (1, 2)


def test_stage_ledger(spark):
    df = spark.range(10)
    led = {r.stage: r.n_rows for r in B.stage_ledger([(df, {"all": F.count(F.lit(1)), "even": F.count_if(F.col("id") % 2 == 0)}), (df.where("id < 3"), {"few": F.count(F.lit(1))})]).collect()}
    assert led == {"all": 10, "even": 5, "few": 3}


def test_rank_within_large_and_null_groups(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("g"), F.col("id") % 13)).alias("g"),
        (F.col("id") * 7919 % 3001).alias("k"))
    got = B.rank_within(df, "g", "k", "r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.exceptAll(ref).count() == 0 and got.count() == 3000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_one_pass_ledger(spark):
    """Every stage counted by filtering frame after frame; the query's plan reads each table once."""
    from postresp.operators.clean import after_year, clean_posts, marked_posts
    from postresp.plans.catalog import b9_stage_ledger
    from tests.conftest import SF_SMALL
    long = "the quick brown foxes jump over many lazy sleeping dogs near rivers"
    rows = [(1, long, 2018), (2, long, 2019), (3, long, 2010), (4, None, 2018), (5, "short", 2018), (6, "DELETE " + long, 2018),
            (7, long + "  again", None), (8, "", None), (9, long + " again", 2020), (10, "only old  " + long, 2015)]
    df = spark.createDataFrame(rows, "post_id long, text string, year int")
    kept = clean_posts(after_year(df, 2016), dedup=False)
    marked = marked_posts(df, 2016)
    led = {r.stage: r.n_rows for r in B.stage_ledger([(marked, {
        "posts": F.count(F.lit(1)), "after_year": F.count_if("_in_years"), "after_removal": F.count_if("_kept"),
        "after_dedup": F.countDistinct("_text")})]).collect()}
    assert led == {"posts": 10, "after_year": 8, "after_removal": kept.count(), "after_dedup": clean_posts(after_year(df, 2016)).count()}
    assert led["after_removal"] == 4 and led["after_dedup"] == 2
    empty = {r.stage: r.n_rows for r in B.stage_ledger([(marked_posts(df.limit(0), 2016), {"all": F.count(F.lit(1)), "kept": F.count_if("_kept")})]).collect()}
    assert empty == {"all": 0, "kept": 0}
    plan = b9_stage_ledger(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(c) <= 1 for c in ("Relation [doc_id", "Relation [o_orderkey", "Relation [l_orderkey")), plan


def test_feature_tables_join_buckets_without_a_shuffle(spark):
    from postresp.operators.experiment import grid_inputs
    from postresp.plans import catalog as C
    from tests.conftest import SF_SMALL
    posts = C._prepared_ns(spark, SF_SMALL)
    folds = C._folded(spark, SF_SMALL)
    emb = posts.select("row", F.array(F.col("row").cast("double"), F.lit(0.5)).alias("embedding"), F.lit("v").alias("feature_set"),
                       (F.col("row") % 2).cast("int").alias("fold"))
    base, vectors = grid_inputs(posts, folds, emb, buckets=5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = C.X.feature_table(base, None, vectors, "v", fold=1, mixed=True)
        rows = sorted((r.row, r.features) for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        plain = C.X.feature_table(posts, folds, emb, "v", fold=1, mixed=True)
        assert rows == sorted((r.row, r.features) for r in plain.collect()) and rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_feature_table_prepares_the_posts_once(spark, monkeypatch):
    from postresp.plans import catalog as C
    from tests.conftest import SF_SMALL
    calls, plain = [], C.prepare_posts
    monkeypatch.setattr(C, "prepare_posts", lambda *a, **kw: calls.append(1) or plain(*a, **kw))
    assert C.g1_bucketed_feature_table(spark, SF_SMALL).count() > 0 and len(calls) == 1

"""Embeddings (H), sources/sinks (A) and permutation Shapley (L3)."""
import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from postresp.operators import embed as H
from postresp.operators import explain as XP
from postresp.operators import splits as S
from postresp.session import scratch_path
from postresp.sources import io as A


def test_char_ngrams(spark):
    df = spark.createDataFrame([(["ab", "word"],)], "w array<string>")
    got = df.select(H.char_ngrams(F.col("w"))).first()[0]
    assert got == ["<ab", "ab>", "<wo", "wor", "ord", "rd>", "<ab>", "<wor", "word", "ord>", "<word", "word>"]


def test_half_precision(spark):
    df = spark.createDataFrame([([0.1, 1.0 / 3.0, 65504.0],)], "v array<float>")
    got = df.select(H.half_precision(F.col("v"))).first()[0]
    assert got == [float(np.float16(x)) for x in (0.1, 1.0 / 3.0, 65504.0)]


def test_subword_fold_embeddings(spark):
    rows = [(i, f"post number {i} about topic {i % 7} and more words") for i in range(60)]
    prepared = spark.createDataFrame(rows, "row long, sentence string")
    splits = S.split_table(S.assign_folds(prepared.select("row")))
    emb = H.fold_embeddings(prepared, splits, "subword", folds=[0, 1], dim=256)
    assert emb.count() == 120 and emb.select("fold").distinct().count() == 2
    norms = [float(np.linalg.norm(r.embedding)) for r in emb.collect()]
    # L2-normalised, or all-zero when every n-gram occurs in every training post
    assert all(abs(n - 1.0) < 1e-2 or n == 0.0 for n in norms) and max(norms) > 0.99


def test_batch_embed_stand_in(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "row long, sentence string")
    out = {r.row: r.embedding for r in H.batch_embed(df, dim=8).collect()}
    assert out[1] == out[2] and out[1] != out[3] and len(out[3]) == 8


ODD = ["one\rtwo words", " _URL hello ", 'say "hi"', "tab\there", "two\nlines", "a,b;c", "\\ back", "\r\n", "é漢 …", "''", "#"]


def test_split_files_round_trip(spark):
    prepared = spark.createDataFrame([(i, f"{ODD[i % len(ODD)]}{i}", "small") for i in range(50)],
                                     "row long, sentence string, likes string")
    splits = S.split_table(S.assign_folds(prepared.select("row")))
    path = scratch_path(spark, "test-split-files")
    A.write_split_files(prepared, splits, path, targets=["likes"])
    back = A.read_split_files(spark, path)
    assert back.count() == splits.count()
    assert back.where("label != '__label__small'").count() == 0
    texts = {r.row: r.sentence for r in prepared.collect()}
    assert all(texts[r.row] == r.sentence for r in back.collect())


def test_split_files_are_compressed_and_leave_the_session_as_it_was(spark, tmp_path):
    prepared = spark.createDataFrame([(i, f"some words {i}", "small") for i in range(20)], "row long, sentence string, likes string")
    before = spark.conf.get(A._OPEN_FILES)
    A.write_split_files(prepared, S.split_table(S.assign_folds(prepared.select("row"))), str(tmp_path / "s"), targets=["likes"])
    parts = [p for p in (tmp_path / "s").rglob("part-*")]
    assert parts and all(p.name.endswith(".csv.gz") for p in parts) and spark.conf.get(A._OPEN_FILES) == before
    assert {p.parent.name for p in parts} == {"split=train", "split=val", "split=test"}


def test_posts_as_text_round_trip(spark):
    rows = [(i, t, i % 2 == 0) for i, t in enumerate([*ODD, "", None, "  ", '"'])]
    schema = A.T.StructType([f for f in A.POSTS_SCHEMA if f.name in ("post_id", "text", "has_media")])
    path = scratch_path(spark, "test-posts-csv")
    A.write_table(spark.createDataFrame(rows, schema), path, fmt="csv")
    assert sorted(tuple(r) for r in A.read_posts(spark, path, "csv", schema).collect()) == rows


def test_half_precision_of_nulls_and_lengths(spark):
    df = spark.createDataFrame([(0, [0.1]), (1, None), (2, []), (3, [0.2, 0.3])], "i int, v array<float>")
    got = {r.i: r.h for r in df.select("i", H.half_precision(F.col("v")).alias("h")).collect()}
    assert got[1] is None and got[2] == [] and got[3] == [float(np.float16(x)) for x in (0.2, 0.3)]


def test_permutation_shap_telescopes(spark):
    from pyspark.ml.classification import LogisticRegression
    rng = np.random.default_rng(0)
    X = rng.normal(size=(120, 3))
    y = (X[:, 0] + X[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), X[i].tolist()) for i in range(120)],
                               "row long, label double, f array<double>") \
        .withColumn("features", array_to_vector("f"))
    model = LogisticRegression().fit(df)
    rows, bg = df.where("row < 5"), df.where("row = 7")
    phi = XP.permutation_shap(model, rows, bg, 3, n_samples=20, n_classes=2)
    s = {(r.row, r["class"]): r.s for r in phi.groupBy("row", "class").agg(F.sum("phi").alias("s")).collect()}
    p = {r.row: r.p for r in model.transform(df.where("row < 5 OR row = 7"))
         .select("row", vector_to_array("probability").alias("p")).collect()}
    for (row, c), v in s.items():
        assert abs(v - (p[row][c] - p[7][c])) < 1e-9


def test_signed_projection_adds_each_bucket_to_one_place(spark):
    from pyspark.ml.linalg import Vectors
    vs = [Vectors.sparse(100, {3: 2.0}), Vectors.sparse(100, {7: -1.5}), Vectors.sparse(100, {3: 2.0, 7: -1.5}), Vectors.sparse(100, {}),
          Vectors.dense([0.0] * 3 + [2.0] + [0.0] * 96)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], ["i", "v"])
    got = {r.i: np.array(r.e) for r in df.select("i", H.signed_projection(F.col("v"), 8).alias("e")).collect()}
    assert sorted(np.abs(got[0]))[-1] == 2.0 and (got[0] != 0).sum() == 1 and (got[4] == got[0]).all()
    assert np.allclose(got[2], got[0] + got[1]) and not got[3].any()


def test_vocabulary_is_bounded_and_no_word_is_dropped(spark):
    rows = [(i, ["common", "often" if i % 2 else "other", f"rare{i}"]) for i in range(200)] + [(999, [])]
    df = spark.createDataFrame(rows, "row long, words array<string>")
    same = H.bounded_vocabulary(df, 1000)
    assert sorted(map(tuple, ((r.row, tuple(r.words)) for r in same.collect()))) == sorted((i, tuple(w)) for i, w in rows)
    few = {r.row: r.words for r in H.bounded_vocabulary(df, 20).collect()}
    forms = {w for ws in few.values() for w in ws}
    assert len(few) == 201 and len(forms) <= 20 and {"common", "often", "other"} <= forms
    assert all(len(few[i]) == len(w) and few[i][:2] == w[:2] for i, w in rows if w) and few[999] == []


def test_batch_and_word2vec_folds(spark):
    prepared = spark.createDataFrame([(i, f"word{i % 5} other text {i}") for i in range(60)], "row long, sentence string")
    splits = S.split_table(S.assign_folds(prepared.select("row")))
    for name in ("batch", "word2vec"):
        e = H.fold_embeddings(prepared, splits, name, dim=8)
        assert e.groupBy("fold").count().orderBy("fold").collect() == [(k, 60) for k in range(5)]
        assert e.where(F.size("embedding") != 8).count() == 0


def test_replacing_a_set_leaves_the_files_of_others(spark, tmp_path):
    path = str(tmp_path / "sets")
    rows = [("likes", s, f, i, [float(i)]) for s in ("a", "b") for f in (0, 1) for i in range(6)]
    schema = "target string, feature_set string, fold int, row long, embedding array<float>"
    A.replace_embeddings(spark.createDataFrame(rows, schema), path)
    files = lambda s: {p: p.stat().st_mtime_ns for p in (tmp_path / "sets").glob(f"target=likes/feature_set={s}/**/*.parquet")}
    before, old = files("a"), files("b")
    new = spark.createDataFrame([("likes", "b", 1, 9, [1.0, 2.0])], schema)
    for _ in range(2):                                   # a run that is repeated changes nothing
        A.replace_embeddings(new, path)
        assert files("a") == before
        got = sorted((r.feature_set, r.fold, r.row) for r in A.read_embedding_set(spark, path).collect())
        assert got == sorted([(s, f, i) for _, s, f, i, _ in rows if (s, f) != ("b", 1)] + [("b", 1, 9)])
    assert {p for p in files("b") if "fold=0" in str(p)} == {p for p in old if "fold=0" in str(p)}

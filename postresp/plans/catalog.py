"""Registered queries: one per operator of SURVEY §2 that yields a table.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the operator has an
SQL form, ``ORACLE[name]`` -- DuckDB SQL over the driver's tables that must
give the same rows.  Every query reads the driver tables (through the
``posts`` view or directly), so its work grows with them.

Text queries in the SQL-checked set run with ``squeeze=False``: squeezing
(C6) needs regex back-references, which DuckDB's RE2 lacks; it is covered by
golden literals in the tests and by the unchecked full-pipeline queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postresp.functions import text as T
from postresp.operators import labels as L
from postresp.operators.clean import after_year, clean_posts, dedup_first, marked_posts
from postresp.plans import oracle_sql as O
from postresp.plans.prepare import CUTOFF_YEAR, cleaned_posts, prepare_posts
from postresp.session import scratch_path, stored
from postresp.sources import io as A
from postresp.sources.posts import POST_COLUMNS, posts, read_table, with_posts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _clean_ns(spark, d, **kw) -> DataFrame:
    """Cleaned posts without squeezing (the SQL-checkable variant)."""
    return cleaned_posts(posts(spark, d), squeeze=False, **kw)


_CLEAN_CTE = O.cleaned_posts_cte("cleaned", cutoff_year=CUTOFF_YEAR)
_CLEAN_ND_CTE = O.cleaned_posts_cte("cleaned_nd", cutoff_year=CUTOFF_YEAR, dedup=False)
_CLEAN_ND_NC_CTE = O.cleaned_posts_cte("cleaned_nc", cutoff_year=CUTOFF_YEAR, dedup=False,
                                       compat=False)
_NO_TS = [c for c in POST_COLUMNS if c != "ts"]

# ---------------------------------------------------------------- A / B ----


@register("a1_posts", with_posts("SELECT * EXCLUDE (ts) FROM posts"))
def a1_posts(spark, d):
    """Posts written as delimited text and read back through the declared schema."""
    path = scratch_path(spark, f"io/posts-{uuid.uuid4().hex}")
    A.write_table(posts(spark, d), path, fmt="csv")
    return A.read_posts(spark, path, fmt="csv").select(*_NO_TS)


@register("b1_after_year", with_posts(
    f"SELECT post_id, year FROM posts WHERE year IS NULL OR year > {CUTOFF_YEAR}"))
def b1_after_year(spark, d):
    return after_year(posts(spark, d), CUTOFF_YEAR).select("post_id", "year")


@register("b7_sentinel_dropped", with_posts(
    "SELECT post_id FROM cleaned_nc ANTI JOIN cleaned_nd USING (post_id)",
    _CLEAN_ND_CTE, _CLEAN_ND_NC_CTE))
def b7_sentinel_dropped(spark, d):
    """Posts kept by the token rules but dropped because their text has DELETE."""
    p = after_year(posts(spark, d), CUTOFF_YEAR)
    loose = clean_posts(p, squeeze=False, dedup=False, compat=False)
    strict = clean_posts(p, squeeze=False, dedup=False, compat=True)
    return loose.join(strict, "post_id", "left_anti").select("post_id")


# ---------------------------------------------------------------- C --------
_CLEAN_EXPR = O.clean_text_sql("text")
_STRIP_EXPR = O.strip_sql(_CLEAN_EXPR)


def _text_cols(spark, d):
    p = posts(spark, d).select("post_id", "text")
    p = p.withColumn("_clean", T.clean_text(F.col("text"), squeeze=False))
    return p.withColumn("_strip", T.strip_low_content(F.col("_clean")))


@register("c1_c5_links", with_posts(
    f"SELECT post_id, md5({O.replace_links_sql('text')}) AS h FROM posts"))
def c1_c5_links(spark, d):
    return posts(spark, d).select("post_id", F.md5(T.replace_links(F.col("text"))).alias("h"))


@register("c7_clean_text", with_posts(f"SELECT post_id, md5({_CLEAN_EXPR}) AS h FROM posts"))
def c7_clean_text(spark, d):
    return _text_cols(spark, d).select("post_id", F.md5("_clean").alias("h"))


@register("c8_strip", with_posts(f"SELECT post_id, md5({_STRIP_EXPR}) AS h FROM posts"))
def c8_strip(spark, d):
    return _text_cols(spark, d).select("post_id", F.md5("_strip").alias("h"))


@register("c9_tokenize", with_posts(
    f"SELECT post_id, CAST(len({O.tokens_sql(_STRIP_EXPR)}) AS INTEGER) AS n_tokens FROM posts"))
def c9_tokenize(spark, d):
    return _text_cols(spark, d).select("post_id", F.size(T.tokenize(F.col("_strip"))).alias("n_tokens"))


@register("c10_content_tokens", with_posts(
    f"SELECT post_id, {O.content_tokens_sql(_STRIP_EXPR)} AS tokens FROM posts"))
def c10_content_tokens(spark, d):
    return _text_cols(spark, d).select("post_id", T.count_content_tokens(F.col("_strip")).alias("tokens"))


@register("c11_plain_words", with_posts(
    f"SELECT post_id, {O.plain_words_sql(_STRIP_EXPR)} AS n_words FROM posts"))
def c11_plain_words(spark, d):
    return _text_cols(spark, d).select("post_id", T.count_plain_words(F.col("_strip")).alias("n_words"))


@register("c12_keep", with_posts(
    f"SELECT post_id, {O.content_tokens_sql(_STRIP_EXPR)} > {T.TOKEN_THRESHOLD} "
    f"AND {O.plain_words_sql(_STRIP_EXPR)} > 0 AS keep FROM posts"))
def c12_keep(spark, d):
    s = _text_cols(spark, d)
    s = s.withColumn("_t", T.count_content_tokens(F.col("_strip"))) \
         .withColumn("_w", T.count_plain_words(F.col("_strip")))
    return s.select("post_id", T.keep_post(F.col("_t"), F.col("_w")).alias("keep"))


@register("c13_collapse", with_posts(
    f"SELECT post_id, md5({O.collapse_sql(_CLEAN_EXPR)}) AS h FROM posts"))
def c13_collapse(spark, d):
    return _text_cols(spark, d).select("post_id", F.md5(T.collapse_spaces(F.col("_clean"))).alias("h"))


@register("c14_dedup_documents", """
SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def c14_dedup_documents(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return dedup_first(docs, "text", "doc_id").select("doc_id")


@register("c15_clean_posts", with_posts(
    "SELECT post_id, md5(text) AS h, tokens FROM cleaned", _CLEAN_CTE))
def c15_clean_posts(spark, d):
    return _clean_ns(spark, d).select("post_id", F.md5("text").alias("h"), "tokens")


@register("c15_clean_posts_squeezed")
def c15_clean_posts_squeezed(spark, d):
    """Full C1-C14 with squeezing (Java back-references; no SQL form)."""
    return cleaned_posts(posts(spark, d)).select("post_id", F.md5("text").alias("h"), "tokens")


# ---------------------------------------------------------------- E --------
_CUTS_SQL = ", ".join(
    f"quantile_cont(CAST({t} AS DOUBLE), 0.25) AS {t}_q1, quantile_cont(CAST({t} AS DOUBLE), 0.75) AS {t}_q2"
    for t in L.TARGETS)


def _label_sql(t: str) -> str:
    v = f"CAST(trunc({t}) AS BIGINT)"
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= {t}_q1 THEN 'small' "
            f"WHEN {v} <= {t}_q2 THEN 'moderate' ELSE 'high' END")


_LABELLED_CTE = f"""cuts AS (SELECT {_CUTS_SQL} FROM cleaned),
labelled AS (SELECT cleaned.*, {", ".join(f"{_label_sql(t)} AS {t}_class" for t in L.TARGETS)}
             FROM cleaned CROSS JOIN cuts)"""


@register("e1_cut_points", with_posts("SELECT * FROM cuts", _CLEAN_CTE,
                                      f"cuts AS (SELECT {_CUTS_SQL} FROM cleaned)"))
def e1_cut_points(spark, d):
    return L.cut_points(_clean_ns(spark, d))


@register("e2_labels", with_posts(
    "SELECT post_id, replies_class, likes_class, retweets_class FROM labelled",
    _CLEAN_CTE, _LABELLED_CTE))
def e2_labels(spark, d):
    return L.add_labels(_clean_ns(spark, d)).select(
        "post_id", *[f"{t}_class" for t in L.TARGETS])


_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS target, {t}_class AS label, count(*) AS n FROM labelled GROUP BY {t}_class"
    for t in L.TARGETS)


@register("e2_label_counts", with_posts(_COUNTS_SQL, _CLEAN_CTE, _LABELLED_CTE))
def e2_label_counts(spark, d):
    return L.label_counts(L.add_labels(_clean_ns(spark, d)))


@register("prepare_label_counts")
def prepare_label_counts(spark, d):
    """Flagship: posts per class after the full cleaning (with squeezing).

    Goes through the prepared table: its checkpoint is the one materialisation
    of the cleaned posts that both the cut points and the labels read."""
    return L.label_counts(prepare_posts(posts(spark, d)), suffix="")


_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS target, year, CAST({t} AS DOUBLE) AS value FROM posts" for t in L.TARGETS)


@register("e3_box_stats", with_posts(f"""
SELECT q.target, q.year, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(coalesce(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), q1), 6) AS whisker_low,
       round(coalesce(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), q3), 6) AS whisker_high
FROM q JOIN long_v USING (target, year)
GROUP BY q.target, q.year, q.n, q1, median, q3""",
    f"long_v AS (SELECT * FROM ({_LONG_SQL}) WHERE value IS NOT NULL AND year IS NOT NULL)",
    """q AS (SELECT target, year, count(*) AS n, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
             FROM long_v GROUP BY target, year)"""))
def e3_box_stats(spark, d):
    b = L.box_stats(posts(spark, d))
    return b.select("target", "year", "n", *[F.round(c, 6).alias(c) for c in
                                            ["q1", "median", "q3", "whisker_low", "whisker_high"]])


@register("e4_years", with_posts("SELECT DISTINCT year FROM posts"))
def e4_years(spark, d):
    return L.distinct_values(posts(spark, d), "year")


@register("e5_label_codes", with_posts("""
SELECT post_id, likes_class,
       CAST(CASE likes_class WHEN 'small' THEN 0 WHEN 'moderate' THEN 1 WHEN 'high' THEN 2 END AS INTEGER) AS code,
       likes_class AS decoded
FROM labelled""", _CLEAN_CTE, _LABELLED_CTE))
def e5_label_codes(spark, d):
    lab = L.add_labels(_clean_ns(spark, d))
    code = L.encode_label(F.col("likes_class"))
    return lab.select("post_id", "likes_class", code.alias("code")) \
              .withColumn("decoded", L.decode_label(F.col("code")))


# ------------------------------------------------- prepared table: B --------
from postresp.functions import features as D  # noqa: E402
from postresp.operators import frame as B  # noqa: E402
from postresp.operators import splits as S  # noqa: E402
from postresp.plans.prepare import SIDE_COLUMNS  # noqa: E402

_PREPARED_CTE = _LABELLED_CTE + f""",
prepared AS (
  SELECT replies_class AS replies, likes_class AS likes, retweets_class AS retweets,
         text AS sentence, CAST(row_number() OVER (ORDER BY post_id) - 1 AS BIGINT) AS row,
         post_id, tokens, {", ".join(SIDE_COLUMNS)}
  FROM labelled)"""


def _prepared_ns(spark, d) -> DataFrame:
    return prepare_posts(posts(spark, d), squeeze=False)


def _prep_sql(body: str, *more: str) -> str:
    return with_posts(body, _CLEAN_CTE, _PREPARED_CTE, *more)


@register("b2_prepared", _prep_sql("SELECT * FROM prepared"))
def b2_prepared(spark, d):
    return _prepared_ns(spark, d)


@register("b3_row_number", _prep_sql("SELECT row, post_id FROM prepared"))
def b3_row_number(spark, d):
    return _prepared_ns(spark, d).select("row", "post_id")


@register("b5_head", _prep_sql("SELECT row, post_id FROM prepared ORDER BY row LIMIT 100"))
def b5_head(spark, d):
    return B.head_rows(_prepared_ns(spark, d).select("row", "post_id"), 100, "row")


@register("b6_label_prefix", _prep_sql(
    "SELECT row, " + ", ".join(f"'__label__' || {t} AS {t}" for t in L.TARGETS) + " FROM prepared"))
def b6_label_prefix(spark, d):
    return B.prefix_labels(_prepared_ns(spark, d).select("row", *L.TARGETS), L.TARGETS)


@register("b9_stage_ledger", with_posts(
    f"""SELECT 'posts' AS stage, count(*) AS n_rows FROM posts
UNION ALL SELECT 'after_year', count(*) FROM posts WHERE year IS NULL OR year > {CUTOFF_YEAR}
UNION ALL SELECT 'after_removal', count(*) FROM cleaned_nd
UNION ALL SELECT 'after_dedup', count(*) FROM cleaned""", _CLEAN_ND_CTE, _CLEAN_CTE))
def b9_stage_ledger(spark, d):
    """All four stages counted in one pass over the posts."""
    marked = marked_posts(posts(spark, d), CUTOFF_YEAR, squeeze=False)
    return B.stage_ledger([(marked, {
        "posts": F.count(F.lit(1)), "after_year": F.count_if("_in_years"), "after_removal": F.count_if("_kept"),
        "after_dedup": F.countDistinct("_text")})])


# ------------------------------------------------- structured features: D ---
_STRUCT_SQL = """
SELECT row,
       CAST(to_timestamp(timestamp_epochs) AS TIMESTAMP) AS ts_parsed,
       coalesce(length(hashtags) > 4, false) AS has_hash,
       coalesce(length(links) > 4, false) AS has_url,
       coalesce(contains(sentence, 'URL'), false) AS has_url2,
       coalesce(contains(sentence, '_RETWEET'), false) AS has_retweet,
       CAST((year(to_timestamp(timestamp_epochs)) - 2017) * 12 + month(to_timestamp(timestamp_epochs)) AS INTEGER) AS ym,
       CAST((CAST(substr(CAST(year(to_timestamp(timestamp_epochs)) AS VARCHAR), 4) AS INTEGER) - 7) * 12
            + month(to_timestamp(timestamp_epochs)) AS INTEGER) AS ym_compat
FROM prepared"""


def _structured(spark, d) -> DataFrame:
    return D.add_structured(_prepared_ns(spark, d))


@register("d1_d4_structured", _prep_sql(
    "SELECT row, CAST(ts_parsed AS VARCHAR) AS ts_parsed, has_hash, has_url, has_url2, has_retweet, ym, "
    f"ym_compat FROM ({_STRUCT_SQL})"))
def d1_d4_structured(spark, d):
    s = _structured(spark, d)
    return s.select("row", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts_parsed"),
                    "has_hash", "has_url", "has_url2", "has_retweet", "ym",
                    D.year_month_index(F.col("timestamp"), compat=True).alias("ym_compat"))


@register("d5_flag_percentages", _prep_sql(
    "SELECT flag, pct FROM (SELECT "
    + ", ".join(f"round(100.0 * sum(CAST({c} AS INTEGER)) / count(*), 2) AS {n}" for n, c in D.FLAG_REPORT)
    + f" FROM ({_STRUCT_SQL.replace('SELECT row,', 'SELECT row, has_media, is_reply_to,', 1)})) "
    + "UNPIVOT (pct FOR flag IN (" + ", ".join(n for n, _ in D.FLAG_REPORT) + "))"))
def d5_flag_percentages(spark, d):
    return D.flag_percentages(_structured(spark, d))


def _with_embedding(spark, d) -> DataFrame:
    emb = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    return B.attach_by_row(_structured(spark, d), emb, "row", "left")


@register("d6_d7_feature_union", _prep_sql(
    "SELECT row, CAST(len(f) AS INTEGER) AS n_features, round(list_sum(f), 4) AS f_sum FROM ("
    "SELECT s.row, list_concat(CAST(e.embedding AS DOUBLE[]), [CAST(s.has_media AS DOUBLE), "
    "CAST(s.has_hash AS DOUBLE), CAST(s.has_url2 AS DOUBLE), CAST(s.is_reply_to AS DOUBLE), "
    "CAST(s.has_retweet AS DOUBLE), CAST(s.ym AS DOUBLE)]) AS f "
    f"FROM ({_STRUCT_SQL.replace('SELECT row,', 'SELECT row, has_media, is_reply_to,', 1)}) s "
    "JOIN embeddings e ON e.vec_id = s.row)"))
def d6_d7_feature_union(spark, d):
    j = _with_embedding(spark, d).where(F.col("embedding").isNotNull())
    f = D.feature_union(F.col("embedding"), D.structured_vector())
    return j.select("row", f.alias("f")).select(
        "row", F.size("f").alias("n_features"),
        F.round(F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x), 4).alias("f_sum"))


# ------------------------------------------------- splits: F ----------------
_FOLDS_CTE = """folds AS (
  SELECT row, CAST(ntile(5) OVER (ORDER BY md5('13:' || CAST(row AS VARCHAR)), row) - 1 AS INTEGER) AS fold
  FROM prepared)"""
_SPLITS_CTE = """pairs AS (SELECT f.row, f.fold, CAST(k.k AS INTEGER) AS k FROM folds f CROSS JOIN range(5) AS k(k)),
tr AS (SELECT row, k, row_number() OVER (PARTITION BY k ORDER BY md5('13:' || CAST(k AS VARCHAR) || ':' || CAST(row AS VARCHAR)), row) - 1 AS rk,
              count(*) OVER (PARTITION BY k) AS nt FROM pairs WHERE fold <> k),
splits AS (
  SELECT row, k AS fold, CASE WHEN rk < ceil(0.125 * nt) THEN 'val' ELSE 'train' END AS split FROM tr
  UNION ALL SELECT row, k AS fold, 'test' AS split FROM pairs WHERE fold = k)"""


_TRAIN_CUTS = ", ".join(f"quantile_cont({t}, {q}) AS {t}_q{i}" for t in L.TARGETS for i, q in ((1, 0.25), (2, 0.75)))
_TRAIN_LABELS = ", ".join(
    f"CASE WHEN trunc({t}) <= {t}_q1 THEN 'small' WHEN trunc({t}) <= {t}_q2 THEN 'moderate' ELSE 'high' END AS {t}_class" for t in L.TARGETS)
_NUMBERED_CTE = """numbered AS (
  SELECT replies, likes, retweets, CAST(row_number() OVER (ORDER BY post_id) - 1 AS BIGINT) AS row FROM cleaned),
folded AS (
  SELECT *, CAST(ntile(5) OVER (ORDER BY md5('13:' || CAST(row AS VARCHAR)), row) - 1 AS INTEGER) AS fold FROM numbered),
of_fold AS (SELECT k.k AS fold, replies, likes, retweets FROM folded JOIN range(5) AS k(k) ON k.k <> fold),
""" + f"train_cuts AS (SELECT CAST(fold AS INTEGER) AS fold, {_TRAIN_CUTS} FROM of_fold GROUP BY fold)"


def _numbered_folds(spark, d) -> DataFrame:
    """``row, fold`` and the numeric responses."""
    numbered = B.row_number_exact(_clean_ns(spark, d).select("post_id", *L.TARGETS), "post_id")
    return S.assign_folds(numbered)


@register("e1_cut_points_train", with_posts("SELECT * FROM train_cuts", _CLEAN_CTE, _NUMBERED_CTE))
def e1_cut_points_train(spark, d):
    """Cut points of each fold from the rows of the other folds."""
    return L.fold_cut_points(_numbered_folds(spark, d))


@register("e2_labels_train", with_posts(
    f"SELECT row, c.fold AS fold, {_TRAIN_LABELS} FROM numbered CROSS JOIN train_cuts c", _CLEAN_CTE, _NUMBERED_CTE))
def e2_labels_train(spark, d):
    """Labels of every row under each fold's training cut points."""
    return L.fold_labels(_numbered_folds(spark, d))


def _folded(spark, d) -> DataFrame:
    """``(row, fold, <target labels>)`` -- narrow: texts are not carried."""
    return S.assign_folds(_prepared_ns(spark, d).select("row", *L.TARGETS))


@register("f1_folds", _prep_sql("SELECT row, fold FROM folds", _FOLDS_CTE))
def f1_folds(spark, d):
    return _folded(spark, d).select("row", "fold")


@register("f1_fold_sizes", _prep_sql("SELECT fold, count(*) AS n_rows FROM folds GROUP BY fold", _FOLDS_CTE))
def f1_fold_sizes(spark, d):
    return _folded(spark, d).groupBy("fold").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


@register("f2_f3_splits", _prep_sql("SELECT row, fold, split FROM splits", _FOLDS_CTE, _SPLITS_CTE))
def f2_f3_splits(spark, d):
    return S.split_table(_folded(spark, d).select("row", "fold"))


@register("f3_split_counts", _prep_sql(
    "SELECT fold, split, count(*) AS n_rows FROM splits GROUP BY fold, split", _FOLDS_CTE, _SPLITS_CTE))
def f3_split_counts(spark, d):
    return S.split_counts(S.split_table(_folded(spark, d).select("row", "fold")))


# ------------------------------------------------- joins: G -----------------
@register("g1_attach_embeddings", _prep_sql(
    "SELECT p.row, p.post_id, CAST(len(e.embedding) AS INTEGER) AS emb_dim, e.label "
    "FROM prepared p LEFT JOIN embeddings e ON e.vec_id = p.row"))
def g1_attach_embeddings(spark, d):
    emb = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding", "label")
    j = B.attach_by_row(_prepared_ns(spark, d).select("row", "post_id"), emb, "row", "left")
    return j.select("row", "post_id",
                    F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("emb_dim"), "label")


@register("g1_bucketed_feature_table", _prep_sql(
    "SELECT p.row, f.fold, CAST(len(e.embedding) AS INTEGER) + 6 AS n_features, "
    "round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total "
    "FROM prepared p JOIN folds f USING (row) JOIN embeddings e ON e.vec_id = p.row", _FOLDS_CTE))
def g1_bucketed_feature_table(spark, d):
    """Posts, folds and embeddings written once in buckets of ``row``; the feature
    table, as every other one of the grid, is then a join without a shuffle."""
    emb = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding", F.lit("vectors").alias("feature_set"))
    prepared = _prepared_ns(spark, d)           # posts and folds from one preparation
    base, emb = X.grid_inputs(prepared, S.assign_folds(prepared.select("row")), emb)
    table = X.feature_table(base, None, emb, "vectors", mixed=True)
    part = F.slice("features", F.lit(1), F.size("features") - len(D.STRUCTURED_FEATURES))
    return table.select("row", "fold", F.size("features").alias("n_features"), F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@register("g3_fold_parts", _prep_sql(
    "SELECT f.row, CAST(k.k AS INTEGER) AS k, CASE WHEN f.fold = k.k THEN 'test' ELSE 'train' END AS part "
    "FROM folds f CROSS JOIN range(5) AS k(k)", _FOLDS_CTE))
def g3_fold_parts(spark, d):
    folded = _folded(spark, d).select("row", "fold")
    parts = [B.fold_part(folded, k, part).select("row", F.lit(k).alias("k"), F.lit(part).alias("part"))
             for k in range(S.N_FOLDS) for part in ("train", "test")]
    return B.stack_runs(parts)


# ------------------------------------------------- metrics: J ---------------
from postresp.operators import metrics as J  # noqa: E402
from postresp.operators import stats as K  # noqa: E402

# Prediction table for the SQL-checked metrics: each response class predicted
# by another response's class (cross-target agreement), carried with its fold.
CROSS_VARIANTS = [(t, s) for t in L.TARGETS for s in L.TARGETS if s != t]
VARIANT_NAMES = [f"{t}_from_{s}" for t, s in CROSS_VARIANTS]


def cross_target_predictions(spark, d) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f"{t}_from_{s}").alias("variant"), F.lit(t).alias("target"), F.lit(s).alias("feature_set"),
                 F.col(t).alias("truth"), F.col(s).alias("prediction")) for t, s in CROSS_VARIANTS]))
    return _folded(spark, d).select("fold", "row", pairs.alias("p")).select(
        "p.variant", "p.target", "p.feature_set", F.lit("label").alias("classifier"), "fold", "row", "p.truth", "p.prediction")


_PREDS_CTE = "preds AS (" + " UNION ALL ".join(
    f"SELECT '{t}_from_{s}' AS variant, '{t}' AS target, '{s}' AS feature_set, 'label' AS classifier, "
    f"f.fold, p.row, p.{t} AS truth, p.{s} AS prediction FROM prepared p JOIN folds f USING (row)"
    for t, s in CROSS_VARIANTS) + ")"
_CONF_CTES = """conf AS (SELECT variant, truth, prediction, count(*) AS n FROM preds GROUP BY ALL),
ct AS (SELECT variant, truth AS cls, sum(n) AS t FROM conf GROUP BY ALL),
cp AS (SELECT variant, prediction AS cls, sum(n) AS p FROM conf GROUP BY ALL),
cd AS (SELECT variant, truth AS cls, sum(n) AS tp FROM conf WHERE truth = prediction GROUP BY ALL),
tot AS (
  SELECT x.variant, x.cls, CAST(x.t AS DOUBLE) AS t, CAST(x.p AS DOUBLE) AS p, CAST(coalesce(cd.tp, 0) AS DOUBLE) AS tp
  FROM (SELECT coalesce(ct.variant, cp.variant) AS variant, coalesce(ct.cls, cp.cls) AS cls,
               coalesce(ct.t, 0) AS t, coalesce(cp.p, 0) AS p
        FROM ct FULL JOIN cp ON ct.variant = cp.variant AND ct.cls = cp.cls) x
  LEFT JOIN cd ON cd.variant = x.variant AND cd.cls = x.cls)"""


def _metric_sql(body: str, *more: str) -> str:
    return _prep_sql(body, _FOLDS_CTE, _PREDS_CTE, *more)


@register("j1_confusion", _metric_sql(
    "SELECT variant, truth, prediction, count(*) AS n FROM preds GROUP BY ALL"))
def j1_confusion(spark, d):
    return J.confusion(cross_target_predictions(spark, d))


@register("j2_micro_f1", _metric_sql(
    "SELECT variant, round(avg(CAST(truth = prediction AS DOUBLE)), 3) AS f1 FROM preds GROUP BY variant"))
def j2_micro_f1(spark, d):
    return J.micro_f1(cross_target_predictions(spark, d))


@register("j3_mcc", _metric_sql("""
SELECT variant, round(CASE WHEN den = 0 THEN 0.0 ELSE (c * s - pt) / den END, 3) AS mcc FROM (
  SELECT variant, sum(tp) AS c, sum(t) AS s, sum(p * t) AS pt,
         sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) AS den
  FROM tot GROUP BY variant)""", _CONF_CTES))
def j3_mcc(spark, d):
    return J.mcc(cross_target_predictions(spark, d))


@register("j4_weighted_f1", _metric_sql("""
SELECT variant, round(sum(CASE WHEN p + t = 0 THEN 0.0 ELSE 2.0 * tp / (p + t) END * t) / sum(t), 3) AS f1_weighted
FROM tot GROUP BY variant""", _CONF_CTES))
def j4_weighted_f1(spark, d):
    return J.weighted_f1(cross_target_predictions(spark, d))


_FOLD_F1_CTE = ("fold_scores AS (SELECT variant, fold, avg(CAST(truth = prediction AS DOUBLE)) AS f1 "
                "FROM preds GROUP BY variant, fold)")


def _fold_scores(spark, d) -> DataFrame:
    return J.fold_f1(cross_target_predictions(spark, d))


@register("j5_fold_f1", _metric_sql(
    "SELECT variant, fold, round(f1, 6) AS f1 FROM fold_scores", _FOLD_F1_CTE))
def j5_fold_f1(spark, d):
    return _fold_scores(spark, d).withColumn("f1", F.round("f1", 6))


@register("j6_fold_matrix", _metric_sql(
    "SELECT fold, " + ", ".join(f"round(max(f1) FILTER (WHERE variant = '{v}'), 6) AS {v}"
                                for v in VARIANT_NAMES) + " FROM fold_scores GROUP BY fold",
    _FOLD_F1_CTE))
def j6_fold_matrix(spark, d):
    m = J.fold_matrix(_fold_scores(spark, d), VARIANT_NAMES)
    return m.select("fold", *[F.round(v, 6).alias(v) for v in VARIANT_NAMES])


@register("j7_leaderboard", _metric_sql(
    "SELECT feature_set, classifier, " + ", ".join(
        f"max(f1) FILTER (WHERE target = '{t}') AS {t}" for t in L.TARGETS)
    + " FROM (SELECT target, feature_set, classifier, round(avg(CAST(truth = prediction AS DOUBLE)), 3) AS f1"
      " FROM preds GROUP BY ALL) GROUP BY feature_set, classifier"))
def j7_leaderboard(spark, d):
    scores = J.micro_f1(cross_target_predictions(spark, d), ("target", "feature_set", "classifier"))
    return J.leaderboard(scores, L.TARGETS)


# ------------------------------------------------- statistics: K ------------
def _melted(spark, d) -> DataFrame:
    return K.melt_scores(_fold_scores(spark, d))


@register("k2_melt", _metric_sql(
    "SELECT fold AS index, variant AS treatments, round(f1, 6) AS value FROM fold_scores", _FOLD_F1_CTE))
def k2_melt(spark, d):
    return _melted(spark, d).withColumn("value", F.round("value", 6))


_ANOVA_CTES = """g AS (SELECT variant, count(*) AS n, avg(f1) AS m FROM fold_scores GROUP BY variant),
w AS (SELECT sum((s.f1 - g.m) * (s.f1 - g.m)) AS ss_w, count(*) AS n_tot, avg(s.f1) AS grand
      FROM fold_scores s JOIN g USING (variant)),
b AS (SELECT sum(g.n * (g.m - w.grand) * (g.m - w.grand)) AS ss_b, count(*) AS k FROM g CROSS JOIN w),
a AS (SELECT b.ss_b, w.ss_w, CAST(b.k - 1 AS DOUBLE) AS df_b, CAST(w.n_tot - b.k AS DOUBLE) AS df_w
      FROM b CROSS JOIN w)"""


@register("k3_anova", _metric_sql("""
SELECT 'C(treatments)' AS source, round(ss_b, 8) AS sum_sq, df_b AS df, round((ss_b / df_b) / (ss_w / df_w), 6) AS F FROM a
UNION ALL SELECT 'Residual', round(ss_w, 8), df_w, CAST(NULL AS DOUBLE) FROM a""", _FOLD_F1_CTE, _ANOVA_CTES))
def k3_anova(spark, d):
    t = K.anova_oneway(_melted(spark, d), with_p=False)
    return t.select("source", F.round("sum_sq", 8).alias("sum_sq"), "df", F.round("F", 6).alias("F"))


@register("k3_anova_pvalue")
def k3_anova_pvalue(spark, d):
    """ANOVA with p-values (incomplete beta in a pandas UDF; no SQL form)."""
    return K.anova_oneway(_melted(spark, d))


@register("k4_tukey_q", _metric_sql("""
SELECT g1.variant AS group1, g2.variant AS group2, round(g2.m - g1.m, 8) + 0.0 AS meandiff,
       round(abs(g2.m - g1.m) / sqrt(a.ss_w / a.df_w / 2.0 * (1.0 / g1.n + 1.0 / g2.n)), 6) AS q
FROM g g1 JOIN g g2 ON g1.variant < g2.variant CROSS JOIN a""", _FOLD_F1_CTE, _ANOVA_CTES))
def k4_tukey_q(spark, d):
    p = K.tukey_pairs(_melted(spark, d))
    return p.select("group1", "group2", (F.round("meandiff", 8) + F.lit(0.0)).alias("meandiff"),
                    F.round("q", 6).alias("q"))


@register("k4_tukey_hsd")
def k4_tukey_hsd(spark, d):
    """Full Tukey HSD (studentized-range p and interval in pandas UDFs)."""
    return K.tukey_hsd(_melted(spark, d))


@register("k1_normality")
def k1_normality(spark, d):
    """Shapiro-Wilk per variant over its fold scores (applyInPandas)."""
    return K.normality(_melted(spark, d))


# ------------------------------------------------- text -> vectors: H -------
from postresp.operators import cooccur as CO  # noqa: E402
from postresp.operators import embed as H  # noqa: E402
from postresp.operators import experiment as X  # noqa: E402


def _splits(spark, d, squeeze: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prepared posts, folds and splits; the SQL-checked queries leave out squeezing."""
    prepared = prepare_posts(posts(spark, d), squeeze=squeeze)
    folded = S.assign_folds(prepared.select("row"))
    return prepared, folded, S.split_table(folded)


def _vec_summary(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    return df.select("target", "feature_set", "fold", "row", F.size(e).alias("dim"),
                     F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


@register("h1_cooccurrence")
def h1_cooccurrence(spark, d):
    """Vectors from pair counts of each fold's training rows, all rows embedded."""
    prepared, _, splits = _splits(spark, d)
    return _vec_summary(H.fold_embeddings(prepared, splits, "cooccurrence"))


@register("h1_pair_weights", """
WITH t AS (SELECT string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL),
     p AS (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS i, ws FROM t),
     d AS (SELECT word, ws[i + k] AS other, CAST(60 // k AS BIGINT) AS w FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k <= len(ws)),
     b AS (SELECT word AS a, other AS b, w FROM d UNION ALL SELECT other, word, w FROM d)
SELECT a, b, CAST(sum(w) AS BIGINT) AS weight FROM b GROUP BY a, b""")
def h1_pair_weights(spark, d):
    """Weights of word pairs up to five places apart, over whole texts."""
    return CO.pair_weights(spark.read.parquet(f"{d}/documents.parquet").select(F.split("text", " ").alias("words")))


@register("h1_word2vec")
def h1_word2vec(spark, d):
    """Word2Vec fitted on each fold's training rows, all rows embedded."""
    prepared, _, splits = _splits(spark, d)
    return _vec_summary(H.fold_embeddings(prepared, splits, "word2vec"))


@register("h2_subword")
def h2_subword(spark, d):
    """Subword features of every fold, as one run over all rows gives them."""
    prepared, _, splits = _splits(spark, d)
    return _vec_summary(H.fold_embeddings(prepared, splits, "subword"))


@register("h3_batch_embed")
def h3_batch_embed(spark, d):
    """Arrow-batched inference (32 texts per call) with the hashing stand-in model."""
    prepared = prepare_posts(posts(spark, d))
    e = H.batch_embed(prepared.select("row", "sentence"))
    return e.select("row", F.size("embedding").alias("dim"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("sum"))


@register("h4_fold_embeddings")
def h4_fold_embeddings(spark, d):
    """All text sets over all five folds -> the long embedding table."""
    prepared, _, splits = _splits(spark, d)
    return _vec_summary(B.stack_runs([H.fold_embeddings(prepared, splits, s) for s in ("word2vec", "subword", "batch")]))


@register("h5_half_precision")
def h5_half_precision(spark, d):
    emb = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    r = emb.withColumn("half", H.half_precision(F.col("embedding")))
    diff = F.aggregate(F.zip_with("embedding", "half", lambda a, b: F.abs(a - b)), F.lit(0.0),
                       lambda acc, x: F.greatest(acc, x))
    return r.select("row", F.size("half").alias("dim"), diff.alias("max_abs_change"))


# ------------------------------------------------- classifiers: I -----------
def _structured_table(spark, d) -> DataFrame:
    prepared, folded, _ = _splits(spark, d)
    return X.feature_table(prepared, folded, None, "structured")


def _oof(spark, d, clf: str, estimators: int = 250) -> DataFrame:
    v = X.Variant("likes", "structured", False, clf)
    return X.out_of_fold(_structured_table(spark, d), v, estimators)


@register("i1_rf_oof")
def i1_rf_oof(spark, d):
    return _oof(spark, d, "RF")


@register("i2_gbt_oof")
def i2_gbt_oof(spark, d):
    """250 rounds of joint soft-max boosting, all folds together."""
    return _oof(spark, d, "XGB")


@register("h4_early_stopping_oof")
def h4_early_stopping_oof(spark, d):
    """The perceptron of each fold stopped by the loss of the fold's validation rows."""
    prepared, folded, splits = _splits(spark, d)
    v = X.Variant("likes", "structured", False, "MLP")
    return X.out_of_fold(X.feature_table(prepared, folded, None, "structured"), v, splits=splits)


@register("i3_ridge_oof")
def i3_ridge_oof(spark, d):
    return _oof(spark, d, "Ridge")


@register("i4_mlp_oof")
def i4_mlp_oof(spark, d):
    return _oof(spark, d, "MLP")


# ------------------------------------------------- explanation: L -----------
from postresp.operators import explain as XP  # noqa: E402
from postresp.operators import metrics as _M  # noqa: E402

SHAP_FOLD = 0


def _fold_model(spark, d, clf: str, estimators: int):
    table = _structured_table(spark, d)
    v = X.Variant("likes", "structured", False, clf)
    return X.fold_model(table, v, SHAP_FOLD, estimators)


@register("l1_fold_model_scores")
def l1_fold_model_scores(spark, d):
    """One fold's RF model: MCC and support-weighted F1 on its test rows."""
    _, _, pred = _fold_model(spark, d, "RF", 250)
    conf = _M.confusion(pred)
    return _M.mcc(pred, conf=conf).join(_M.weighted_f1(pred, conf=conf), "variant")


@register("l2_tree_shap")
def l2_tree_shap(spark, d):
    """Exact Tree SHAP of the fold-0 random forest on its training rows."""
    model, train, _ = _fold_model(spark, d, "RF", 250)
    return XP.tree_shap(model, train, "RF", D.STRUCTURED_FEATURES)


@register("l3_permutation_shap")
def l3_permutation_shap(spark, d):
    """Sampled-permutation Shapley values of the fold-0 MLP for every training
    row, against a 50-row background (the reference's background size),
    1000 permutation samples per row."""
    model, train, _ = _fold_model(spark, d, "SparkMLP", 0)
    background = B.head_rows(train, 50, "row")
    return XP.permutation_shap(model, train, background, len(D.STRUCTURED_FEATURES),
                               n_samples=1000, feature_names=D.STRUCTURED_FEATURES)


@register("l3_kernel_shap")
def l3_kernel_shap(spark, d):
    """Shapley values of the fold-0 perceptron for every training row: all 62
    coalitions of the six features against a 50-row background (the reference's size)."""
    model, train, _ = _fold_model(spark, d, "MLP", 0)
    return XP.kernel_shap(model, train, B.head_rows(train, 50, "row"), len(D.STRUCTURED_FEATURES), feature_names=D.STRUCTURED_FEATURES)


@register("l4_global_importance")
def l4_global_importance(spark, d):
    """Top-15 features by mean |phi| (Tree SHAP of the fold-0 forest)."""
    return XP.global_importance(l2_tree_shap(spark, d), 15)


@register("l4_importance_of_embeddings", """
WITH phi AS (SELECT vec_id AS row, CAST(label % 3 AS INTEGER) AS class, 'f' || CAST(j AS VARCHAR) AS feature, CAST(embedding[j + 1] AS DOUBLE) AS phi
             FROM embeddings, range(64) AS r(j)),
per AS (SELECT feature, class, avg(abs(phi)) AS m FROM phi GROUP BY ALL),
tot AS (SELECT feature, row_number() OVER (ORDER BY round(sum(m), 9) DESC, feature) AS rank FROM per GROUP BY feature)
SELECT CAST(tot.rank AS INTEGER) AS rank, feature, class, round(m, 6) AS mean_abs_phi FROM per JOIN tot USING (feature) WHERE tot.rank <= 15""")
def l4_importance_of_embeddings(spark, d):
    """Global importance of a phi table made of all values of the embeddings."""
    e = read_table(spark, d, "embeddings")
    phi = e.select(F.col("vec_id").alias("row"), (F.col("label") % 3).cast("int").alias("class"),
                   F.posexplode("embedding").alias("j", "phi"))
    phi = phi.select("row", "class", F.concat(F.lit("f"), F.col("j").cast("string")).alias("feature"), F.col("phi").cast("double").alias("phi"))
    return XP.global_importance(phi, 15).withColumn("mean_abs_phi", F.round("mean_abs_phi", 6))


# ------------------------------------------------- sources / sinks: A -------
def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"io/{name}/{uuid.uuid4().hex}")


@register("a3_prepared_readback", _prep_sql("SELECT * FROM prepared"))
def a3_prepared_readback(spark, d):
    path = _scratch(spark, "prepared")
    A.write_table(_prepared_ns(spark, d), path)
    return spark.read.parquet(path)


_TARGETS_VALUES = "(VALUES " + ", ".join(f"('{t}')" for t in L.TARGETS) + ") AS tg(target)"


@register("a4_split_files_readback", _prep_sql(
    "SELECT tg.target, s.fold, s.split, s.row, '__label__' || CASE tg.target WHEN 'replies' THEN p.replies "
    "WHEN 'likes' THEN p.likes ELSE p.retweets END AS label, md5(p.sentence) AS h "
    f"FROM splits s JOIN prepared p USING (row) CROSS JOIN {_TARGETS_VALUES}", _FOLDS_CTE, _SPLITS_CTE))
def a4_split_files_readback(spark, d):
    """Split files written and read back, text for text."""
    prepared, _, splits = _splits(spark, d, squeeze=False)
    path = _scratch(spark, "splits")
    A.write_split_files(prepared, splits, path)
    back = A.read_split_files(spark, path)
    return back.select("target", F.col("fold").cast("int").alias("fold"), "split", "row", "label", F.md5("sentence").alias("h"))


def _driver_embeddings(spark, d) -> DataFrame:
    """The embeddings table as two embedding sets, by parity of the label."""
    return read_table(spark, d, "embeddings").select(
        F.lit("any").alias("target"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("feature_set"),
        F.floor(F.col("label") / 2).cast("int").alias("fold"), F.col("vec_id").alias("row"), "embedding")


@register("a2_a5_embedding_sets", """
SELECT 'any' AS target, 'odd' AS feature_set, CAST(label // 2 AS INTEGER) AS fold, vec_id AS row, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
FROM embeddings WHERE label % 2 = 1""")
def a2_a5_embedding_sets(spark, d):
    """Embedding sets written partitioned; one set read back (pruned)."""
    path = _scratch(spark, "embedding-sets")
    A.write_embeddings(_driver_embeddings(spark, d), path)
    back = A.read_embedding_set(spark, path, "odd")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return back.select("target", "feature_set", "fold", "row", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


@register("a5_replaced_embedding_set", """
SELECT 'any' AS target, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS feature_set, CAST(label // 2 AS INTEGER) AS fold, vec_id AS row,
       CAST(len(embedding) // CASE WHEN label % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS dim
FROM embeddings""")
def a5_replaced_embedding_set(spark, d):
    """Two embedding sets written, one replaced by vectors of half the length; the other stays."""
    path = _scratch(spark, "embedding-replaced")
    both = _driver_embeddings(spark, d)
    A.replace_embeddings(both, path)
    odd = both.where("feature_set = 'odd'")
    A.replace_embeddings(odd.withColumn("embedding", F.slice("embedding", F.lit(1), F.floor(F.size("embedding") / 2).cast("int"))), path)
    return A.read_embedding_set(spark, path).select("target", "feature_set", "fold", "row", F.size("embedding").alias("dim"))


@register("a2_a5_embeddings_readback")
def a2_a5_embeddings_readback(spark, d):
    """Write the subword embedding table partitioned, read one set back (pruned)."""
    prepared, _, splits = _splits(spark, d)
    path = _scratch(spark, "embeddings")
    A.write_embeddings(H.fold_embeddings(prepared, splits, "subword"), path)
    return _vec_summary(A.read_embedding_set(spark, path, "subword"))


@register("a6_a7_results_readback")
def a6_a7_results_readback(spark, d):
    """Write ridge out-of-fold predictions and their scores, read the scores back."""
    path = _scratch(spark, "results")
    A.write_results(_oof(spark, d, "Ridge"), f"{path}/predictions", f"{path}/wide", f"{path}/scores")
    return A.read_results(spark, f"{path}/scores")


@register("a6_scores_readback", _metric_sql("""
SELECT variant, 'f1' AS metric, round(avg(CAST(truth = prediction AS DOUBLE)), 3) AS value FROM preds GROUP BY variant
UNION ALL
SELECT variant, 'mcc', round(CASE WHEN den = 0 THEN 0.0 ELSE (c * s - pt) / den END, 3) FROM (
  SELECT variant, sum(tp) AS c, sum(t) AS s, sum(p * t) AS pt,
         sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) AS den
  FROM tot GROUP BY variant)""", _CONF_CTES))
def a6_scores_readback(spark, d):
    """Predictions, scores and the wide export written; the scores read back."""
    path = _scratch(spark, "scores")
    A.write_results(cross_target_predictions(spark, d), f"{path}/predictions", scores=f"{path}/scores")
    return A.read_results(spark, f"{path}/scores")


@register("a8_anova_readback", _metric_sql("""
SELECT 'C(treatments)' AS source, round(ss_b, 8) AS sum_sq, CAST(df_b AS BIGINT) AS df FROM a
UNION ALL SELECT 'Residual', round(ss_w, 8), CAST(df_w AS BIGINT) FROM a""", _FOLD_F1_CTE, _ANOVA_CTES))
def a8_anova_readback(spark, d):
    """The report's analysis of variance written and read back."""
    path = _scratch(spark, "anova")
    A.write_report(path, anova=K.anova_oneway(_melted(spark, d), with_p=False))
    back = spark.read.json(f"{path}/anova")
    return back.select("source", F.round(F.col("sum_sq").cast("double"), 8).alias("sum_sq"), F.col("df").cast("long").alias("df"))


@register("a7_results_side_by_side", _metric_sql(
    "SELECT variant, fold, row, truth, prediction FROM preds WHERE NOT contains(variant, '_from_replies')"))
def a7_results_side_by_side(spark, d):
    """Two runs' predictions written, read back as one table, one kind kept."""
    path = _scratch(spark, "runs")
    p = cross_target_predictions(spark, d).withColumn("mixed", ~F.col("variant").contains("_from_replies"))
    A.write_results(p, path, f"{path}-wide")
    return A.read_results(spark, path, mixed=True).select("variant", "fold", "row", "truth", "prediction")


@register("a8_report_readback")
def a8_report_readback(spark, d):
    """Normality, ANOVA and Tukey HSD written as one report and read back, long."""
    path = _scratch(spark, "report")
    obs = _melted(spark, d)
    A.write_report(path, normality=K.normality(obs), anova=K.anova_oneway(obs), tukey=K.tukey_hsd(obs))
    number = lambda c: F.col(c).cast("double").alias(c)
    normal = spark.read.json(f"{path}/normality").select(F.lit("normality").alias("part"), F.col("treatments").alias("name"), number("W").alias("value"), number("pval").alias("p"))
    anova = spark.read.json(f"{path}/anova").select(F.lit("anova").alias("part"), F.col("source").alias("name"), number("sum_sq").alias("value"), number("p_value").alias("p"))
    tukey = spark.read.json(f"{path}/tukey").select(F.lit("tukey").alias("part"), F.concat_ws(" - ", "group1", "group2").alias("name"), number("meandiff").alias("value"), number("p_adj").alias("p"))
    return normal.unionByName(anova).unionByName(tukey)


# ------------------------------------------------- grid: I6 -----------------
# The grid's cells differ by orders of magnitude in cost: ridge is one aggregate,
# a forest dozens of jobs, the perceptron up to 40 where one record holds all
# rows, boosting one or more a round.  The query runs ridge everywhere, the
# perceptron where the folds share their features, and the forest on one target
# (README); run_grid takes all of them alike.
FOREST_CELLS = [("likes", "structured", False), ("likes", "subword", False), ("likes", "subword", True)]
TEXT_SETS = ["word2vec", "subword", "batch"]


def _grid_predictions(spark, d) -> DataFrame:
    """Feature groups I-III: structured, each text set, each with the structured block."""
    prepared, folded, splits = _splits(spark, d)
    base, _ = X.grid_inputs(prepared, folded, None)
    tables = {(t, "structured", False): X.feature_table(base, None, None, "structured") for t in L.TARGETS}
    for name in TEXT_SETS:
        emb = A.write_bucketed(H.fold_embeddings(prepared, splits, name), f"grid_{name}")
        for mixed in (False, True):
            if name == "batch":     # the same vectors in every fold
                per = X.feature_table(base, None, emb, name, fold=0, mixed=mixed)
            else:
                per = {k: X.feature_table(base, None, emb, name, fold=k, mixed=mixed) for k in range(5)}
            tables |= {(t, name, mixed): per for t in L.TARGETS}
    variants = [X.Variant(*cell, "Ridge") for cell in tables] + [X.Variant(*cell, "RF") for cell in FOREST_CELLS]
    variants += [X.Variant(*cell, "MLP") for cell, per in tables.items() if not isinstance(per, dict)]
    return X.run_grid(tables, variants, out_path=_scratch(spark, "grid"), threads=4)


@register("i6_grid_leaderboard")
def i6_grid_leaderboard(spark, d):
    """Grid over targets x feature groups I-III x classifiers; pooled micro F1 and MCC."""
    pred = _grid_predictions(spark, d)
    scores = J.micro_f1(pred, ("variant", "target", "feature_set", "mixed", "classifier"))
    return scores.join(J.mcc(pred), "variant")


# ------------------------------------------------- streaming: N1 ------------
from postresp.streaming.score import score_stream  # noqa: E402


@register("n1_stream_scores")
def n1_stream_scores(spark, d):
    """Posts streamed file by file, cleaned, de-duplicated within the watermark,
    labelled with cut points frozen from the batch run."""
    src = _scratch(spark, "stream-src")
    p = posts(spark, d)
    p.repartitionByRange(4, "post_id").write.mode("overwrite").parquet(src)
    cuts = L.cut_points(cleaned_posts(p))
    # a model fitted on the batch structured features scores every new post
    model, _, _ = _fold_model(spark, d, "Ridge", 0)
    # the posts span seven years and come in no order of time
    out = score_stream(spark, src, _scratch(spark, "stream-out"), cuts, "3650 days", model=model, cutoff_year=CUTOFF_YEAR)
    return out.select("post_id", *[f"{t}_class" for t in L.TARGETS], "tokens",
                      L.decode_label(F.col("prediction")).alias("likes_predicted"))


# ------------------------------------------------- B8 / G2 ------------------
@register("b8_variants_for_target", _metric_sql(
    "SELECT DISTINCT variant FROM preds WHERE contains(variant, 'likes')"))
def b8_variants_for_target(spark, d):
    return B.variants_for_target(cross_target_predictions(spark, d), "likes").select("variant").distinct()


@register("g2_stack_runs", _metric_sql(
    "SELECT variant, fold, round(avg(CAST(truth = prediction AS DOUBLE)), 6) AS f1, 'single' AS run "
    "FROM preds WHERE contains(variant, '_from_replies') GROUP BY variant, fold "
    "UNION ALL SELECT variant, fold, round(avg(CAST(truth = prediction AS DOUBLE)), 6), 'mixed' "
    "FROM preds WHERE NOT contains(variant, '_from_replies') GROUP BY variant, fold"))
def g2_stack_runs(spark, d):
    """Fold scores of two result sets put together in long form."""
    p = cross_target_predictions(spark, d)
    a = J.fold_f1(p.where(F.col("variant").contains("_from_replies")), 6).withColumn("run", F.lit("single"))
    b = J.fold_f1(p.where(~F.col("variant").contains("_from_replies")), 6).withColumn("run", F.lit("mixed"))
    return B.stack_runs([a, b])

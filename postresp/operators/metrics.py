"""Classification metrics over a long prediction table.

Input schema: ``(variant, fold, row, truth, prediction)`` (+ optional
descriptive columns).  The only pass over the predictions is the confusion
count (partial aggregation before its shuffle); MCC and weighted F1 are
computed from it -- a table of variants x classes^2 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, by=("variant",)) -> DataFrame:
    """``(*by, truth, prediction, n)``."""
    return (pred.groupBy(*by, "truth", "prediction")
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def micro_f1(pred: DataFrame, by=("variant",), digits: int | None = 3) -> DataFrame:
    """Micro F1 = accuracy for single-label predictions, pooled over folds.

    A missing truth or prediction is a miss, not a row less."""
    f1 = F.avg(F.coalesce(F.col("truth") == F.col("prediction"), F.lit(False)).cast("double"))
    if digits is not None:
        f1 = F.round(f1, digits)
    return pred.groupBy(*by).agg(f1.alias("f1"))


def _class_totals(conf: DataFrame, by) -> DataFrame:
    """``(*by, cls, t, p, tp)``: support, predictions and hits of each class as
    doubles (products of counts overflow a long); one pass, one aggregate.  A
    null class is a class of its own that never hits."""
    n, zero = F.col("n").cast("double"), F.lit(0.0)
    hit = F.when(F.col("truth") == F.col("prediction"), n).otherwise(zero)
    entry = F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), n.alias("t"), zero.alias("p"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("t"), n.alias("p"), zero.alias("tp"))))
    long = conf.select(*by, entry.alias("e")).select(*by, "e.*")
    return long.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])


def mcc(pred: DataFrame, by=("variant",), digits: int | None = 3,
        conf: DataFrame | None = None) -> DataFrame:
    """Multiclass Matthews correlation; 0 when undefined.

    ``(c*s - sum(p_k t_k)) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2))``.
    """
    by = list(by)
    conf = conf if conf is not None else confusion(pred, by)
    tot = _class_totals(conf, by)
    a = tot.groupBy(*by).agg(
        F.sum("tp").alias("c"), F.sum("t").alias("s"), F.sum(F.col("p") * F.col("t")).alias("pt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    val = F.when(den == 0, F.lit(0.0)).otherwise(
        (F.col("c") * F.col("s") - F.col("pt")) / den)
    if digits is not None:
        val = F.round(val, digits)
    return a.select(*by, val.alias("mcc"))


def weighted_f1(pred: DataFrame, by=("variant",), digits: int | None = 3,
                conf: DataFrame | None = None) -> DataFrame:
    """Per-class F1 (0 when undefined) averaged with support weights."""
    by = list(by)
    conf = conf if conf is not None else confusion(pred, by)
    tot = _class_totals(conf, by)
    f1k = F.when((F.col("p") + F.col("t")) == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("tp") / (F.col("p") + F.col("t")))
    val = F.sum(f1k * F.col("t")) / F.sum("t")
    if digits is not None:
        val = F.round(val, digits)
    return tot.groupBy(*by).agg(val.alias("f1_weighted"))


def fold_f1(pred: DataFrame, digits: int | None = None) -> DataFrame:
    """Micro F1 per (variant, fold); the fold travels with each row."""
    return micro_f1(pred, ("variant", "fold"), digits)


def fold_matrix(fold_scores: DataFrame, variants: list[str] | None = None) -> DataFrame:
    """Fold x variant matrix (one column per variant)."""
    g = fold_scores.groupBy("fold")
    g = g.pivot("variant", variants) if variants else g.pivot("variant")
    return g.agg(F.first("f1"))


def leaderboard(scores: DataFrame, targets: list[str], index=("feature_set", "classifier"),
                value: str = "f1") -> DataFrame:
    """Scores by (feature set, classifier) x target."""
    return scores.groupBy(*index).pivot("target", targets).agg(F.first(value))

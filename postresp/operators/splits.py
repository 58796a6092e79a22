"""Seeded k-fold assignment and train/val/test split tables.

Fold = ``ntile(k)`` over ``md5(seed:row)`` order -- computed without a global
window: exact distributed numbering on the hash (range exchange) and then
arithmetic, since n is known.  Sizes differ by at most one, larger folds
first, exactly as SQL ``ntile`` (DuckDB gives the same folds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postresp.operators.frame import ntile_index, rank_within, row_number_exact

N_FOLDS = 5
FOLD_SEED = 13
VAL_FRACTION = 0.125


def fold_hash(row_col: str = "row", seed: int = FOLD_SEED):
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(row_col).cast("string")))


def val_hash(row_col: str = "row", fold_col: str = "k", seed: int = FOLD_SEED):
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(fold_col).cast("string"),
                          F.lit(":"), F.col(row_col).cast("string")))


def assign_folds(df: DataFrame, row_col: str = "row", k: int = N_FOLDS,
                 seed: int = FOLD_SEED, fold_col: str = "fold") -> DataFrame:
    """add ``fold`` in [0, k): seeded shuffle, sizes differ by at most one."""
    # only the narrow (hash, row) pair is numbered; wide columns join back
    hashed = df.select(row_col).withColumn("_fh", fold_hash(row_col, seed))
    numbered = row_number_exact(hashed, ["_fh", row_col], name="_frank")
    n = numbered.count()
    folds = numbered.select(row_col, ntile_index(F.col("_frank"), F.lit(n), k).alias(fold_col))
    if len(df.columns) == 1:
        return folds
    return df.join(folds, row_col)


def split_table(folded: DataFrame, row_col: str = "row", fold_col: str = "fold",
                k: int = N_FOLDS, val_fraction: float = VAL_FRACTION,
                seed: int = FOLD_SEED) -> DataFrame:
    """long ``(row, fold, split)``: for fold k, its rows are ``test``;
    of the others, the first ``ceil(val_fraction * n_train)`` in a second
    seeded hash order are ``val`` and the rest ``train`` (70/10/20 overall).
    """
    # every row once per fold: a generator, not a join
    pairs = folded.select(row_col, fold_col,
                          F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    test = (pairs.where(F.col(fold_col) == F.col("k"))
            .select(row_col, F.col("k").alias("fold"), F.lit("test").alias("split")))
    train = pairs.where(F.col(fold_col) != F.col("k")).withColumn("_vh", val_hash(row_col, "k", seed))
    ranked = rank_within(train, "k", ["_vh", row_col], name="_vrank")
    n_train = train.groupBy("k").agg(F.count(F.lit(1)).alias("_nt"))
    ranked = ranked.join(F.broadcast(n_train), "k")  # one row per fold
    n_val = F.ceil(F.lit(val_fraction) * F.col("_nt"))
    trval = ranked.select(row_col, F.col("k").alias("fold"),
                          F.when(F.col("_vrank") < n_val, F.lit("val"))
                          .otherwise(F.lit("train")).alias("split"))
    return test.unionByName(trval).withColumn("fold", F.col("fold").cast("int"))


def split_counts(splits: DataFrame) -> DataFrame:
    """rows per (fold, split)."""
    return splits.groupBy("fold", "split").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))

"""Row identity, projection helpers and positional joins.

Exact numbering without a global window (SURVEY §7.3)
-----------------------------------------------------
``row_number().over(Window.orderBy(k))`` moves every row into one task.  We
instead range-partition on the order key (balanced, sampled bounds), sort
within partitions, tag each row with ``monotonically_increasing_id`` (which
encodes partition id and in-partition ordinal) and write that as Parquet to the
shared folder: a re-run can never see different range bounds, and later reads
take only the columns they need.
The per-partition counts (one row per partition, a bounded table) give
running offsets, which are broadcast back.  Result = the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postresp.session import stored

_ORDINAL_BITS = 33
_ORDINAL_MASK = (1 << _ORDINAL_BITS) - 1


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def row_number_exact(df: DataFrame, order_by, name: str = "row",
                     num_partitions: int | None = None, base: int = 0) -> DataFrame:
    """Dense ``base``-based row number in the total order ``order_by``.

    The order key should be unique (ties get an arbitrary but fixed order).
    Two passes over the data plus one range exchange; no single-task window.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _cols(order_by)
    tagged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    pid = F.shiftright(F.col("_mid"), _ORDINAL_BITS)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window over it is bounded by `n`
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = (tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
           .withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_ORDINAL_MASK))
                              + F.lit(base)).cast("long")))
    return out.drop("_mid", "_pid", "_off")


def rank_within(df: DataFrame, group_by, order_by, name: str = "rank") -> DataFrame:
    """0-based row number inside each group, ordered by ``order_by``.

    Rows are range-partitioned by (group, order), so a large group is many
    partitions; a row's rank is its place in its partition's part of the group
    plus the group's rows in earlier partitions.  The counts have one row per
    partition and group; they are attached by (partition, group), where no key
    holds more than a partition, and broadcast by Spark if they are small.
    """
    gnames = [group_by] if isinstance(group_by, str) else list(group_by)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _cols(gnames) + _cols(order_by)
    tagged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", _ORDINAL_BITS))
    counts = tagged.groupBy("_pid", *gnames).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    earlier = Window.partitionBy(*gnames).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", *[F.col(g).alias(f"_s_{g}") for g in gnames], "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = (tagged["_pid"] == starts["_pid"])
    for g in gnames:
        same = same & tagged[g].eqNullSafe(starts[f"_s_{g}"])
    return (tagged.join(starts, same).withColumn(name, F.col("_mid") - F.col("_first") + F.col("_before"))
            .select(*df.columns, name))


def ntile_index(rank0: Column, n: Column, k: int) -> Column:
    """0-based ``ntile(k)`` bucket of a 0-based rank among ``n`` rows.

    The first ``n % k`` buckets hold one row more, like SQL ``ntile``.
    """
    q = F.floor(n / k)
    rem = n % k
    big = (q + 1) * rem
    return F.when(rank0 < big, F.floor(rank0 / (q + 1))) \
        .otherwise(rem + F.floor((rank0 - big) / F.greatest(q, F.lit(1)))).cast("int")


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of several columns that share a name."""
    names = df.columns
    seen, keep = set(), []
    for i, c in enumerate(names):
        if c not in seen:
            seen.add(c)
            keep.append(i)
    if len(keep) == len(names):
        return df
    tmp = [f"_c{i}" for i in range(len(names))]
    return df.toDF(*tmp).select(*[F.col(f"_c{i}").alias(names[i]) for i in keep])


def head_rows(df: DataFrame, n: int = 6066, order_by="row") -> DataFrame:
    """The first ``n`` rows in ``order_by`` order (a top-n, the feature)."""
    return df.orderBy(*_cols(order_by)).limit(n)


def prefix_labels(df: DataFrame, cols, prefix: str = "__label__") -> DataFrame:
    """Prefix class labels for text-classifier training files."""
    return df.withColumns({c: F.concat(F.lit(prefix), F.col(c).cast("string")) for c in cols})


def variants_for_target(df: DataFrame, target: str, col: str = "variant") -> DataFrame:
    """Experiment variants whose name contains the target."""
    return df.where(F.col(col).contains(target))


def stage_ledger(stages: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """``(stage, n_rows)`` of a pipeline's stages.

    Each entry is a frame and the stages that are counted on it, as aggregate
    expressions: stages that only filter or merge rows of one frame share its pass.
    """
    parts = [df.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
             .select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n_rows")) for n in counts])).alias("s"))
             .select("s.*") for df, counts in stages]
    return reduce(DataFrame.unionByName, parts)


def attach_by_row(left: DataFrame, right: DataFrame, key: str = "row",
                  how: str = "left") -> DataFrame:
    """G1: attach a feature frame by row key (positional concat in the reference)."""
    return left.join(right, key, how)


def stack_runs(frames: list[DataFrame]) -> DataFrame:
    """Put results of several runs together (long form)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fold_part(df: DataFrame, fold: int, part: str, fold_col: str = "fold") -> DataFrame:
    """Rows of fold ``fold``'s train (fold != k) or test (fold == k) part."""
    if part == "train":
        return df.where(F.col(fold_col) != fold)
    if part == "test":
        return df.where(F.col(fold_col) == fold)
    raise ValueError(part)

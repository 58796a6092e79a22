"""Readers and writers.

Every hand-over of the reference is a file; here each is a partitioned
dataset so later reads prune by partition (target / feature set / fold /
split / variant) and push filters into the scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postresp.operators.labels import TARGETS
from postresp.operators.metrics import mcc, micro_f1
from postresp.session import scratch_path

POSTS_SCHEMA = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("replies", T.LongType()),
    T.StructField("likes", T.LongType()),
    T.StructField("retweets", T.LongType()),
    T.StructField("has_media", T.BooleanType()),
    T.StructField("is_replied", T.BooleanType()),
    T.StructField("is_reply_to", T.BooleanType()),
    T.StructField("hashtags", T.StringType()),
    T.StructField("links", T.StringType()),
    T.StructField("reply_to_users", T.StringType()),
    T.StructField("timestamp_epochs", T.LongType()),
])


#: text that survives a round trip: every field quoted, quotes doubled, blanks and
#: carriage returns kept, null (nothing) told from empty (two quotes)
_EXACT = {"quote": '"', "escape": '"', "lineSep": "\n", "emptyValue": "", "nullValue": "\x00",
          "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: files a task of ``write_split_files`` holds open (with more of them, Spark sorts the rest)
_OPEN_FILES, MOST_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 64
_READ, _WRITE = _EXACT | {"multiLine": True}, _EXACT | {"quoteAll": True}


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType = POSTS_SCHEMA, sep: str = ",") -> DataFrame:
    """A1: posts from Parquet or delimited text with a header; schema declared, not inferred."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt == "csv":
        return spark.read.schema(schema).options(**_READ, header=True, sep=sep).csv(path)
    raise ValueError(fmt)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """A3 / A5: write a table (Parquet by default), optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.options(**_WRITE, header=True).csv(path)
    else:
        raise ValueError(fmt)


def split_files(prepared: DataFrame, splits: DataFrame, targets=TARGETS) -> DataFrame:
    """Long ``(target, fold, split, label, sentence, row)`` for text-model training files."""
    labels = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.concat(F.lit("__label__"), F.col(t)).alias("label"))
                                 for t in targets]))
    return (splits.join(prepared.select("row", "sentence", *targets), "row")
            .select("row", "fold", "split", "sentence", labels.alias("l"))
            .select("l.target", "fold", "split", "l.label", "sentence", "row"))


def write_split_files(prepared: DataFrame, splits: DataFrame, path: str, targets=TARGETS) -> None:
    """A4: tab-separated train / val / test files per target and fold, no header, gzipped.

    A text is written once per target and fold.  A task keeps a file open for each
    of them, so that these copies are not sorted (and spilled) before they are written."""
    spark = prepared.sparkSession
    before = spark.conf.get(_OPEN_FILES, "0")
    spark.conf.set(_OPEN_FILES, str(max(int(before), MOST_OPEN_FILES)))
    try:
        (split_files(prepared, splits, targets).write.mode("overwrite")
         .partitionBy("target", "fold", "split")
         .options(**_WRITE, sep="\t", header=False, compression="gzip",
                  **{"zlib.compress.level": "BEST_SPEED"}).csv(path))
    finally:
        spark.conf.set(_OPEN_FILES, before)


def read_split_files(spark: SparkSession, path: str) -> DataFrame:
    schema = "label string, sentence string, row long"
    return spark.read.schema(schema).options(**_READ, sep="\t", header=False, basePath=path).csv(path)


def write_embeddings(emb: DataFrame, path: str) -> None:
    """A5: the long embedding table, partitioned by target / feature set / fold."""
    write_table(emb, path, partition_by=["target", "feature_set", "fold"])


def write_bucketed(df: DataFrame, name: str, key: str = "row", buckets: int | None = None) -> DataFrame:
    """``df`` as a table in ``buckets`` of ``key``, one sorted file each, below the
    shared folder; tables of equal bucket number join on ``key`` without a shuffle."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet")
     .option("path", scratch_path(spark, table)).saveAsTable(table))
    return spark.table(table)


def replace_embeddings(emb: DataFrame, path: str) -> None:
    """A5: write embedding sets into a dataset, replacing just the (target, feature
    set, fold) partitions that ``emb`` holds; a run that is repeated writes the
    same partitions anew, and those of other sets stay as they are."""
    (emb.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("target", "feature_set", "fold").parquet(path))


def read_embedding_set(spark: SparkSession, path: str, feature_set: str | None = None,
                       fold: int | None = None, target: str | None = None) -> DataFrame:
    """A2: one embedding set; filters on partition columns prune directories."""
    df = spark.read.parquet(path)
    if feature_set is not None:
        df = df.where(F.col("feature_set") == feature_set)
    if fold is not None:
        df = df.where(F.col("fold") == fold)
    if target is not None:
        df = df.where(F.col("target") == target)
    return df


def write_results(pred: DataFrame, path: str, pivot_csv: str | None = None, scores: str | None = None,
                  variants: list[str] | None = None) -> None:
    """Long predictions partitioned by variant; optionally the scores
    ``(variant, metric, value)`` and a wide CSV with one column per variant
    (``variants`` names them, which saves the job that finds them)."""
    write_table(pred, path, partition_by=["variant"])
    if scores:
        both = micro_f1(pred).join(mcc(pred), "variant").unpivot("variant", ["f1", "mcc"], "metric", "value")
        write_table(both, scores)
    if pivot_csv:
        wide = pred.groupBy("fold", "row").pivot("variant", variants).agg(F.first("prediction"))
        write_table(wide, pivot_csv, fmt="csv")


def read_results(spark: SparkSession, path: str, mixed: bool | None = None) -> DataFrame:
    """Read several runs back as one long table."""
    df = spark.read.parquet(path)
    return df if mixed is None else df.where(F.col("mixed") == mixed)


def write_report(path: str, **tables: DataFrame) -> None:
    """One JSON dataset per test table (normality, anova, tukey ...)."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")

"""Micro-batch scoring of new posts.

``readStream`` of post files -> cleaning C1-C13 (the same Column
expressions as the batch path) -> de-duplication on the text within an
event-time watermark -> labels with cut points frozen from a batch run ->
model ``transform`` -> ``writeStream`` with ``trigger(availableNow=True)``.

Stateful de-duplication uses ``dropDuplicatesWithinWatermark`` on a 128-bit
digest of the text; its state is bounded by the watermark delay the caller
names.  The checkpoint belongs to the sink (``<sink>-checkpoint``), so another
call with the same sink resumes where the last one stopped and adds only new
files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postresp.functions import features as D
from postresp.operators.clean import clean_posts
from postresp.operators.labels import TARGETS, add_labels
from postresp.sources.io import POSTS_SCHEMA


def score_stream(spark: SparkSession, source_dir: str, sink_dir: str, cuts: DataFrame,
                 watermark: str, model=None, cutoff_year: int | None = None, files_per_trigger: int = 1,
                 **clean_kw) -> DataFrame:
    """Run the scoring stream to completion and return the sink as a DataFrame.

    ``cuts`` is the one-row cut-point table of ``labels.cut_points``; ``model``
    (optional) is a fitted Spark ML model over the structured features;
    ``watermark`` is how late a copy of a post may come and still be dropped.
    """
    sink = sink_dir.rstrip("/")
    src = (spark.readStream.schema(POSTS_SCHEMA)
           .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))
    if cutoff_year is not None:
        src = src.where(F.col("year").isNull() | (F.col("year") > cutoff_year))
    cleaned = clean_posts(src, dedup=False, **clean_kw)
    dedup = (cleaned.withWatermark("ts", watermark)
             .withColumn("_h", F.md5("text")).dropDuplicatesWithinWatermark(["_h"]).drop("_h"))
    labelled = add_labels(dedup, TARGETS, cuts=cuts, frozen=True)
    out = labelled.withColumnRenamed("text", "sentence")
    if model is not None:
        from pyspark.ml.functions import array_to_vector
        feats = D.add_structured(out).withColumn("features", array_to_vector(D.structured_vector()))
        out = model.transform(feats).drop("features", "rawPrediction", "probability")
    q = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", f"{sink}-checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)

"""postresp — Spark-native analytics for predicting how strongly an audience
responds to short texts.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a Column
expression) built on Spark SQL built-ins, Spark ML and Arrow-batched pandas
functions, so one code path runs on a laptop sample and on a cluster.

Layout
------
``sources``    readers / writers and the portable ``posts`` view
``functions``  Column-level expressions (text cleaning, features, distributions)
``operators``  DataFrame operators (numbering, labels, folds, models, metrics ...)
``plans``      composed pipelines and the registered query catalog
``streaming``  micro-batch scoring of new posts
"""

from postresp.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]

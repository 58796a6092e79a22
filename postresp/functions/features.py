"""Date and structured features, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRUCTURED_FEATURES = ["has_media", "has_hash", "has_url2", "is_reply_to", "has_retweet", "ym"]
FLAG_REPORT = [("links", "has_url2"), ("images", "has_media"), ("retweets", "has_retweet"),
               ("hashtags", "has_hash"), ("replies", "is_reply_to")]


def parse_timestamp(df: DataFrame, col: str) -> Column:
    """Timestamp from a string (bad values -> null) or from epoch seconds."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.StringType):
        return F.try_to_timestamp(c)
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType)):
        return F.timestamp_seconds(c)
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.timestamp_seconds(c.cast("long"))
    return c.cast("timestamp")


def has_items(df: DataFrame, col: str) -> Column:
    """Printed list longer than 4 chars (so ``[]``/null -> false); arrays: non-empty."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(F.length(c.cast("string")) > 4, F.lit(False))


def contains_flag(c: Column, needle: str) -> Column:
    """D3: text contains ``needle``; null -> false."""
    return F.coalesce(c.contains(needle), F.lit(False))


def year_month_index(ts: Column, base_year: int = 2017, compat: bool = False) -> Column:
    """Months since ``base_year``-01 (2017-01 -> 1).

    ``compat=True`` reproduces the reference's last-digit rule
    ((last digit of year - 7) * 12 + month), which goes negative from 2020.
    """
    if compat:
        last = F.substring(F.year(ts).cast("string"), 4, 100).cast("int")
        return ((last - 7) * 12 + F.month(ts)).cast("int")
    return ((F.year(ts) - base_year) * 12 + F.month(ts)).cast("int")


def add_structured(df: DataFrame, text_col: str = "sentence", ts_col: str = "timestamp_epochs",
                   base_year: int = 2017, compat: bool = False) -> DataFrame:
    """Add ``timestamp``, ``has_hash``, ``has_url``, ``has_url2``, ``has_retweet``, ``ym``."""
    ts = parse_timestamp(df, ts_col)
    return df.withColumns({
        "timestamp": ts,
        "has_hash": has_items(df, "hashtags"),
        "has_url": has_items(df, "links"),
        "has_url2": contains_flag(F.col(text_col), "URL"),
        "has_retweet": contains_flag(F.col(text_col), "_RETWEET"),
        "ym": year_month_index(ts, base_year, compat),
    })


def flag_percentages(df: DataFrame, flags=FLAG_REPORT) -> DataFrame:
    """``(flag, pct)`` = percent of rows with each flag, 2 decimals, one pass."""
    n = F.count(F.lit(1))
    aggs = [F.round(100.0 * F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")) / n, 2).alias(name)
            for name, c in flags]
    return df.agg(*aggs).unpivot([], [name for name, _ in flags], "flag", "pct")


def structured_vector(cols=STRUCTURED_FEATURES) -> Column:
    """The structured feature set as ``array<double>``."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def feature_union(embedding: Column | None, structured: Column | None) -> Column:
    """Group I (structured), II (text) or III (both, fixed order: text then structured)."""
    if embedding is None and structured is None:
        raise ValueError("need at least one feature block")
    if embedding is None:
        return structured
    emb = F.transform(embedding, lambda x: x.cast("double"))
    if structured is None:
        return emb
    return F.concat(emb, structured)

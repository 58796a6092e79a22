"""The ``posts`` view over the driver tables.

The driver's tables hold no social posts, so a post is derived from them:

* ``documents`` gives id and text; the text is decorated, by ``doc_id % 8``,
  with link / hashtag / mention / repeat snippets in the middle (before the
  first newline) and at the end, so every cleaning rule has work to do;
* ``orders`` (``o_orderkey = doc_id``) gives the timestamp and ``retweets``;
* ``lineitem`` grouped by order gives ``replies`` (line count) and ``likes``
  (total quantity).

The same view is written twice: as DataFrame code (``posts``) and as DuckDB
SQL (``POSTS_SQL``) used by the oracle queries.  Work grows with all three
tables.  Plan: lineitem is partially aggregated before its shuffle; the two
joins share the key so the exchanges on ``doc_id`` / ``o_orderkey`` /
``l_orderkey`` line up (sort-merge join without re-shuffling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed test decorations (our own fixture values), keyed by doc_id % 8.
MID_SNIPPETS = {
    2: " pic.twitter.com/AbC1 now",
    3: " soooo goooood hahahahaha",
    4: ' well https://twitter.com/u/status/1 "said"',
    5: " @navy_ops !!! ... ---",
    7: " so … wait",
}
END_SNIPPETS = {
    1: ' see http://x.co/a more text #navy "q"',
    3: " https://pbs.twimg.com/media/Z9.jpg",
    5: " go http://x.co #navy",
    6: " http://twitter.com/u URL#frag",
    7: " [DELETE] this",
}
HASHTAG_KEYS = (1, 5)
LINK_KEYS = (1, 3, 5, 6)

POST_COLUMNS = [
    "post_id", "text", "ts", "year", "month", "day", "replies", "likes", "retweets",
    "has_media", "is_replied", "is_reply_to", "hashtags", "links", "reply_to_users",
    "timestamp_epochs",
]


def _case(key, mapping: dict, default):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v)))
    return expr.otherwise(default) if expr is not None else default


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Build the ``posts`` DataFrame (schema: FIXTURES §2).

    Documents are hash-partitioned on ``doc_id`` into ``partitions``
    (default ``spark.sql.shuffle.partitions``): the join on ``doc_id`` needs
    that exchange anyway at scale, and it spreads the CPU-heavy text work
    over all cores even when the input is a single file split.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").repartition(n, "doc_id")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    lines = (read_table(spark, sf_dir, "lineitem")
             .groupBy(F.col("l_orderkey").alias("k"))
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.sum("l_quantity").cast("bigint").alias("qty")))
    k = F.col("doc_id") % 8
    mid = _case(k, MID_SNIPPETS, F.lit(""))
    end = _case(k, END_SNIPPETS, F.lit(""))
    text = F.concat(
        F.regexp_replace(F.col("text"), F.lit("^([^\\n]*)\\n"), F.concat(F.lit("$1"), mid, F.lit("\n"))),
        end)
    in_keys = lambda keys: k.isin(*keys)
    ts = F.col("o_orderdate").cast("timestamp")
    df = (docs.join(orders, F.col("o_orderkey") == F.col("doc_id"))
          .join(lines, F.col("k") == F.col("doc_id"), "left"))
    return df.select(
        F.col("doc_id").alias("post_id"),
        text.alias("text"),
        ts.alias("ts"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("replies"),
        F.coalesce(F.col("qty"), F.lit(0)).cast("bigint").alias("likes"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("retweets"),
        ((F.col("doc_id") % 3) == 0).alias("has_media"),
        (F.coalesce(F.col("n_lines"), F.lit(0)) > 0).alias("is_replied"),
        ((F.col("doc_id") % 5) == 0).alias("is_reply_to"),
        F.when((F.col("doc_id") % 11) == 0, F.lit(None).cast("string"))
         .when(in_keys(HASHTAG_KEYS), F.lit("['navy']")).otherwise(F.lit("[]")).alias("hashtags"),
        F.when(in_keys(LINK_KEYS), F.lit("['http://x.co/a']")).otherwise(F.lit("[]")).alias("links"),
        F.when((F.col("doc_id") % 5) == 0, F.lit("['navy']")).otherwise(F.lit("[]")).alias("reply_to_users"),
        F.unix_timestamp(ts).alias("timestamp_epochs"),
    )


def _sql_case(mapping: dict) -> str:
    parts = " ".join(
        "WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in mapping.items())
    return f"CASE d.doc_id % 8 {parts} ELSE '' END"


def _sql_in(keys) -> str:
    return "d.doc_id % 8 IN ({})".format(", ".join(str(k) for k in keys))


# DuckDB version of the same view (used by oracle_sql()).
POSTS_SQL = f"""
posts AS (
  SELECT d.doc_id AS post_id,
         regexp_replace(d.text, '^([^\\n]*)\\n', '\\1' || {_sql_case(MID_SNIPPETS)} || chr(10))
           || {_sql_case(END_SNIPPETS)} AS text,
         o.o_orderdate AS ts,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         CAST(day(o.o_orderdate) AS INTEGER) AS day,
         CAST(coalesce(l.n_lines, 0) AS BIGINT) AS replies,
         CAST(coalesce(l.qty, 0) AS BIGINT) AS likes,
         CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS retweets,
         d.doc_id % 3 = 0 AS has_media,
         coalesce(l.n_lines, 0) > 0 AS is_replied,
         d.doc_id % 5 = 0 AS is_reply_to,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL
              WHEN {_sql_in(HASHTAG_KEYS)} THEN '[''navy'']' ELSE '[]' END AS hashtags,
         CASE WHEN {_sql_in(LINK_KEYS)} THEN '[''http://x.co/a'']' ELSE '[]' END AS links,
         CASE WHEN d.doc_id % 5 = 0 THEN '[''navy'']' ELSE '[]' END AS reply_to_users,
         CAST(epoch(o.o_orderdate) AS BIGINT) AS timestamp_epochs
  FROM documents d
  JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n_lines,
                    CAST(sum(l_quantity) AS BIGINT) AS qty
             FROM lineitem GROUP BY l_orderkey) l ON l.k = d.doc_id
)"""


def with_posts(sql_body: str, *extra_ctes: str) -> str:
    """Prefix a DuckDB query with the ``posts`` CTE (and optional more CTEs)."""
    ctes = ",\n".join((POSTS_SQL,) + extra_ctes)
    return f"WITH {ctes}\n{sql_body}"

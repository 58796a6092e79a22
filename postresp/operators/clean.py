"""Post filtering, cleaning and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postresp.functions import text as T


def after_year(df: DataFrame, year: int = 2016, col: str = "year") -> DataFrame:
    """B1: keep posts after ``year``; a null year is kept (pandas semantics)."""
    return df.where(F.col(col).isNull() | (F.col(col) > F.lit(year)))


def dedup_first(df: DataFrame, key: str = "text", order: str = "post_id") -> DataFrame:
    """C14: one row per distinct ``key``, the one with the smallest ``order``.

    ``min_by(struct(row), order)`` grouped by ``(xxhash64(key), key)``: one
    shuffle, and the partial (map-side) aggregate collapses copies of a hot
    text before the exchange, so a text held by a third of all rows never
    lands whole in one task.  The 64-bit hash leads the key so sorting and
    hashing rarely compare the long strings themselves.
    """
    others = [c for c in df.columns if c != key]
    return (df.groupBy(F.xxhash64(F.col(key)).alias("_h"), F.col(key))
            .agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_r"))
            .select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def _staged(df: DataFrame, text_col: str, tail: str, squeeze: bool, words: bool, phrase: str | None,
            threshold: int, stop_words: list[str] | None, compat: bool) -> tuple[DataFrame, Column]:
    """``df`` with ``tokens`` and working columns, and whether a row is kept (null for a null text)."""
    # project the cleaned / stripped text once; later steps reference columns
    staged = df.withColumn("_clean", T.clean_text(F.col(text_col), tail, squeeze))
    staged = staged.withColumn("_strip", T.strip_low_content(F.col("_clean"), phrase))
    # The counts come out of a Generate (inline of a one-element array): the
    # keep filter refers to them, and Catalyst cannot push a filter on
    # generated columns below the Generate -- otherwise it inlines the whole
    # regex chain into the pushed-down filter and every text is cleaned twice.
    # of the plain words only whether there is one decides
    n_words = T.has_plain_word(F.col("_strip")).cast("int") if words else F.lit(None).cast("int")
    # compat: the reference writes the sentinel for removed posts and then drops
    # every text containing it, genuine posts included.  Collapsing spaces can
    # neither create nor remove that substring, so the cleaned text is tested.
    sentinel = F.col("_clean").contains(T.DELETE_SENTINEL) if compat else F.lit(False)
    staged = staged.select("*", F.inline(F.array(F.struct(
        T.count_content_tokens(F.col("_strip"), stop_words).alias("tokens"),
        n_words.alias("_words"), sentinel.alias("_sentinel")))))
    return staged, T.keep_post(F.col("tokens"), F.col("_words") if words else None, threshold) & ~F.col("_sentinel")


def clean_posts(df: DataFrame, text_col: str = "text", id_col: str = "post_id", *,
                tail: str = "compat", squeeze: bool = True, words: bool = True,
                phrase: str | None = T.BOILERPLATE_PHRASE, threshold: int = T.TOKEN_THRESHOLD,
                stop_words: list[str] | None = None, compat: bool = True,
                dedup: bool = True) -> DataFrame:
    """The whole cleaning chain C1-C14 as one lazy plan.

    Adds ``tokens`` (content-token count).  Null texts are dropped (the
    reference turns them into "nan", one token, removed).  With
    ``compat=True`` any text containing the sentinel ``DELETE`` is dropped,
    genuine posts included, as in the reference (B7).
    """
    staged, keep = _staged(df.where(F.col(text_col).isNotNull()), text_col, tail, squeeze, words, phrase, threshold, stop_words, compat)
    kept = (staged.where(keep)
            .withColumn(text_col, T.collapse_spaces(F.col("_clean")))
            .drop("_clean", "_strip", "_words", "_sentinel"))
    return dedup_first(kept, text_col, id_col) if dedup else kept


def marked_posts(df: DataFrame, year: int, text_col: str = "text", year_col: str = "year", *, tail: str = "compat",
                 squeeze: bool = True, words: bool = True, phrase: str | None = T.BOILERPLATE_PHRASE,
                 threshold: int = T.TOKEN_THRESHOLD, stop_words: list[str] | None = None, compat: bool = True) -> DataFrame:
    """``_in_years, _kept, _text``: what B1 and C15 decide on every row of ``df``,
    none filtered, so that all stages can be counted in one pass (B9).

    ``_text`` is the cleaned text of a kept row, null for the others; a text out
    of the years is not cleaned."""
    in_years = F.col(year_col).isNull() | (F.col(year_col) > F.lit(year))
    rows = df.select(in_years.alias("_in_years"), F.when(in_years, F.col(text_col)).alias("_raw"))
    staged, keep = _staged(rows, "_raw", tail, squeeze, words, phrase, threshold, stop_words, compat)
    kept = F.coalesce(keep & F.col("_raw").isNotNull(), F.lit(False))
    return staged.select("_in_years", kept.alias("_kept"), F.when(kept, T.collapse_spaces(F.col("_clean"))).alias("_text"))

"""Quantile cut points, class labels and box-plot statistics.

The row of cut points is read by a scalar subquery or, for streams, frozen into
literals.

Quantiles are exact by rank selection (``exact_quantiles``): a sketch of bounded
size gives each wanted rank a bracket of values, the rows below it are counted and
only the values inside it are told apart.  Linear interpolation, equal to
``percentile``, pandas ``quantile`` and DuckDB ``quantile_cont``; no buffer of
distinct values, so continuous responses are no different from counts.  The
frame is read twice: give it a written table if it is dear to compute.
``method="approx"`` is the sketch alone (``percentile_approx``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGETS = ["replies", "likes", "retweets"]
QUANTILES = (0.25, 0.75)
CLASSES = ["small", "moderate", "high"]
CLASS_CODES = {"small": 0, "moderate": 1, "high": 2}


#: the sketch's ranks are right to within rows / SKETCH; brackets reach thrice as far
SKETCH = 10_000


def exact_quantiles(df: DataFrame, by: list[str], value: str = "value", quantiles=QUANTILES) -> DataFrame:
    """``*by, n, q`` (array of the quantiles, interpolated) of the non-null values of each group.

    One aggregate sketches a bracket around every wanted rank; a second counts,
    per group and quantile, the rows below the bracket and the rows of each value
    inside (about ``6 / SKETCH`` of the group's rows, pre-aggregated by value);
    running counts then name the two values at the rank."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    reach = 3.0 / SKETCH
    shares = [min(1.0, max(0.0, q + side)) for q in quantiles for side in (-reach, reach)]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, shares)), SKETCH).alias("_s"))
    # the ends are taken whole, and so are groups too small for the sketch to be off by less than a rank
    small = F.col("n") < SKETCH
    low = lambda i: F.lit(float("-inf")) if shares[2 * i] == 0.0 else F.when(small, F.lit(float("-inf"))).otherwise(F.col("_s")[2 * i])
    top = lambda i: F.lit(float("nan")) if shares[2 * i + 1] == 1.0 else F.when(small, F.lit(float("nan"))).otherwise(F.col("_s")[2 * i + 1])
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), low(i).alias("low"), top(i).alias("top")) for i, q in enumerate(quantiles)])
    sketch = sketch.select(*by, "n", brackets.alias("_b"))
    keys = [f"_k{i}" for i in range(len(by))]
    right = sketch.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "n", "_b")
    same = F.lit(True)
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    cells = rows.join(right, same).select(*by, "n", "_v", F.explode("_b").alias("_b")).where(F.col("_v") <= F.col("_b.top"))
    inside = F.col("_v") >= F.col("_b.low")
    counted = (cells.groupBy(*by, "n", F.col("_b.i").alias("_i"), F.col("_b.q").alias("_q"), F.when(inside, F.col("_v")).alias("_v"), inside.alias("_in"))
               .agg(F.count(F.lit(1)).alias("_c")))
    upto = Window.partitionBy(*by, "_i").orderBy("_in", "_v").rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("_q") * (F.col("n") - 1)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto)).where("_in")
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = ranked.groupBy(*by, "n", "_i", "_q").agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"))
    mixed = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.ceil(place) - place) * F.col("_lo") + (place - F.floor(place)) * F.col("_hi"))
    return (found.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("_i", mixed.alias("v")))).alias("_l"))      # one entry per quantile
            .select(*by, F.col("n").cast("long").alias("n"), F.transform("_l", lambda x: x["v"]).alias("q")))


def cut_points(df: DataFrame, targets=TARGETS, quantiles=QUANTILES,
               method: str = "exact", accuracy: int = 100000) -> DataFrame:
    """One row, columns ``{target}_q{i}`` (double), all targets in one pass of each kind."""
    names = [(t, k) for t in targets for k in range(len(quantiles))]
    if method == "approx":
        shares = F.array(*[F.lit(float(q)) for q in quantiles])
        row = df.agg(*[F.percentile_approx(F.col(t).cast("double"), shares, accuracy).alias(f"_{t}_q") for t in targets])
        return row.select(*[F.col(f"_{t}_q")[k].alias(f"{t}_q{k + 1}") for t, k in names])
    if method != "exact":
        raise ValueError(method)
    found = exact_quantiles(_melt(df, targets), ["target"], quantiles=quantiles)
    return found.agg(*[F.max(F.when(F.col("target") == t, F.col("q")[k])).alias(f"{t}_q{k + 1}") for t, k in names])


def _melt(df: DataFrame, targets, *carried: str) -> DataFrame:
    return df.select(*carried, F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("value")) for t in targets])).alias("_p")) \
        .select(*carried, "_p.target", "_p.value")


def fold_cut_points(folded: DataFrame, targets=TARGETS, quantiles=QUANTILES, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """E1 with ``fit_on="train"``: ``fold, {target}_q{i}``, of the rows of the other folds."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold_col))
    long = _melt(folded.withColumn("_of", F.explode(others)), targets, "_of").select(F.col("_of").cast("int").alias("fold"), "target", "value")
    found = exact_quantiles(long, ["fold", "target"], quantiles=quantiles)
    return found.groupBy("fold").agg(*[F.max(F.when(F.col("target") == t, F.col("q")[i])).alias(f"{t}_q{i + 1}") for t in targets for i in range(len(quantiles))])


def fold_labels(folded: DataFrame, targets=TARGETS, k: int = 5, row_col: str = "row", fold_col: str = "fold", suffix: str = "_class") -> DataFrame:
    """E2 with ``fit_on="train"``: ``row, fold, {target}{suffix}``: the labels of every
    row (train and test) under each fold's cut points."""
    pairs = folded.select(row_col, *targets, F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("fold"))
    cuts = fold_cut_points(folded, targets, k=k, fold_col=fold_col)
    labelled = pairs.join(cuts, "fold", "left")              # a row per fold: small
    return labelled.select(row_col, "fold", *[label_column(F.col(t), F.col(f"{t}_q1"), F.col(f"{t}_q2")).alias(f"{t}{suffix}") for t in targets])


def label_column(x: Column, q1: Column, q2: Column) -> Column:
    """Small if int(x) <= q1, moderate if <= q2, else high; null stays null.

    ``int()`` truncates toward zero -> cast to bigint (never a rounding cast).
    """
    v = x.cast("bigint")
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(v <= q1, F.lit("small"))
            .when(v <= q2, F.lit("moderate"))
            .otherwise(F.lit("high")))


def add_labels(df: DataFrame, targets=TARGETS, cuts: DataFrame | None = None,
               suffix: str = "_class", frozen: bool = False, **kw) -> DataFrame:
    """E1+E2: attach ``{target}{suffix}`` labels; cuts default to all rows of ``df``.

    For cut points of training rows only see ``fold_labels``.
    The cut table has exactly one row and enters the batch plan as a scalar
    subquery: no join, and a reader that needs no label pays for none.
    ``frozen=True`` fetches the row once and uses its values as literals
    (streams: the cut points must not change between micro-batches).
    """
    cuts = cuts if cuts is not None else cut_points(df, targets, **kw)
    if frozen:
        c = cuts.first().asDict()
        bounds = {t: (F.lit(c[f"{t}_q1"]), F.lit(c[f"{t}_q2"])) for t in targets}
    else:
        row = cuts.select(F.struct("*").alias("cuts")).scalar()
        bounds = {t: (row[f"{t}_q1"], row[f"{t}_q2"]) for t in targets}
    return df.select(
        *df.columns,
        *[label_column(F.col(t), *bounds[t]).alias(f"{t}{suffix}") for t in targets])


def label_counts(labelled: DataFrame, targets=TARGETS, suffix: str = "_class") -> DataFrame:
    """``(target, label, n)``: how many posts fall into each class."""
    long = labelled.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"{t}{suffix}").alias("label"))
        for t in targets])).alias("p")).select("p.*")
    return long.groupBy("target", "label").agg(F.count(F.lit(1)).cast("long").alias("n"))


def encode_label(c: Column) -> Column:
    """E5: small/moderate/high -> 0/1/2; anything else -> null."""
    m = F.create_map(*[x for k, v in CLASS_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, c).cast("int")


def decode_label(c: Column) -> Column:
    """E5: 0/1/2 -> small/moderate/high (the intended inverse); else null."""
    m = F.create_map(*[x for k, v in CLASS_CODES.items() for x in (F.lit(v), F.lit(k))])
    return F.element_at(m, c.cast("int"))


def melt_targets(df: DataFrame, targets=TARGETS, by: str = "year") -> DataFrame:
    """Long ``(target, {by}, value)`` via unpivot."""
    return (df.select(by, *[F.col(t).cast("double").alias(t) for t in targets])
            .unpivot(by, targets, "target", "value"))


def box_stats(df: DataFrame, targets=TARGETS, by: str = "year") -> DataFrame:
    """Per (target, ``by``): n, q1, median, q3 and whiskers (1.5 IQR, no fliers).

    Pass 1 selects the quantiles of each group, pass 2 joins them back and takes
    conditional min/max, with map-side partial aggregation.
    """
    long = melt_targets(df, targets, by).where(F.col("value").isNotNull() & F.col(by).isNotNull())
    q = exact_quantiles(long, ["target", by], quantiles=(0.25, 0.5, 0.75))
    q = q.select("target", by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = long.join(q.select("target", by, "_lo", "_hi"), ["target", by])
    w = (j.groupBy("target", by)
         .agg(F.min(F.when(F.col("value") >= F.col("_lo"), F.col("value"))).alias("whisker_low"),
              F.max(F.when(F.col("value") <= F.col("_hi"), F.col("value"))).alias("whisker_high")))
    return (q.drop("_lo", "_hi").join(w, ["target", by])
            .withColumn("whisker_low", F.coalesce("whisker_low", "q1"))
            .withColumn("whisker_high", F.coalesce("whisker_high", "q3")))


def distinct_values(df: DataFrame, col: str = "year") -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()

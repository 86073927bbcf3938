"""Order-dependent computations that survive a hot key.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task.  Here
the ordering column is cut into buckets, the window runs per (key, bucket), and
only one summary row per bucket takes part in the second window over the key.
``bucket`` must be a non-decreasing function of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = "_bucket"


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Add per row the inclusive running total of each measure, and ``<name>_all``
    with the total of the whole key.

    What came before a bucket enters its window as one extra leading row, so no join
    is needed and null keys are kept.
    """
    measured = df.select(
        *df.columns, bucket.alias(BUCKET), *[c.alias(f"_m_{n}") for n, c in sums.items()]
    )
    totals = measured.groupBy(*keys, BUCKET).agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums])
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    leading = totals.select(
        *keys,
        BUCKET,
        F.lit(0).alias("_row"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_m_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_all_{n}") for n in sums],
    )
    both = measured.withColumn("_row", F.lit(1)).unionByName(leading, allowMissingColumns=True)
    upto = (
        W.partitionBy(*keys, BUCKET)
        .orderBy("_row", *order)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    summed = both.select(
        "_row",
        *df.columns,
        *[F.sum(f"_m_{n}").over(upto).alias(n) for n in sums],
        *[F.first(f"_all_{n}", ignorenulls=True).over(upto).alias(f"{n}_all") for n in sums],
    )
    return summed.where(F.col("_row") == 1).drop("_row")


def count_changes(
    df: DataFrame, keys: list[str], order: str, value: str, bucket: Column, name: str
) -> DataFrame:
    """Per key, how often ``value`` changes from one known value to the next.

    Rows without a value are passed over: of a, null, b the last is a change, of a, null,
    a none is.  A key whose rows all lack a value has 0.
    """
    rows = df.withColumn(BUCKET, bucket)
    inside = W.partitionBy(*keys, BUCKET).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    previous = F.last(value, ignorenulls=True).over(inside)
    known = F.when(F.col(value).isNotNull(), F.col(order))  # null orders count for no row
    pieces = (
        rows.withColumn("_changed", F.coalesce((F.col(value) != previous).cast("bigint"), F.lit(0)))
        .groupBy(*keys, BUCKET)
        .agg(
            F.sum("_changed").alias("_changes"),
            F.min_by(F.col(value), known).alias("_first"),
            F.max_by(F.col(value), known).alias("_last"),
        )
    )
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    before = F.last("_last", ignorenulls=True).over(earlier)
    edge = F.coalesce((F.col("_first") != before).cast("bigint"), F.lit(0))
    return (
        pieces.withColumn("_edge", edge)
        .groupBy(*keys)
        .agg(F.sum(F.col("_changes") + F.col("_edge")).alias(name))
    )


def quantile_bucket(df: DataFrame, value: str, buckets: int = 128) -> Column:
    """Number of sampled quantiles at or below the value: about equally many rows in
    each bucket, whatever the range of the values."""
    points = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(value, points, 0.2 / buckets)))
    held = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(held, lambda cut: cut <= F.col(value))).cast("bigint")


def rank_by_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rank rows within ``key`` by descending ``value`` without a window over the rows.

    Equal values are counted together first, so the ranked table holds each
    (key, value) once however many rows share it; the join back is split by AQE
    where one value is hot.  The values are ranked apart in buckets between quantiles.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(
        counts,
        [key],
        [F.col(value).desc()],
        # missing values come last
        F.when(F.col(value).isNotNull(), -quantile_bucket(counts, value)).otherwise((1 << 63) - 1),
        {"_upto": F.col("_n")},
    )
    ranks = placed.select(
        F.col(key).alias("_key"),
        F.col(value).alias("_value"),
        (F.col("_upto") - F.col("_n") + 1).alias("rank"),
        F.col("_upto_all").alias("group_size"),
    )
    same = df[key].eqNullSafe(ranks["_key"]) & df[value].eqNullSafe(ranks["_value"])
    return df.join(ranks, same).drop("_key", "_value")


def percentiles(
    df: DataFrame, key: str, value: str, points: list[float]
) -> DataFrame:
    """Exact discrete percentiles per key: the smallest value reaching each share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    placed = running_totals(
        counts, [key], [F.col(value)], quantile_bucket(counts, value),
        {"_upto": F.col("_n")},
    )

    def at(p: float) -> Column:
        target = F.greatest(F.ceil(F.col("_upto_all") * F.lit(p)), F.lit(1))
        return F.min(F.when(F.col("_upto") >= target, F.col(value)))

    return placed.groupBy(key).agg(*[at(p).alias(f"p{round(p * 100)}") for p in points])

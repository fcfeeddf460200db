"""Exact percentiles of groups of any size by narrowing histograms (AG8, AG17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brimwatch.session import cut_lineage

#: Parts of equal width that a range of values is counted in.
BINS = 4096
#: How often the range around a wanted value is narrowed; each time to one of ``BINS`` parts.
PASSES = 2


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    bins: int = BINS,
    passes: int = PASSES,
) -> DataFrame:
    """One row per key with a column per entry of ``fractions``, interpolated between neighbours.

    Equals ``percentile`` of SQL. Rows are reduced to a count per distinct value
    by a hash aggregate on (keys, value), so no task holds the values of a key.
    Then the ranks that the fractions need are searched: the counts per part of
    the key's range tell which parts hold a rank, and only values of those parts
    go on, each part being a range of its own from its least to its largest
    value. After ``passes`` rounds what is left of a part is put in order.

    Null and NaN values do not count; a key without other values is left out.
    """
    keys = list(keys)
    # -0.0 and 0.0 are one value.
    number = F.col(value).cast("double") + F.lit(0.0)
    present = df.select(*keys, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # Read by every round, so the samples are reduced once and the lineage ends here.
    counts = cut_lineage(present.groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    at = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in fractions.items()}
    ranks = F.array_distinct(F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil))))
    rows = _join(
        counts,
        counts.groupBy(*keys)
        .agg(F.sum("_c").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_before", F.lit(0).cast("long")),
        keys,
    )
    path: list[str] = []
    for i in range(passes):
        width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
        inside = F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(bins - 1).cast("long"))
        rows = rows.withColumn(f"_part{i}", F.when(width > 0, inside).otherwise(F.lit(0).cast("long")))
        parts = rows.groupBy(*keys, *path, f"_part{i}").agg(
            F.sum("_c").alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
            F.max("_before").alias("_start"), F.max("_n").alias("_n"),
        )
        # At most ``bins`` rows per range, whatever the number of values.
        upto = F.col("_start") + F.sum("_in").over(W.partitionBy(*keys, *path).orderBy(f"_part{i}"))
        path.append(f"_part{i}")
        wanted = (
            parts.withColumn("_upto", upto)
            .where(F.exists(ranks, lambda r: (r >= F.col("_upto") - F.col("_in")) & (r < F.col("_upto"))))
            .select(
                *keys, *path, F.col("_least").alias("_low"), F.col("_most").alias("_high"),
                (F.col("_upto") - F.col("_in")).alias("_before"),
            )
        )
        rows = _join(rows.drop("_low", "_high", "_before"), wanted, [*keys, *path])
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, *path).orderBy("_v"))
    ranked = rows.withColumn("_upto", upto)
    met = F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))
    hit = ranked.select(*keys, "_n", "_v", F.explode(met).alias("_rank"))
    ends = [
        F.max(F.when(F.col("_rank") == f(x), F.col("_v"))).alias(f"_{end}_{name}")
        for name, x in at.items()
        for end, f in (("low", F.floor), ("high", F.ceil))
    ]
    found = hit.groupBy(*keys, "_n").agg(*ends)

    def between(name: str) -> Column:
        low, high, part = F.col(f"_low_{name}"), F.col(f"_high_{name}"), at[name] - F.floor(at[name])
        return F.when(low == high, low).otherwise((F.lit(1.0) - part) * low + part * high)

    return found.select(*keys, *(between(name).alias(name) for name in fractions))


def _join(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a side of one row per key; null keys meet."""
    renamed = one.select(*(F.col(c).alias(f"_of_{c}" if c in keys else c) for c in one.columns))
    on = [many[k].eqNullSafe(renamed[f"_of_{k}"]) for k in keys]
    return many.join(renamed, on).drop(*(f"_of_{k}" for k in keys))

"""Aggregates: modes, weighted medians, histograms, resource sums, column statistics, skylines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .frames import cut


def finite(x: Column) -> Column:
    """The value, null where it is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def mean_exceeds(x: Column, limit: str) -> Column:
    """Aggregate: whether the mean is above ``limit``, a decimal; null of no value.

    Doubles are added as the decimals that they are written as, so that a mean
    of just the limit is not above it in whatever order rows come.  Where one
    is no decimal of 10 and 18 digits (infinite, say), the mean of doubles decides.
    """
    exact = x.try_cast("decimal(28,18)")
    added = F.when(F.count(x) == F.count(exact), F.try_sum(exact))
    return F.coalesce(added > (F.lit(limit).cast("decimal(10,9)") * F.count(x)).cast("decimal(38,18)"), F.avg(x) > float(limit))


def cycle_mode(df: DataFrame, keys: Sequence[str], cycle: str, weight: Column | None = None) -> DataFrame:
    """(keys..., mode, weight, total, share): the whole number of largest weight, then nearest zero, then smallest."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    sums = df.where(F.col(cycle).isNotNull()).groupBy(*keys, cycle).agg(F.sum(w).alias("w"))
    k = F.col(cycle)
    best = F.max_by(F.struct(k.alias("mode"), F.col("w")), F.struct(F.col("w"), -F.abs(k), -k))
    out = sums.groupBy(*keys).agg(best.alias("_best"), F.sum("w").alias("total"))
    return out.select(*keys, F.col("_best.mode").alias("mode"), F.col("_best.w").alias("weight"), "total", (F.col("_best.w") / F.col("total")).alias("share"))


def majority_label(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys..., label): the most frequent positive label, the smallest on a tie, 0 if there is none."""
    n = df.where(F.col(label) > 0).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("best"))
    return df.select(*keys).distinct().join(best, list(keys), "left").select(*keys, F.coalesce("best", F.lit(0)).cast("long").alias(label))


def weighted_lower_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys..., median, share): the first value at which the running weight reaches half, and that value's share."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    whole = Window.partitionBy(*keys)
    running = F.sum("w").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = per.withColumn("cum", running).withColumn("total", F.sum("w").over(whole)).where(F.col("cum") >= F.col("total") / 2)
    best = reached.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("median"), (F.col("w") / F.col("total")).alias("share")), value).alias("b"))
    return best.select(*keys, "b.median", "b.share")


def column_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, share missing, extremes, mean, population deviation and exact percentiles of the finite values."""
    x = finite(F.col(value).cast("double"))
    p = F.percentile(x, F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(x.isNull()) / F.count(F.lit(1))).alias("nan_fraction"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), p.alias("p"),
    )
    return out.select(*keys, "n", "nan_fraction", "min", "max", "mean", "std", *[F.get("p", F.lit(k)).alias(f"p{q:02d}") for k, q in enumerate((5, 25, 50, 75, 95))])


def metric_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 of one value), extremes and count."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal bins between the extremes, the last closed on the right; empty bins are 0."""
    x = finite(F.col(value).cast("double"))
    low = df.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    binned = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(low))
    k = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)))).otherwise(F.lit(bins // 2))
    counts = binned.groupBy(k.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def resources(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Needs added up: sums, the largest memory; null only where all are, but for jobs, 0."""
    return df.groupBy(*keys).agg(
        F.sum("time_s").alias("time_s"), F.sum("disk_gb").alias("disk_gb"), F.max("rss_gb").alias("rss_gb"), F.sum("credits").alias("credits"),
        F.coalesce(F.sum("n_jobs"), F.lit(0)).cast("long").alias("n_jobs"),
    )


def wrapped_errors(df: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """RMSE and MAE of wrapped phase errors, as they are and without their circular mean."""
    from ..functions.phase import wrap

    means = df.groupBy(*keys).agg(F.atan2(F.avg(F.sin(error)), F.avg(F.cos(error))).alias("bias"))
    e, c = wrap(F.col(error)), wrap(F.col(error) - F.col("bias"))
    return df.join(means, list(keys)).groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(c * c)).alias("rmse_unbiased"), F.first("bias").alias("bias")
    )


def unwrap_error_fraction(df: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """Share of values at least pi away from their group's median."""
    import math

    med = df.groupBy(*keys).agg(F.median(error).alias("_m"))
    return df.join(med, list(keys)).groupBy(*keys).agg(F.avg((F.abs(F.col(error) - F.col("_m")) >= math.pi).cast("double")).alias("fraction"))


def skyline(df: DataFrame, keys: Sequence[str], row: str, smaller: Sequence[str], larger: Sequence[str] = ()) -> DataFrame:
    """Rows of each group that no other is as good as everywhere and better somewhere; rows with a null objective go.

    Points in the order of the first objective can be dominated only by those
    before, so with two objectives one running minimum decides.  With more,
    rows are dealt into groups of about 4096, each keeps what none of its own
    dominates, and the survivors are compared in pairs of chunks; ``row`` is
    unique.
    """
    goals = [F.col(c).cast("double") for c in smaller] + [-F.col(c).cast("double") for c in larger]
    known = df
    for c in (*smaller, *larger):
        known = known.where(F.col(c).isNotNull())
    known = known.withColumns({f"_g{k}": g for k, g in enumerate(goals)})
    if len(goals) == 2:
        per = known.groupBy(*keys, "_g0").agg(F.min("_g1").alias("_best"))
        before = Window.partitionBy(*keys).orderBy("_g0").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("_low", F.min("_best").over(before))
        out = known.join(per, [*keys, "_g0"]).where((F.col("_g1") == F.col("_best")) & (F.col("_low").isNull() | (F.col("_g1") < F.col("_low"))))
    else:
        width = len(goals)
        dealt = known.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(max(1, known.count() // 4096))))

        def local(pdf):
            import numpy as np

            g = pdf[[f"_g{k}" for k in range(width)]].to_numpy(float)
            keep = [not ((g <= x).all(axis=1) & (g < x).any(axis=1)).any() for x in g]
            return pdf[np.array(keep, bool)]

        known = cut(dealt.groupBy(*keys, "_salt").applyInPandas(local, dealt.schema))

        # survivors in chunks, every two of which are compared in a group of their own
        chunks = F.greatest(F.lit(1), F.ceil(F.col("count") / 4096)).cast("int")
        if keys:
            sized = known.join(known.groupBy(*keys).count().select(*keys, chunks.alias("_chunks")), list(keys))
        else:
            sized = known.withColumn("_chunks", F.lit(max(1, -(-known.count() // 4096))))
        own = F.pmod(F.xxhash64(row), F.col("_chunks")).cast("int")
        met = sized.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        met = met.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")}).select(*keys, F.col(row).alias("_row"), "_lo", "_hi", *[f"_g{k}" for k in range(width)])

        def beaten(pdf):
            import numpy as np

            g = pdf[[f"_g{k}" for k in range(width)]].to_numpy(float)
            lost = np.array([((g <= x).all(axis=1) & (g < x).any(axis=1)).any() for x in g], bool)
            return pdf.loc[lost, ["_row"]]

        kind = dict(known.dtypes)[row]
        gone = met.groupBy(*keys, "_lo", "_hi").applyInPandas(beaten, f"_row {kind}").distinct()
        out = known.join(gone, F.col(row) == F.col("_row"), "left_anti")
    return out.select(*df.columns)

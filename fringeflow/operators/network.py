"""Interferogram networks: grouping of acquisitions, pairs, reference dates, components, integration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .joins import band_join


def build_pairs(
    dates: DataFrame, stack: Sequence[str], *, method: str = "sbas", max_days: int = 48, max_perp_m: float = 150.0, connections: int = 3
) -> DataFrame:
    """(stack..., ref, sec, dt_days, bperp) over distinct dates of each stack.

    ``dates``: stack columns, ``date`` and ``bperp`` (null: unknown), one row
    a date.  ``sbas``: pairs up to ``max_days`` apart whose baselines differ by
    at most ``max_perp_m`` or are unknown; ``sequential``: each date with the
    next ``connections``; ``single_reference``: the recommended reference with
    every other date.
    """
    d = dates.select(*stack, "date", "bperp", F.unix_date("date").alias("day"))
    a = d.select(*stack, F.col("date").alias("ref"), F.col("bperp").alias("b_ref"), F.col("day").alias("day_ref"))
    b = d.select(*stack, F.col("date").alias("sec"), F.col("bperp").alias("b_sec"), F.col("day").alias("day_sec"))
    if method == "sbas":
        pairs = band_join(a, b, stack, F.col("day_ref"), F.col("day_sec"), max_days).where("day_ref < day_sec")
        pairs = pairs.where(F.col("b_ref").isNull() | F.col("b_sec").isNull() | (F.abs(F.col("b_sec") - F.col("b_ref")) <= max_perp_m))
    elif method == "sequential":
        order = Window.partitionBy(*stack).orderBy("day")
        ahead = [F.struct(F.lead("date", k).over(order).alias("sec"), F.lead("bperp", k).over(order).alias("b_sec"), F.lead("day", k).over(order).alias("day_sec")) for k in range(1, max(1, connections) + 1)]
        pairs = d.withColumn("ahead", F.array(*ahead)).withColumn("next", F.explode("ahead")).where("next.sec is not null")
        pairs = pairs.select(*stack, F.col("date").alias("ref"), F.col("bperp").alias("b_ref"), F.col("day").alias("day_ref"), "next.*")
    elif method == "single_reference":
        master = recommend_reference(dates, stack).select(*stack, F.col("reference").alias("master"))
        one = d.join(master, list(stack))
        m = one.where("date = master").select(*stack, F.struct("date", "bperp", "day").alias("m"))
        both = one.where("date <> master").join(m, list(stack)).withColumn("s", F.struct("date", "bperp", "day"))
        first, second = F.when(F.col("s.day") < F.col("m.day"), F.col("s")).otherwise(F.col("m")), F.when(F.col("s.day") < F.col("m.day"), F.col("m")).otherwise(F.col("s"))
        pairs = both.select(*stack, first.alias("f"), second.alias("l")).select(
            *stack, F.col("f.date").alias("ref"), F.col("f.bperp").alias("b_ref"), F.col("f.day").alias("day_ref"),
            F.col("l.date").alias("sec"), F.col("l.bperp").alias("b_sec"), F.col("l.day").alias("day_sec"),
        )
    else:
        raise ValueError(f"unknown network method {method!r}")
    return pairs.select(*stack, "ref", "sec", (F.col("day_sec") - F.col("day_ref")).cast("long").alias("dt_days"), (F.col("b_sec") - F.col("b_ref")).alias("bperp"))


def recommend_reference(dates: DataFrame, stack: Sequence[str]) -> DataFrame:
    """(stack..., reference, score): the date nearest the middle of time and baselines, the earlier on a tie.

    The baseline term is the sum of absolute differences to all known
    baselines of the stack over the largest such sum, 1 where unknown, 0
    where fewer than two are known.  Sums come from running totals over the
    baselines in order, so no date meets every other.
    """
    w = Window.partitionBy(*stack)
    ordered = w.orderBy("bperp", "date")
    d = dates.select(*stack, "date", "bperp", F.unix_date("date").cast("double").alias("day"))
    mid = (F.min("day").over(w) + F.max("day").over(w)) / 2
    half = (F.max("day").over(w) - F.min("day").over(w)) / 2
    d = d.withColumn("t_score", F.when(half > 0, F.abs(F.col("day") - mid) / half).otherwise(F.lit(0.0)))
    known = d.where("bperp is not null")
    rank = F.row_number().over(ordered).cast("double")
    n, total = F.count("bperp").over(w).cast("double"), F.sum("bperp").over(w)
    below = F.sum("bperp").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spread = rank * F.col("bperp") - below + (total - below) - (n - rank) * F.col("bperp")
    known = known.withColumn("n_known", n).withColumn("spread", spread)
    worst = F.max("spread").over(w)
    known = known.withColumn("b_score", F.when(F.col("n_known") < 2, 0.0).when(worst == 0, 0.0).otherwise(F.col("spread") / worst))
    known = known.select(*stack, "date", "b_score", "n_known")
    d = d.join(known, [*stack, "date"], "left")
    several = F.max("n_known").over(w) >= 2
    score = F.col("t_score") + F.when(F.coalesce(several, F.lit(False)), F.coalesce("b_score", F.lit(1.0))).otherwise(F.lit(0.0))
    d = d.withColumn("score", F.round(score, 9))
    best = F.min(F.struct("score", "date"))
    return d.groupBy(*stack).agg(best.alias("b")).select(*stack, F.col("b.date").alias("reference"), F.col("b.score").alias("score"))


def _per_stack(both: DataFrame, stack: Sequence[str], work, schema: str) -> DataFrame:
    """``work`` on each stack's rows, in one pass over them grouped by stack.

    A stack's dates are distinct days and its pairs lie within a span, so a
    group is bounded by the calendar, whatever the size of the archive.
    """
    kinds = dict(both.dtypes)

    def run(pdf):
        out = work(pdf)
        for c in stack:
            out[c] = pdf[c].iloc[0]
        return out[[*stack, *[f.split()[0] for f in schema.split(", ")]]]

    return both.groupBy(*stack).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in stack), schema]))


def _roots(nodes: list, links: list) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def components(nodes: DataFrame, edges: DataFrame, stack: Sequence[str]) -> DataFrame:
    """(stack..., node, root): the smallest node of each component; nodes without edges are their own.

    ``nodes``: stack columns and ``node``; ``edges``: stack columns, ``a``,
    ``b``, which count as nodes too.  Union-find, a stack at a time.
    """
    import pandas as pd

    kind = dict(nodes.dtypes)["node"]
    none = F.lit(None).cast(kind)
    both = edges.select(*stack, "a", "b").unionByName(nodes.select(*stack, F.col("node").alias("a"), none.alias("b")))

    def work(pdf):
        linked = pdf[pdf["b"].notna()]
        root = _roots(sorted({*pdf["a"], *linked["b"]}), list(zip(linked["a"], linked["b"], strict=True)))
        return pd.DataFrame({"node": list(root), "root": list(root.values())})

    return _per_stack(both, stack, work, f"node {kind}, root {kind}")


def network_summary(dates: DataFrame, pairs: DataFrame, stack: Sequence[str]) -> DataFrame:
    """Per stack: pairs, components, dates outside the largest, and the spread of baselines in time and space."""
    labels = components(dates.select(*stack, F.col("date").alias("node")), pairs.select(*stack, F.col("ref").alias("a"), F.col("sec").alias("b")), stack)
    sizes = labels.groupBy(*stack, "root").agg(F.count(F.lit(1)).alias("n"))
    comps = sizes.groupBy(*stack).agg(F.count(F.lit(1)).alias("n_components"), (F.sum("n") - F.max("n")).alias("n_dates_disconnected"))
    b = F.abs("bperp")
    stats = pairs.groupBy(*stack).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count("bperp").alias("n_with_baseline"),
        F.min("dt_days").alias("days_min"), F.median("dt_days").alias("days_median"), F.max("dt_days").alias("days_max"),
        F.min(b).alias("perp_min"), F.median(b).alias("perp_median"), F.max(b).alias("perp_max"),
    )
    out = comps.join(stats, list(stack), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_pairs", "n_with_baseline")})


def integrate_baselines(pairs: DataFrame, stack: Sequence[str], origins: DataFrame | None = None) -> DataFrame:
    """(stack..., date, bperp, hops): baselines relative to a date, summed along paths found breadth first.

    The date is that of ``origins`` (stack columns and ``origin``) where a
    known baseline touches it, else the earliest with one.  Neighbours are
    visited in order of the pairs' dates.  Pairs of unknown baseline are left
    out, dates not reached are omitted; chains may be of any length.
    """
    import pandas as pd

    known = pairs.where("bperp is not null").select(*stack, "ref", "sec", "bperp")
    given = known.withColumn("origin", F.lit(None).cast("date")) if origins is None else known.join(origins.select(*stack, "origin"), list(stack), "left")

    def work(pdf):
        near: dict = {}
        for ref, sec, b in sorted(zip(pdf["ref"], pdf["sec"], pdf["bperp"], strict=True)):
            near.setdefault(ref, []).append((sec, b))
            near.setdefault(sec, []).append((ref, -b))
        wished = pdf["origin"].iloc[0]
        start = wished if wished in near else min(near)
        reached, queue = {start: (0.0, 0)}, [start]
        for d in queue:
            for other, b in near[d]:
                if other not in reached:
                    reached[other] = (reached[d][0] + b, reached[d][1] + 1)
                    queue.append(other)
        return pd.DataFrame([(d, b, h) for d, (b, h) in reached.items()], columns=["date", "bperp", "hops"])

    return _per_stack(given, stack, work, "date date, bperp double, hops long")


def with_baselines(dates: DataFrame, pairs: DataFrame, stack: Sequence[str], max_perp_m: float, method: str = "sbas") -> tuple[DataFrame, DataFrame]:
    """(pairs kept, summary per stack) once the pairs' baselines are known.

    For ``sbas`` pairs beyond the threshold go (those of unknown baseline
    stay).  Baselines per date are integrated over all given pairs, the
    reference is recommended anew from them, and the network is summed up
    again with what is left; ``n_pairs_dropped`` tells how many went.
    """
    over = F.coalesce(F.abs("bperp") > max_perp_m, F.lit(False)) if method == "sbas" else F.lit(False)
    kept = pairs.where(~over)
    dropped = pairs.groupBy(*stack).agg(F.count_if(over).alias("n_pairs_dropped"))
    per_date = dates.select(*stack, "date").join(integrate_baselines(pairs, stack).select(*stack, "date", "bperp"), [*stack, "date"], "left")
    reference = recommend_reference(per_date, stack).select(*stack, "reference")
    summary = network_summary(dates, kept, stack).join(reference, list(stack), "left").join(dropped, list(stack), "left")
    return kept, summary.withColumn("n_pairs_dropped", F.coalesce("n_pairs_dropped", F.lit(0).cast("long")))


def group_candidates(records: DataFrame, group: Sequence[str], min_coverage: float) -> DataFrame:
    """Per group: dates and bursts of the two ways to a complete stack, and the one chosen.

    ``records``: group columns, ``burst``, ``date``, ``area`` of the burst as a
    share of the area of interest.  ``drop_bursts``: all dates, bursts present
    on every one; ``drop_dates``: all bursts, dates that have every one.  The
    first is taken if it covers ``min_coverage``, or no less than the other
    with no fewer dates.  A division: counts per burst and per date against
    the group's totals, nothing is gathered in arrays.
    """
    seen = records.groupBy(*group, "burst", "date").agg(F.max("area").alias("area"))
    per_burst = seen.groupBy(*group, "burst").agg(F.count(F.lit(1)).alias("on_dates"), F.max("area").alias("area"))
    per_date = seen.groupBy(*group, "date").agg(F.count(F.lit(1)).alias("n_bursts"))
    dates = per_date.groupBy(*group).agg(F.count(F.lit(1)).alias("n_dates"))
    bursts = per_burst.join(dates, list(group)).groupBy(*group, "n_dates").agg(
        F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("on_dates") == F.col("n_dates")).alias("n_common"),
        F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("on_dates") == F.col("n_dates"), F.col("area"))), F.lit(0.0))).alias("cov_a"),
        F.least(F.lit(1.0), F.sum("area")).alias("cov_all"),
    )
    full = per_date.join(bursts.select(*group, "n_union"), list(group)).groupBy(*group).agg(F.count_if(F.col("n_bursts") == F.col("n_union")).alias("n_complete"))
    out = bursts.join(full, list(group)).withColumn("cov_b", F.when(F.col("n_complete") > 0, F.col("cov_all")).otherwise(F.lit(0.0)))
    first = (F.col("cov_a") >= min_coverage) | (F.struct("cov_a", "n_dates") >= F.struct(F.col("cov_b"), F.col("n_complete")))
    return out.select(
        *group, "n_dates", "n_complete", "n_union", "n_common", "cov_a", "cov_b",
        F.when(first, "drop_bursts").otherwise("drop_dates").alias("chosen"),
        (F.col("n_union") - F.col("n_common")).alias("n_bursts_dropped"), (F.col("n_dates") - F.col("n_complete")).alias("n_dates_dropped"),
    )

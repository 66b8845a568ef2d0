"""Triplets of interferograms and their closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phase import cycles, wrap


def triplets(pairs: DataFrame, stack: Sequence[str]) -> DataFrame:
    """(stack..., d1, d2, d3) for dates whose three pairs all exist: two equi-joins on edges."""
    p = pairs.select(*stack, "ref", "sec").distinct()
    ij = p.select(*stack, F.col("ref").alias("d1"), F.col("sec").alias("d2"))
    jk = p.select(*stack, F.col("ref").alias("d2"), F.col("sec").alias("d3"))
    ik = p.select(*stack, F.col("ref").alias("d1"), F.col("sec").alias("d3"))
    return ij.join(jk, [*stack, "d2"]).join(ik, [*stack, "d1", "d3"], "left_semi").select(*stack, "d1", "d2", "d3")


def closure(pixels: DataFrame, pairs: DataFrame, stack: Sequence[str], *, wrapped: bool = False, pixel: Sequence[str] = ("px",)) -> DataFrame:
    """(stack..., d1, d2, d3, pixel..., closure, turns) where all three phases are known.

    ``pixels``: stack columns, ref, sec, pixel columns and ``phase`` (null:
    masked); ``turns``: whole cycles of the closure.
    """
    tri = triplets(pairs, stack)
    edge = lambda a, b, name: pixels.where("phase is not null").select(*stack, F.col("ref").alias(a), F.col("sec").alias(b), *pixel, F.col("phase").alias(name))
    c = tri.join(edge("d1", "d2", "p12"), [*stack, "d1", "d2"]).join(edge("d2", "d3", "p23"), [*stack, "d2", "d3", *pixel])
    c = c.join(edge("d1", "d3", "p13"), [*stack, "d1", "d3", *pixel])
    raw = F.col("p12") + F.col("p23") - F.col("p13")
    c = c.withColumn("raw", raw)
    value = wrap(F.col("raw")) if wrapped else F.col("raw")
    return c.select(*stack, "d1", "d2", "d3", *pixel, value.alias("closure"), cycles(F.col("raw") - wrap(F.col("raw"))).alias("turns"))


def triplet_stats(c: DataFrame, stack: Sequence[str]) -> DataFrame:
    """RMS closure and share of pixels with whole cycles, per triplet."""
    return c.groupBy(*stack, "d1", "d2", "d3").agg(
        F.sqrt(F.avg(F.col("closure") * F.col("closure"))).alias("rms"),
        (F.count_if(F.col("turns") != 0) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("nonzero_fraction"),
    )


def pixel_stats(c: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """RMS, number of triplets with whole cycles, and coherence of the closure, per pixel."""
    return c.groupBy(*pixel).agg(
        F.sqrt(F.avg(F.col("closure") * F.col("closure"))).alias("rms"), F.count_if(F.col("turns") != 0).alias("n_nonzero"),
        (F.hypot(F.sum(F.cos("closure")), F.sum(F.sin("closure"))) / F.count(F.lit(1))).alias("coherence"),
    )


def pair_scores(stats: DataFrame, pairs: DataFrame, stack: Sequence[str], value: str) -> DataFrame:
    """(stack..., ref, sec, score, n_triplets): mean of a triplet value over the triplets each pair joins, 0 for none."""
    edges = F.array(F.struct(F.col("d1").alias("ref"), F.col("d2").alias("sec")), F.struct(F.col("d2").alias("ref"), F.col("d3").alias("sec")), F.struct(F.col("d1").alias("ref"), F.col("d3").alias("sec")))
    each = stats.select(*stack, F.col(value).alias("v"), F.explode(edges).alias("e")).select(*stack, "e.ref", "e.sec", "v")
    means = each.groupBy(*stack, "ref", "sec").agg(F.avg("v").alias("score"), F.count("v").alias("n_triplets"))
    out = pairs.select(*stack, "ref", "sec").distinct().join(means, [*stack, "ref", "sec"], "left")
    return out.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("n_triplets", F.coalesce("n_triplets", F.lit(0).cast("long")))


def suspicious_pairs(stats: DataFrame, stack: Sequence[str], value: str, threshold: float) -> DataFrame:
    """(stack..., place, pair, score): the worst pair again and again, its triplets taken out, while its mean, to nine decimals, exceeds the threshold; the last pair of equals.

    One stack's triplets are one group: they are a network's edges, small
    whatever the number of pixels.
    """
    key = lambda a, b: F.concat_ws("_", F.date_format(a, "yyyyMMdd"), F.date_format(b, "yyyyMMdd"))
    rows = stats.select(*stack, key("d1", "d2").alias("p"), key("d2", "d3").alias("q"), key("d1", "d3").alias("r"), F.col(value).alias("v"))
    kinds = dict(rows.dtypes)

    def peel(pdf):
        import pandas as pd

        left = list(zip(pdf["p"], pdf["q"], pdf["r"], pdf["v"], strict=True))
        out, flagged = [], set()
        while left:
            total: dict[str, list[float]] = {}
            for *edges, v in left:
                for e in edges:
                    total.setdefault(e, []).append(v)
            ranked = [(round(sum(v) / len(v), 9), e) for e, v in total.items() if e not in flagged]
            if not ranked or max(ranked)[0] <= threshold:
                break
            score, worst = max(ranked)
            flagged.add(worst)
            out.append((len(out) + 1, worst, score))
            left = [t for t in left if worst not in t[:3]]
        found = pd.DataFrame(out, columns=["place", "pair", "score"])
        for c in stack:
            found[c] = pdf[c].iloc[0]
        return found[[*stack, "place", "pair", "score"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in stack), "place long", "pair string", "score double"])
    return rows.groupBy(*stack).applyInPandas(peel, schema)

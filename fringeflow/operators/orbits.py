"""Orbit geometry: positions between state vectors, zero-Doppler time, baseline components.

All of it is column expressions over two state vectors, structs of seconds
``t``, position ``x, y, z`` and velocity ``vx, vy, vz``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut

AXES = ("x", "y", "z")


def position(a: Column, b: Column, t: Column) -> Column:
    """Struct (x, y, z) on the cubic through two state vectors; beyond them it is extended."""
    h = b["t"] - a["t"]
    s = (t - a["t"]) / h
    at = lambda c: (2 * s * s * s - 3 * s * s + 1) * a[c] + (s * s * s - 2 * s * s + s) * h * a[f"v{c}"] + (3 * s * s - 2 * s * s * s) * b[c] + (s * s * s - s * s) * h * b[f"v{c}"]
    return F.struct(*[at(c).alias(c) for c in AXES])


def velocity(a: Column, b: Column, t: Column) -> Column:
    h = b["t"] - a["t"]
    s = (t - a["t"]) / h
    at = lambda c: ((6 * s * s - 6 * s) * a[c] + (3 * s * s - 4 * s + 1) * h * a[f"v{c}"] + (6 * s - 6 * s * s) * b[c] + (3 * s * s - 2 * s) * h * b[f"v{c}"]) / h
    return F.struct(*[at(c).alias(c) for c in AXES])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] - b[c]).alias(c) for c in AXES])


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def unit(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.struct(*[(a[c] / n).alias(c) for c in AXES])


def zero_doppler(a: Column, b: Column, target: Column, pad: float = 30.0, widest: float = 600.0, halvings: int = 50) -> Column:
    """Seconds at which the target is broadside, ``(P(t) - T) . V(t) = 0``; null where no sign change is found.

    The bracket is the arc and ``pad`` seconds on either side, widened in
    steps of ``pad`` up to ``widest``; then it is halved.  Along a cubic the
    condition is a polynomial of degree five in the arc's share, so its six
    coefficients are worked out once a row and every step costs five products.
    """
    h = b["t"] - a["t"]
    zero = F.lit(0.0)
    k = [zero] * 6
    for c in AXES:
        va, vb, apart = h * a[f"v{c}"], h * b[f"v{c}"], b[c] - a[c]
        q, p1, p2, p3 = a[c] - target[c], va, 3 * apart - 2 * va - vb, va + vb - 2 * apart
        terms = (q * p1, p1 * p1 + 2 * q * p2, 3 * (q * p3 + p1 * p2), 4 * p1 * p3 + 2 * p2 * p2, 5 * p2 * p3, 3 * p3 * p3)
        k = [x + y for x, y in zip(k, terms, strict=True)]
    names = [f"k{i}" for i in range(6)]
    fixed = lambda acc: [acc[n].alias(n) for n in (*names, "h")]

    def f(acc, s):
        out = acc["k5"]
        for n in reversed(names[:-1]):
            out = out * s + acc[n]
        return out / acc["h"]

    def bracket(acc, d):
        lo, hi = -d * pad / acc["h"], 1 + d * pad / acc["h"]
        return F.struct(*fixed(acc), F.coalesce(acc["lo"], F.when(f(acc, lo) <= 0, lo)).alias("lo"), F.coalesce(acc["hi"], F.when(f(acc, hi) >= 0, hi)).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        low = f(acc, mid) < 0
        return F.struct(*fixed(acc), F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    none = F.lit(None).cast("double")
    start = F.struct(*[x.alias(n) for x, n in zip(k, names, strict=True)], h.alias("h"), none.alias("lo"), none.alias("hi"))
    met = F.aggregate(F.sequence(F.lit(1), F.lit(int(widest // pad))), start, bracket)
    share = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), met, halve, lambda acc: F.when(acc["lo"].isNotNull() & acc["hi"].isNotNull(), (acc["lo"] + acc["hi"]) / 2))
    return a["t"] + share * h


def with_baseline(df: DataFrame, ref_a: str, ref_b: str, sec_a: str, sec_b: str, target: str, t_ref: str, t_sec: str, name: str = "baseline") -> DataFrame:
    """``df`` with a struct (perpendicular, parallel, along_track, total) of the secondary's position against the reference's, both at zero Doppler.

    Worked out in steps cut by checkpoints: the optimizer would put every
    step's expression in place of its name, over and over.
    """
    c = F.col
    out = df.withColumns({
        "_p": position(c(ref_a), c(ref_b), c(t_ref)), "_v": unit(velocity(c(ref_a), c(ref_b), c(t_ref))), "_q": position(c(sec_a), c(sec_b), c(t_sec)),
    })
    out = cut(out).withColumns({"_look": unit(minus(c("_p"), c(target))), "_apart": minus(c("_q"), c("_p"))})
    out = cut(out).withColumn("_normal", unit(cross(c("_v"), c("_look"))))
    out = cut(out)
    made = F.struct(dot(c("_apart"), c("_normal")).alias("perpendicular"), dot(c("_apart"), c("_look")).alias("parallel"), dot(c("_apart"), c("_v")).alias("along_track"), F.sqrt(dot(c("_apart"), c("_apart"))).alias("total"))
    return out.withColumn(name, made).drop("_p", "_v", "_q", "_look", "_apart", "_normal")

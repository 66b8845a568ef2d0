"""Estimators that need linear algebra or a whole sample: phase linking, sample tests, tile offsets, random screens."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def ks_distance(df: DataFrame, keys: Sequence[str], sample: str, value: str) -> DataFrame:
    """(keys..., d, n, m): largest gap between the running shares of two samples (``sample``: boolean), first sample first on ties."""
    w = Window.partitionBy(*keys)
    up = w.orderBy(value, F.desc(sample)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.col(sample).cast("int")
    known = df.where(F.col(value).isNotNull())
    c = known.withColumns({"_n": F.sum(one).over(w), "_m": F.sum(1 - one).over(w), "_a": F.sum(one).over(up), "_b": F.sum(1 - one).over(up)})
    c = c.where("_n > 0 and _m > 0")
    return c.groupBy(*keys).agg(F.max(F.abs(F.col("_a") / F.col("_n") - F.col("_b") / F.col("_m"))).alias("d"), F.first("_n").alias("n"), F.first("_m").alias("m"))


def kolmogorov_critical(alpha: float, n: int, m: int) -> float:
    """Distance above which two samples differ at level alpha: the Kolmogorov quantile times sqrt((n + m) / nm), by bisection of its series."""
    tail = lambda x: 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    low, high = 0.2, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > alpha else (low, mid)
    return (low + high) / 2 * math.sqrt((n + m) / (n * m))


def welch(df: DataFrame, keys: Sequence[str], sample: str, value: str) -> DataFrame:
    """(keys..., t, dof): the difference of two samples' means over its error, variances not pooled; null where a sample has under two values or neither varies."""
    of = lambda yes: F.when(F.col(sample) == yes, F.col(value).cast("double"))
    g = df.groupBy(*keys).agg(*[f(of(yes)).alias(f"_{n}{int(yes)}") for yes in (True, False) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.col("_v1") / F.col("_n1"), F.col("_v0") / F.col("_n0")
    known = (F.col("_n1") > 1) & (F.col("_n0") > 1) & (a + b > 0)
    dof = (a + b) * (a + b) / (a * a / (F.col("_n1") - 1) + b * b / (F.col("_n0") - 1))
    return g.select(*keys, F.when(known, (F.col("_m1") - F.col("_m0")) / F.sqrt(a + b)).alias("t"), F.when(known, dof).alias("dof"))


def coherence_of(z):
    """Complex coherence of epochs (rows) over samples; zero beside an epoch without power."""
    import numpy as np

    c = z @ z.conj().T
    power = np.sqrt(np.maximum(np.real(np.diag(c)), 0.0))
    scale = np.outer(power, power)
    return np.where(scale > 0, c / np.where(scale > 0, scale, 1.0), 0.0)


def phases_of(c, method: str = "evd", beta: float = 0.0):
    """Phases of a coherence matrix, the first at zero.

    ``evd``: the eigenvector of the largest eigenvalue of the matrix weighted
    by its magnitudes.  ``emi``: that of the smallest of the matrix weighted by
    the inverse of its magnitudes, which are drawn towards the identity by
    ``beta``.
    """
    import numpy as np

    if method == "evd":
        v = np.linalg.eigh(c * np.abs(c))[1][:, -1]
    else:
        v = np.linalg.eigh(c * np.linalg.inv((1 - beta) * np.abs(c) + beta * np.eye(len(c))))[1][:, 0]
    return np.angle(v * np.conj(v[0]))


def linked_phase(df: DataFrame, block: Sequence[str], epoch: str, re: str, im: str, sample: str, method: str = "evd", beta: float = 0.01, short: int | None = None) -> DataFrame:
    """(block..., epoch, phase, quality): linked phases of each block's epochs, first epoch at zero.

    Methods as in :func:`phases_of`.  With ``short``, runs of as many epochs
    are linked each, compressed to one image, and the images linked in turn.
    ``quality`` is the length of the mean misfit of all pairs of epochs, 1 for
    one epoch.  A block's samples by epochs are one small group; the grouped
    map does an eigendecomposition of epochs by epochs.
    """
    if method not in ("evd", "emi"):
        raise ValueError(f"unknown method {method!r}")
    if not 0 <= beta < 1:
        raise ValueError("beta must be in [0, 1)")
    if short is not None and short < 2:
        raise ValueError("a short stack has two epochs or more")
    kinds = dict(df.dtypes)

    def link(pdf):
        import numpy as np
        import pandas as pd

        epochs, e = np.unique(pdf[epoch], return_inverse=True)
        _, s = np.unique(pdf[sample], return_inverse=True)
        z = np.zeros((len(epochs), s.max() + 1), complex)
        z[e, s] = pdf[re].to_numpy() + 1j * pdf[im].to_numpy()
        n, size = len(epochs), short or len(epochs)
        runs = [slice(k, min(k + size, n)) for k in range(0, n, size)]
        phase = np.concatenate([phases_of(coherence_of(z[r]), method, beta) for r in runs])
        if len(runs) > 1:
            images = np.stack([np.exp(-1j * phase[r]) @ z[r] / np.sqrt(r.stop - r.start) for r in runs])
            for r, shift in zip(runs, phases_of(coherence_of(images), method, beta), strict=True):
                phase[r] += shift
            phase = np.angle(np.exp(1j * phase))
        a, b = np.triu_indices(n, 1)
        quality = abs(np.exp(1j * (np.angle(coherence_of(z)[a, b]) - phase[a] + phase[b])).mean()) if n > 1 else 1.0
        out = pd.DataFrame({c: pdf[c].iloc[0] for c in block}, index=range(n))
        return out.assign(**{epoch: epochs, "phase": phase, "quality": quality})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*block, epoch)), "phase double", "quality double"])
    return df.groupBy(*block).applyInPandas(link, schema)


def tile_offsets(edges: DataFrame, group: str) -> DataFrame:
    """(group, tile, cycles, residual): whole-cycle offsets of tiles by weighted least squares, tile 0 held at zero.

    ``edges``: group, a, b, cycle (b minus a), weight.  Tiles not connected to
    tile 0 get 0 by the smallest-norm solution.  A raster's tile graph is one
    small group.
    """
    kinds = dict(edges.dtypes)

    def solve(pdf):
        import numpy as np
        import pandas as pd

        tiles = np.unique(np.r_[pdf["a"], pdf["b"], 0])
        at = {t: i for i, t in enumerate(tiles)}
        w = np.sqrt(pdf["weight"].to_numpy(float))
        m = np.zeros((len(pdf) + 1, len(tiles)))
        rows = np.arange(len(pdf))
        m[rows, [at[t] for t in pdf["a"]]] -= w
        m[rows, [at[t] for t in pdf["b"]]] += w
        y = np.r_[w * pdf["cycle"].to_numpy(float), 0.0]
        m[-1, at[0]] = 1e3 * max(1.0, w.max(initial=1.0))
        x = np.rint(np.linalg.lstsq(m, y, rcond=None)[0])
        worst = float(np.abs(x[[at[t] for t in pdf["b"]]] - x[[at[t] for t in pdf["a"]]] - pdf["cycle"]).max())
        return pd.DataFrame({group: pdf[group].iloc[0], "tile": tiles, "cycles": x.astype("int64"), "residual": worst})

    return edges.groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, tile long, cycles long, residual double")


def power_law_screens(spark, n: int, ny: int, nx: int, exponent: float = 8 / 3, seed: int = 0) -> DataFrame:
    """(layer, row, col, value): n independent random screens of a power-law spectrum, unit deviation, seeded by layer."""

    def make(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for layer in pdf["id"]:
                rng = np.random.default_rng([seed, int(layer)])
                f = np.hypot(np.fft.fftfreq(ny)[:, None], np.fft.fftfreq(nx)[None])
                f[0, 0] = 1
                spectrum = np.fft.fft2(rng.standard_normal((ny, nx))) * f ** (-exponent / 2)
                spectrum[0, 0] = 0
                z = np.real(np.fft.ifft2(spectrum))
                y, x = np.mgrid[:ny, :nx]
                yield pd.DataFrame({"layer": layer, "row": y.ravel(), "col": x.ravel(), "value": (z / z.std()).ravel()})

    return spark.range(n).mapInPandas(make, "layer long, row long, col long, value double")

"""Pixel grids as rows (layer, row, col, value): moving windows, gradients, multilook, tiles, seams."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.phase import cycles, wrap
from .stats import finite


def _frame(size: int) -> tuple[int, int]:
    """Rows before and after the centre; even windows reach one further back."""
    return -(size // 2), size - 1 - size // 2


def box_sums(df: DataFrame, layer: Sequence[str], sums: dict[str, Column], wy: int, wx: int) -> DataFrame:
    """The grid with window sums more, edges cut off: running sums along rows, then along columns.

    The grid must be whole: a row for every pixel.
    """
    along = Window.partitionBy(*layer, "row").orderBy("col").rowsBetween(*_frame(wx))
    down = Window.partitionBy(*layer, "col").orderBy("row").rowsBetween(*_frame(wy))
    first = df.withColumns({f"_{n}": F.sum(c).over(along) for n, c in sums.items()})
    return first.withColumns({n: F.sum(f"_{n}").over(down) for n in sums}).drop(*[f"_{n}" for n in sums])


def box_filter(df: DataFrame, layer: Sequence[str], value: str, wy: int, wx: int, *, full: bool = False) -> DataFrame:
    """(layer..., row, col, box_sum, box_mean); null exactly where the window holds a missing value.

    ``box_mean`` divides by the pixels inside the grid, or with ``full`` by
    the whole window.
    """
    x = finite(F.col(value).cast("double"))
    out = box_sums(df, layer, {"box_sum": F.coalesce(x, F.lit(0.0)), "_missing": x.isNull().cast("int"), "_inside": F.lit(1)}, wy, wx)
    whole = F.col("_missing") == 0
    n = F.lit(wy * wx) if full else F.col("_inside")
    return out.select(*layer, "row", "col", F.when(whole, F.col("box_sum")).alias("box_sum"), F.when(whole, F.col("box_sum") / n).alias("box_mean"))


def coherence(df: DataFrame, layer: Sequence[str], re1: str, im1: str, re2: str, im2: str, wy: int, wx: int) -> DataFrame:
    """Moving-window coherence of two complex images in [0, 1]; 0 without power, null near a missing value."""
    a, b, c, d = (finite(F.col(x).cast("double")) for x in (re1, im1, re2, im2))
    bad = a.isNull() | b.isNull() | c.isNull() | d.isNull()
    z = lambda e: F.when(~bad, e).otherwise(F.lit(0.0))
    out = box_sums(df, layer, {"_re": z(a * c + b * d), "_im": z(b * c - a * d), "_p1": z(a * a + b * b), "_p2": z(c * c + d * d), "_bad": bad.cast("int")}, wy, wx)
    power = F.sqrt(F.col("_p1") * F.col("_p2"))
    value = F.when(power > 0, F.least(F.hypot("_re", "_im") / power, F.lit(1.0))).otherwise(F.lit(0.0))
    return out.select(*layer, "row", "col", F.when(F.col("_bad") == 0, value).alias("coherence"))


def fringe_density(df: DataFrame, layer: Sequence[str], phase: str) -> DataFrame:
    """Mean wrapped step between neighbours along rows and columns together, over pi."""
    along, down = Window.partitionBy(*layer, "row").orderBy("col"), Window.partitionBy(*layer, "col").orderBy("row")
    step = lambda w: F.abs(wrap(F.lead(phase).over(w) - F.col(phase)))
    steps = df.select(*layer, step(along).alias("x"), step(down).alias("y"))
    return steps.groupBy(*layer).agg(((F.coalesce(F.sum("x"), F.lit(0.0)) + F.coalesce(F.sum("y"), F.lit(0.0))) / (F.count("x") + F.count("y")) / math.pi).alias("density"))


def slope_aspect(df: DataFrame, layer: Sequence[str], height: str, dx: float, dy: float) -> DataFrame:
    """(layer..., row, col, slope, aspect) in degrees: central differences, one-sided at edges.

    The aspect is downslope, clockwise from north, 0 on flat ground; rows run
    south.  Null where the pixel or a neighbour in use is missing.
    """
    along, down = Window.partitionBy(*layer, "row").orderBy("col"), Window.partitionBy(*layer, "col").orderBy("row")

    def gradient(w: Window, spacing: float) -> Column:
        here = finite(F.col(height).cast("double"))
        before, after = F.lag(here).over(w), F.lead(here).over(w)
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        return F.when(first, (after - here) / spacing).when(last, (here - before) / spacing).otherwise((after - before) / (2 * spacing))

    g = df.withColumn("_x", gradient(along, dx)).withColumn("_y", gradient(down, -dy)).withColumn("_ok", finite(F.col(height).cast("double")).isNotNull())
    slope = F.degrees(F.atan(F.hypot("_x", "_y")))
    aspect = F.when(slope == 0, F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(-F.col("_x"), -F.col("_y"))), F.lit(360.0)))
    return g.select(*layer, "row", "col", F.when(F.col("_ok"), slope).alias("slope"), F.when(F.col("_ok"), aspect).alias("aspect"))


def multilook(df: DataFrame, layer: Sequence[str], az: int, rg: int, ny: Column, nx: Column, values: dict[str, Column]) -> DataFrame:
    """Aggregates over blocks of az rows and rg columns; partial blocks at the end are left out."""
    whole = (F.col("row") < F.floor(ny / az) * az) & (F.col("col") < F.floor(nx / rg) * rg)
    block = df.where(whole).withColumn("block_row", F.floor(F.col("row") / az).cast("long")).withColumn("block_col", F.floor(F.col("col") / rg).cast("long"))
    return block.groupBy(*layer, "block_row", "block_col").agg(*[v.alias(n) for n, v in values.items()])


def upsample(coarse: DataFrame, fine: DataFrame, layer: Sequence[str], factor: int, n_rows: int, n_cols: int) -> DataFrame:
    """Every fine pixel with its coarse block's columns; pixels past the last block take the last one's."""
    f = fine.withColumn("block_row", F.least(F.floor(F.col("row") / factor), F.lit(n_rows - 1)).cast("long")).withColumn("block_col", F.least(F.floor(F.col("col") / factor), F.lit(n_cols - 1)).cast("long"))
    return f.join(coarse, [*layer, "block_row", "block_col"])


def axis_tiles(n: int, k: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(extent start, extent stop, core start, core stop) of k tiles over n pixels.

    Core edges are i * n / k, halves to even; an extent reaches the whole
    overlap past an inner edge, half of it (rounded down) to the lower side.
    """
    if not (1 <= k <= n) or overlap < 0:
        raise ValueError("tiles must be between one and the number of pixels, the overlap not negative")
    edges = [round(i * n / k) for i in range(k + 1)]
    low = overlap // 2
    return [(max(0, a - (low if i else 0)), min(n, b + (overlap - low if i < k - 1 else 0)), a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def tiles(spark, ny: int, nx: int, rows: int, cols: int, overlap: int) -> DataFrame:
    """(tile, trow, tcol, ey0, ey1, ex0, ex1, cy0, cy1, cx0, cx1) of a grid of overlapping tiles."""
    out = []
    for r, (ey0, ey1, cy0, cy1) in enumerate(axis_tiles(ny, rows, overlap)):
        for c, (ex0, ex1, cx0, cx1) in enumerate(axis_tiles(nx, cols, overlap)):
            out.append((r * cols + c, r, c, ey0, ey1, ex0, ex1, cy0, cy1, cx0, cx1))
    names = "tile trow tcol ey0 ey1 ex0 ex1 cy0 cy1 cx0 cx1".split()
    return spark.createDataFrame(out, ", ".join(f"{n} long" for n in names))


def with_halo(px: DataFrame, grid: DataFrame) -> DataFrame:
    """Each pixel once for every tile whose extent holds it, with ``core`` where it is that tile's own."""
    inside = (F.col("row") >= F.col("ey0")) & (F.col("row") < F.col("ey1")) & (F.col("col") >= F.col("ex0")) & (F.col("col") < F.col("ex1"))
    own = (F.col("row") >= F.col("cy0")) & (F.col("row") < F.col("cy1")) & (F.col("col") >= F.col("cx0")) & (F.col("col") < F.col("cx1"))
    return px.join(F.broadcast(grid), inside).withColumn("core", own)


def feather_merge(tiled: DataFrame, value: str) -> DataFrame:
    """(row, col, merged): weighted mean over tiles, weights falling towards a tile's extent edge."""
    ramp = lambda at, lo, hi: F.least(F.col(at) - F.col(lo) + 1, F.col(hi) - F.col(at)).cast("double")
    w = ramp("row", "ey0", "ey1") * ramp("col", "ex0", "ex1")
    known = tiled.where(F.col(value).isNotNull()).withColumn("_w", w)
    return known.groupBy("row", "col").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("merged"))


def relabel(tiled: DataFrame, label: str) -> DataFrame:
    """(tile, row, col, label, unique_label): positive labels of tile cores numbered on across tiles, 0 stays 0.

    Labels are ranked inside their tile; a tile's offset is the number of
    labels in the tiles before, from one row per tile.
    """
    core = tiled.where("core")
    kinds = core.where(F.col(label) > 0).select("tile", label).distinct()
    kinds = kinds.withColumn("_k", F.row_number().over(Window.partitionBy("tile").orderBy(label)))
    counts = kinds.groupBy("tile").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tile", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    ids = kinds.join(offsets, "tile").select("tile", label, (F.col("_k") + F.col("_o")).cast("long").alias("unique_label"))
    out = core.join(ids, ["tile", label], "left")
    return out.select("tile", "row", "col", F.col(label).alias("label"), F.coalesce("unique_label", F.lit(0).cast("long")).alias("unique_label"))


def overlap_cycles(tiled: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """(a, b, cycle): whole cycles between adjacent tiles on each pixel both hold; b below or right of a."""
    g = grid.select("tile", "trow", "tcol")
    below = g.select(F.col("tile").alias("a"), (F.col("trow") + 1).alias("trow"), "tcol").join(g.withColumnRenamed("tile", "b"), ["trow", "tcol"]).select("a", "b")
    right = g.select(F.col("tile").alias("a"), "trow", (F.col("tcol") + 1).alias("tcol")).join(g.withColumnRenamed("tile", "b"), ["trow", "tcol"]).select("a", "b")
    pairs = below.unionByName(right)
    one = tiled.select(F.col("tile").alias("a"), "row", "col", F.col(value).alias("_va"))
    two = tiled.select(F.col("tile").alias("b"), "row", "col", F.col(value).alias("_vb"))
    met = one.join(F.broadcast(pairs), "a").join(two, ["b", "row", "col"])
    return met.select("a", "b", cycles(F.col("_va") - F.col("_vb")).alias("cycle")).where("cycle is not null")


def seam_cycles(merged: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """(axis, a, b, cycle): whole cycles across every seam between the cores of adjacent tiles."""
    down, along = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")
    steps = merged.withColumn("_up", F.col(value) - F.lag(value).over(down)).withColumn("_left", F.col(value) - F.lag(value).over(along))
    inside = (F.col("row") >= F.col("cy0")) & (F.col("row") < F.col("cy1")) & (F.col("col") >= F.col("cx0")) & (F.col("col") < F.col("cx1"))
    own = steps.join(F.broadcast(grid), inside)
    width = F.lit(grid.agg(F.max("tcol")).first()[0] + 1)
    rows = own.where("trow > 0 and row = cy0").select(F.lit("row").alias("axis"), (F.col("tile") - width).alias("a"), F.col("tile").alias("b"), cycles(F.col("_up")).alias("cycle"))
    cols = own.where("tcol > 0 and col = cx0").select(F.lit("col").alias("axis"), (F.col("tile") - 1).alias("a"), F.col("tile").alias("b"), cycles(F.col("_left")).alias("cycle"))
    return rows.unionByName(cols).where("cycle is not null")


#: Edge of the squares that the adaptive filter works on, in pixels; pixels that it transforms at once; about.
SQUARE, AT_ONCE = 64, 1 << 16


def adaptive_filter(df: DataFrame, layer: Sequence[str], re: str, im: str, *, size: int = 8, alpha: float = 0.5) -> DataFrame:
    """(layer..., row, col, re, im): spectral filter S|S|^alpha over half-overlapping patches, tapered and added up.

    Layers are cut into squares of about ``SQUARE`` pixels.  A pixel goes to
    its own square and to those that it is within half a patch of, so a group
    holds all that its own pixels need and finishes them; the patches of many
    squares are transformed together.
    """
    half = size // 2
    blocks = max(1, SQUARE // half)  # of half a patch, along a square's edge
    edge = half * blocks
    kinds = dict(df.dtypes)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / edge), F.floor((F.col(c) + half) / edge)))
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    parts = df.select(*layer, "row", "col", value(re).alias("re"), value(im).alias("im")).withColumn("_sy", near("row")).withColumn("_sx", near("col"))
    keys = [*layer, "_sy", "_sx"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*layer, "row", "col")), "re double", "im double"])
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_filtered(list(layer), half, size, blocks, alpha), schema)


def _filtered(layer: list[str], half: int, size: int, blocks: int, alpha: float):
    """The filter over rows sorted by layer and square."""
    import numpy as np
    import pyarrow as pa

    def starts(t):
        """Where the groups of equal keys begin."""
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in (*layer, "_sy", "_sx"):
            code = t.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def one(t):
        first = starts(t)
        group = np.repeat(np.arange(len(first)), np.diff([*first, t.num_rows]))
        y, x = (t.column(c).to_numpy().astype(np.int64) - t.column(s).to_numpy() * (half * blocks) for c, s in (("row", "_sy"), ("col", "_sx")))
        z = t.column("re").to_numpy() + 1j * t.column("im").to_numpy()
        # the four patches of each pixel, those that hold none of the square's own left out
        pixel, patch, place = [], [], []
        for dy in (0, 1):
            for dx in (0, 1):
                by, bx = y // half - dy, x // half - dx
                i = np.flatnonzero((by >= -1) & (by < blocks) & (bx >= -1) & (bx < blocks))
                pixel.append(i)
                patch.append((group[i] * (blocks + 1) + by[i] + 1) * (blocks + 1) + bx[i] + 1)
                place.append((y[i] - by[i] * half) * size + x[i] - bx[i] * half)
        pixel, patch, place = (np.concatenate(v) for v in (pixel, patch, place))
        known, patch = np.unique(patch, return_inverse=True)
        cells = np.zeros((len(known), size * size), complex)
        cells[patch, place] = z[pixel]
        s = np.fft.fft2(cells.reshape(-1, size, size))
        power = np.abs(s)
        smooth = sum(np.roll(power, (a, b), (1, 2)) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
        peak = smooth.max(axis=(1, 2), keepdims=True)
        out = np.fft.ifft2(s * (smooth / np.where(peak > 0, peak, 1)) ** alpha).reshape(len(known), -1)
        ramp = 1 - np.abs((np.arange(size) + 0.5) / half - 1)
        w = np.outer(ramp, ramp).ravel()[place]
        part, n = out[patch, place] * w, len(z)
        weight = np.bincount(pixel, w, n)
        own = np.flatnonzero((y >= 0) & (y < half * blocks) & (x >= 0) & (x < half * blocks))
        square = half * blocks
        own = own[np.unique((group[own] * square + y[own]) * square + x[own], return_index=True)[1]]  # a repeated pixel is told once
        kept = t.take(pa.array(own))
        re, im = (np.bincount(pixel, v, n)[own] / weight[own] for v in (part.real, part.imag))
        columns = [*(kept.column(c) for c in (*layer, "row", "col")), pa.array(re), pa.array(im)]
        return pa.table(columns, names=[*layer, "row", "col", "re", "im"]).to_batches()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= AT_ONCE:
                t = pa.Table.from_batches(held)
                last = starts(t)[-1]
                if last:
                    yield from one(t.slice(0, last))
                held, rows = t.slice(last).combine_chunks().to_batches(), t.num_rows - last
        if held:
            yield from one(pa.Table.from_batches(held))

    return run

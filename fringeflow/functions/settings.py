"""Settings resolved as columns: precedences, overlaps, windows, levels, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .footprints import box, outer_ring


def looks(nlooks: Column, looks_setting: Column, attribute: Column) -> Column:
    """Struct (value, source): the number of looks from the first setting that gives one, else 1.

    All three are text.  ``auto``, null and what is no number are passed over;
    a pair like ``[3, 9]`` stands for its product, lists of other lengths for
    nothing.
    """
    pair = r"^\s*\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]\s*$"
    part = lambda c, i: F.regexp_extract(c, pair, i).try_cast("long")
    number = lambda c: F.coalesce(c.try_cast("double"), (part(c, 1) * part(c, 2)).cast("double"))
    out = F.lit(None)
    for value, source in ((F.lit(1.0), "default"), (attribute.try_cast("double"), "attrs"), (number(looks_setting), "looks"), (number(nlooks), "nlooks")):
        out = F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source"))).otherwise(out)
    return out


def workers(planned: Column, configured: Column) -> Column:
    """Processes for one interferogram: as planned, else as configured, at least 1."""
    return F.greatest(F.coalesce(planned.try_cast("int"), configured.try_cast("int"), F.lit(1)), F.lit(1))


def axis_overlap(size: Column, tiles: Column, fraction: Column, least: Column) -> Column:
    """Struct (overlap, requested, capped): pixels by which the tiles of an axis overlap.

    A share of the tile's length, rounded half to even, but no less than
    ``least``; never more than the tile less one; none on an axis of one tile.
    """
    tile = F.ceil(size / tiles)
    asked = F.greatest(least.cast("long"), F.bround(fraction * tile).cast("long"))
    most = F.greatest(tile - 1, F.lit(0))
    tiled = tiles > 1
    none = F.lit(0).cast("long")
    return F.struct(
        F.when(tiled, F.least(asked, most)).otherwise(none).alias("overlap"),
        F.when(tiled, asked).otherwise(none).alias("requested"),
        F.coalesce(tiled & (asked > most), F.lit(False)).alias("capped"),
    )


def given_overlap(size: Column, tiles: Column, asked: Column) -> Column:
    """Struct (overlap, requested, capped) of an overlap given in pixels."""
    most = F.when(tiles > 1, F.greatest(F.ceil(size / tiles) - 1, F.lit(0))).otherwise(0)
    return F.struct(F.least(asked.cast("long"), most).alias("overlap"), asked.cast("long").alias("requested"), (asked > most).alias("capped"))


def box_snwe(setting: Column, note: Column, wkt: Column) -> Column:
    """Struct (s, n, w, e): four numbers from the setting, or, where there is none, from the note; else around the polygon; else null."""
    parts = F.split(F.trim(F.replace(F.coalesce(setting, note), F.lit(","), F.lit(" "))), r"\s+")
    four = [F.get(parts, F.lit(i)).try_cast("double") for i in range(4)]
    whole = F.coalesce(F.size(parts) == 4, F.lit(False))
    for x in four:
        whole = whole & x.isNotNull()
    b = box(outer_ring(wkt))
    around = F.when(b.isNotNull(), F.struct(*[b[k].alias(k) for k in "snwe"]))
    return F.when(whole, F.struct(*[x.alias(k) for x, k in zip(four, "snwe", strict=True)])).otherwise(around)


def sensing_date(name: Column) -> Column:
    """yyyymmdd of the first ``_yyyymmddThhmmss_`` in a product's name; null without one."""
    return F.nullif(F.regexp_extract(name, r"_(\d{8})T\d{6}_", 1), F.lit(""))


def overview_factors(rows: Column, columns: Column, block: int) -> Column:
    """Powers of two down to the first level of a raster that fits in one block."""
    side = F.greatest(rows, columns)
    levels = F.greatest(F.ceil(F.log2(side / F.lit(block))), F.lit(0)).cast("int")
    # A logarithm may miss a power by one unit in its last place, so one level more is looked at.
    powers = F.transform(F.sequence(F.lit(1), levels + 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.filter(powers, lambda f: side / (f / 2) > block)


def padded_window(low: Column, high: Column, size: Column, pad: int = 2) -> Column:
    """Struct (start, length): whole pixels that hold [low, high] of an axis, padded and clipped to the raster; null where under two are left.

    ``low`` and ``high`` are in pixels from the raster's edge.
    """
    start = F.floor(low)
    a, b = F.greatest(start - pad, F.lit(0)), F.least(start + F.ceil(high - low) + pad, size)
    return F.when(b - a >= 2, F.struct(a.cast("long").alias("start"), (b - a).cast("long").alias("length")))


def request_key(**fields: Column) -> Column:
    """32 hex digits of a request: SHA-256 of its fields as compact JSON, sorted by name."""
    return F.left(F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256), F.lit(32))


def orbit_request(mission: Column, day: Column, kind: str = "precise") -> Column:
    """The key of a request for a day's orbit file."""
    if kind not in ("precise", "restituted"):
        raise ValueError(f"unknown orbit type {kind!r}")
    return request_key(kind=F.lit("orbit"), mission=F.upper(mission), date=F.date_format(day, "yyyy-MM-dd"), orbit_type=F.lit(kind))


def phase_of(real: Column, imaginary: Column) -> Column:
    """The wrapped phase of a complex sample; of a real one (no imaginary part) itself."""
    return F.when(imaginary.isNull(), real).otherwise(F.atan2(imaginary, real))


def from_truth(truth: Column, masked: Column, cycles: float = 0.0) -> Column:
    """Struct (unw, label) of the test method that gives the known phase back, shifted by whole cycles; nothing where masked."""
    hidden = F.coalesce(masked, F.lit(False))
    return F.struct(F.when(~hidden, truth + cycles * 6.283185307179586).alias("unw"), F.when(hidden, 0).otherwise(1).alias("label"))

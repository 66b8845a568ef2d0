"""Text: identifiers, polarisations, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The co-polarised channels.
CO_POLARISATIONS = ("VV", "HH")


def burst_track(burst_id: Column) -> Column:
    """Leading track number of an identifier like 017_034567_IW2; null otherwise."""
    return F.when(burst_id.rlike(r"^\d{3}_\d{6}_IW\d$"), F.substring(burst_id, 1, 3).cast("int"))


def major_version(version: Column) -> Column:
    """Leading integer; null if there is none."""
    return F.regexp_extract(version, r"^\s*(\d+)", 1).try_cast("int")


def polarisations(p: Column) -> Column:
    """Tokens of VV+VH or VV/VH, upper case, blanks trimmed."""
    return F.transform(F.split(F.translate(F.upper(p), "/", "+"), r"\+"), lambda t: F.trim(t))


def co_polarised(p: Column) -> Column:
    return F.arrays_overlap(polarisations(p), F.array(*[F.lit(c) for c in CO_POLARISATIONS]))


def stack_id(track: Column, direction: Column, polarisation: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(track.cast("string"), 3, "0"), F.substring(direction, 1, 1), F.lit("_"), polarisation)


def shorten(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something is missing."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def binary_size(n: Column, largest: str = "TiB") -> Column:
    """Bytes in the largest binary unit, up to ``largest``, that leaves at least one; a tenth that is halfway goes to the even one."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    units = ("KiB", "MiB", "GiB", "TiB")
    for k, unit in enumerate(units[: units.index(largest) + 1], 1):
        whole, rest = F.shiftright(n, 10 * k), n.bitwiseAND(F.lit(1024**k - 1)) * 10
        tenths, over = F.shiftright(rest, 10 * k), rest.bitwiseAND(F.lit(1024**k - 1)) * 2
        up = (over > 1024**k) | ((over == 1024**k) & (tenths % 2 == 1))
        tenths = whole * 10 + tenths + up.cast("long")
        out = F.when(n >= 1024**k, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def key_values(text: Column, pair: str = "\n", between: str = "=") -> Column:
    """Map of trimmed ``key = value`` lines."""
    return F.str_to_map(F.regexp_replace(text, rf"[ \t]*{between}[ \t]*", between), F.lit(pair), F.lit(between))


def first_listed(items: Column, n: int = 6) -> Column:
    """The first n of an array of strings, comma-separated, with dots if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(F.size(items) > n, F.lit(", ...")).otherwise(F.lit("")))

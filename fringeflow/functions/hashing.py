"""Content and parameter hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_map(m: Column) -> Column:
    """Compact JSON of a string map, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def params_hash(m: Column) -> Column:
    """First 16 hex digits of the digest of a map's canonical JSON."""
    return F.substring(F.sha2(canonical_map(m), 256), 1, 16)


def combined_hash(parts: list[Column]) -> Column:
    """Digest of several strings, each closed by a zero byte, so that no two lists meet."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in parts]), 256)


def public_keys(m: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_"))


def within_tolerance(name: Column, old: Column, new: Column, rtol: float = 1e-6, atol: float = 1e-9, fraction: float = 1e-4) -> Column:
    """Whether two values agree; names that end in _fraction by absolute difference alone; two NaNs or nulls agree."""
    both_missing = (old.isNull() | F.isnan(old)) & (new.isNull() | F.isnan(new))
    close = F.when(name.endswith("_fraction"), F.abs(new - old) <= fraction).otherwise(F.abs(new - old) <= atol + rtol * F.abs(old))
    return both_missing | F.coalesce(close & ~F.isnan(old) & ~F.isnan(new), F.lit(False))

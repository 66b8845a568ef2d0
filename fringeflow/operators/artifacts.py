"""What stages leave behind: grids, layers, product files, manifests, knowledge-base entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def grid_transforms(axes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., west, north, dx, dy, flip, regular): the affine grid of each raster, rows from north to south.

    ``axes``: keys, axis (``y`` latitudes, ``x`` longitudes), i from 0, v: the
    pixel centres.  A grid is regular if every step is its axis' first one to
    two parts in a thousand; the rest is null otherwise.  ``flip``: latitudes
    rise with the row.  An axis of one pixel has the step 0.001.  A group of
    the window is one axis of one raster.
    """
    g = [*keys, "axis"]
    step = F.col("v") - F.lag("v").over(Window.partitionBy(*g).orderBy("i"))
    a = axes.withColumn("_d", step).groupBy(*g).agg(
        F.count("*").alias("n"), F.min_by("v", "i").alias("a"), F.max_by("v", "i").alias("b"), F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col("i"))).alias("d"), F.min("_d").alias("lo"), F.max("_d").alias("hi")
    )
    d = F.coalesce("d", F.when(F.col("axis") == "y", -0.001).otherwise(0.001))
    even = F.coalesce((F.col("hi") - d <= 0.002 * F.abs(d)) & (d - F.col("lo") <= 0.002 * F.abs(d)), F.lit(True))
    one = F.struct("a", "b", d.alias("d"), even.alias("even"))
    both = a.groupBy(*keys).agg(F.max(F.when(F.col("axis") == "y", one)).alias("y"), F.max(F.when(F.col("axis") == "x", one)).alias("x"))
    ok, flip = F.coalesce(F.col("y.even") & F.col("x.even"), F.lit(False)), F.col("y.d") > 0
    north = F.when(flip, F.col("y.b")).otherwise(F.col("y.a")) + F.abs("y.d") / 2
    cells = {"west": F.col("x.a") - F.col("x.d") / 2, "north": north, "dx": F.col("x.d"), "dy": -F.abs("y.d"), "flip": flip}
    return both.select(*keys, *[F.when(ok, c).alias(n) for n, c in cells.items()], ok.alias("regular"))


def attached(stack: DataFrame, layers: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The stack with the layers' values where they have the pixel, null elsewhere; values that the stack has already are replaced."""
    return stack.drop(*values).join(layers.select(*keys, *values), list(keys), "left")


def worth_showing(alternatives: DataFrame, stack: str, dropped: Sequence[str]) -> DataFrame:
    """All alternatives of the stacks in which at least one leaves something out."""
    cuts = F.lit(False)
    for c in dropped:
        cuts = cuts | (F.coalesce(F.col(c), F.lit(0)) != 0)
    return alternatives.join(alternatives.where(cuts).select(stack).distinct(), stack, "left_semi")


def clipped_first(files: DataFrame, keys: Sequence[str], suffix: str, infix: str = "_clip", end: str = ".tif") -> DataFrame:
    """(keys..., name): of the files called ``*<suffix>``, with or without the infix, a clipped one before a plain one, then the first by name."""
    clipped = F.endswith("name", F.lit(suffix + infix + end))
    plain = F.endswith("name", F.lit(suffix + end))
    return files.where(clipped | plain).groupBy(*keys).agg(F.min_by("name", F.struct(~clipped, F.col("name"))).alias("name"))


def product_folders(files: DataFrame, key: str, suffix: str) -> DataFrame:
    """(key, folder): the folder that holds a file of the suffix: the key's own, else the first by name one level down; no row without one.

    ``files``: key, path below the key's folder, with ``/`` between parts.
    """
    parts = F.split("path", "/")
    met = files.where(F.endswith("path", F.lit(suffix)) & (F.size(parts) <= 2))
    return met.groupBy(key).agg(F.min(F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise("")).alias("folder"))


def manifests(files: DataFrame, schema: str, required: Sequence[str]) -> DataFrame:
    """(path, record): manifests read from their text; null where the text is no JSON of the schema or lacks a required field, which counts as a miss."""
    record = F.from_json("text", schema + ", _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    r = files.select("path", record.alias("record"))
    whole = F.col("record._damaged").isNull()
    for c in required:
        whole = whole & F.col(f"record.{c}").isNotNull()
    return r.select("path", F.when(whole, F.col("record").dropFields("_damaged")).alias("record"))


def folder_sizes(files: DataFrame, key: Column) -> DataFrame:
    """(folder, bytes, n_files): everything below each folder."""
    return files.groupBy(key.alias("folder")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_files"))


def entry_problems(entries: DataFrame) -> DataFrame:
    """(id, problem): what is wrong with knowledge-base entries, each thing once an id.

    ``entries``: id, pattern, extract and supersedes (arrays of names, or
    null).  Ids are ``KB-<ENGINE>-<NNN>`` and unique, extracted groups are
    named groups of the pattern, superseded ids exist.  That patterns compile
    is for the reader to see.
    """
    form = ~F.col("id").rlike(r"^KB-[A-Z0-9]+-\d{3}$")
    named = F.regexp_extract_all("pattern", F.lit(r"\(\?P?<([A-Za-z_]\w*)>"), F.lit(1))
    lacks = F.size(F.array_except(F.coalesce("extract", F.array().cast("array<string>")), named)) > 0
    say = lambda df, text: df.select("id", F.lit(text).alias("problem"))
    twice = entries.groupBy("id").count().where("count > 1")
    unknown = entries.select("id", F.explode("supersedes").alias("other")).join(entries.select(F.col("id").alias("other")).distinct(), "other", "left_anti")
    found = say(entries.where(form | F.col("id").isNull()), "form").union(say(entries.where(lacks), "extract")).union(say(twice, "repeated")).union(say(unknown, "supersedes"))
    return found.distinct()


def grid_mismatches(stacks: DataFrame, igrams: DataFrame, key: str) -> DataFrame:
    """(key, ny, nx, expected_ny, expected_nx): stacks whose grid isn't that of their interferogram; a missing side is for other checks to report."""
    other = igrams.select(key, F.col("ny").alias("expected_ny"), F.col("nx").alias("expected_nx"))
    return stacks.select(key, "ny", "nx").join(other, key).where("ny <> expected_ny or nx <> expected_nx")

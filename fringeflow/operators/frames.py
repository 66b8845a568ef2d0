"""Small helpers over DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder; on one machine a temporary one where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins_maps(*maps):
    """Union of string maps, the rightmost value of a key holding."""
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, value))

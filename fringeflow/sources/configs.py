"""Readers of settings written as YAML: knowledge bases, parameter grids, price tiers, experiments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _as_json(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml  # only where YAML is read

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return json.dumps(yaml.safe_load(text), default=str), None
        except yaml.YAMLError as e:
            return None, str(e).splitlines()[0]

    for batch in texts:
        out = [one(t) for t in batch["value"]]
        yield pd.DataFrame({"path": batch["path"], "json": [j for j, _ in out], "problem": [p for _, p in out]}, dtype=object)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, json, problem): each file as JSON, or what is wrong with it."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.mapInPandas(_as_json, "path string, json string, problem string")


ENTRY = "array<struct<id:string,engine:string,stage:string,pattern:string,ignore_case:boolean,extract:array<string>,severity:string,supersedes:array<string>,pattern_verified:boolean,pattern_source:string>>"


def _compiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def ok(p: str | None) -> bool:
        try:
            re.compile(p or "", re.MULTILINE)
        except re.error:
            return False
        return bool(p)

    for b in batches:
        yield b.map(ok).astype(bool)


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry, by id, with ``compiles``; :func:`fringeflow.operators.artifacts.entry_problems` says what else is wrong."""
    check = F.pandas_udf(_compiles, "boolean")
    rows = read_yaml(spark, path).select("path", F.inline(F.from_json("json", ENTRY)))
    return rows.withColumn("compiles", check("pattern")).orderBy("id")


def entries_for(entries: DataFrame, engine: str | None) -> DataFrame:
    """The entries of an engine and of any; all where none is named."""
    return entries if engine is None else entries.where(F.col("engine").isin(engine, "any"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, key, values): the lists of a parameter grid as JSON texts, in the file's order.

    The lists lie under ``grid``, or at the top of a file that names neither
    objectives nor a limit.  A single value is a list of one.  Keys without a
    dot and empty lists are refused.
    """
    top = F.from_json("json", "map<string,string>")
    plain = ~F.map_contains_key(top, "objectives") & ~F.map_contains_key(top, "max_points")
    own = F.when(F.map_contains_key(top, "grid"), F.from_json(top["grid"], "map<string,string>")).when(plain, top)
    text = F.col("value")
    listed = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.array(text))
    rows = read_yaml(spark, path).select("path", F.posexplode(own).alias("position", "key", "value")).select("path", "position", "key", listed.alias("values"))
    bad = rows.where(~F.contains("key", F.lit(".")) | (F.size("values") < 1)).select(F.concat_ws(", ", "path", "key")).head(1)
    if bad:
        raise ValueError(f"keys must be dotted and have values: {bad[0][0]}")
    return rows


def read_price_tiers(spark: SparkSession, path: str) -> DataFrame:
    """(looks, max_pairs, credits, pixel_m): the tiers of a price list."""
    own = F.from_json("json", "burst_insar map<string,struct<pixel_m:int,tiers:array<struct<max_pairs:int,credits:double>>>>")["burst_insar"]
    spec = read_yaml(spark, path).select(F.explode(own).alias("looks", "spec"))
    return spec.select("looks", F.inline("spec.tiers"), F.coalesce("spec.pixel_m", F.lit(0)).alias("pixel_m")).select("looks", "max_pairs", "credits", "pixel_m")


def read_experiments(spark: SparkSession, path: str, methods: list[str], metrics: list[str]) -> DataFrame:
    """(path, name, method, seed): one row a run of an experiment; methods or metrics that are not known are refused."""
    e = read_yaml(spark, path).select("path", F.from_json("json", "name string, seeds array<int>, methods array<string>, metrics array<string>").alias("e"))
    for field, known in (("methods", methods), ("metrics", metrics)):
        odd = e.select(F.explode(F.array_except(F.coalesce(f"e.{field}", F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))).alias("x")).head(1)
        if odd:
            raise ValueError(f"unknown among the {field}: {odd[0].x!r}")
    return e.select("path", "e.name", F.explode("e.methods").alias("method"), F.col("e.seeds").alias("seeds")).select("path", "name", "method", F.explode(F.coalesce("seeds", F.array(F.lit(0)))).alias("seed"))

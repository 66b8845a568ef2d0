"""Acquisition catalogues, ground truth, orbits, job lists, pixel layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BURST = (
    "granule_id string, platform string, mode string, subswath string, full_burst_id string, relative_orbit int, absolute_orbit int, flight_direction string, polarization string, "
    "acquisition_time string, ipf_version string, range_pixel_spacing_m double, azimuth_pixel_spacing_m double, incidence_near_deg double, incidence_far_deg double, footprint_wkt string, url string, product_type string"
)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Burst records of a JSON file: a list, or an envelope with ``records`` at the top or under ``data``; ``seq`` keeps their order."""
    fields = ",".join(f"{n}:{k}" for n, k in (f.split() for f in BURST.split(", ")))
    records = f"array<struct<{fields}>>"
    raw = spark.read.text(path, wholetext=True).select("value")
    envelope = f"struct<records:{records},data:struct<records:{records}>>"
    own = F.from_json("value", envelope)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", records))
    rows = raw.select(F.posexplode(F.coalesce(listed, own["records"], own["data"]["records"])).alias("seq", "r")).select("seq", "r.*")
    when = F.to_timestamp(F.regexp_replace("acquisition_time", "Z$", "+00:00"))
    return rows.withColumn("acquisition_time", when).withColumn("acquisition_date", F.to_date("acquisition_time"))


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, findings) of a CSV with site_id, lat, lon, date and any of elev_m, up_m, east_m, north_m, sigma_m, method.

    Findings name the line, counted from 2, and the first rule that it breaks.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip().lower().lstrip("﻿") for c in raw.columns])
    for c in ("site_id", "lat", "lon", "date", "elev_m", "up_m", "east_m", "north_m", "sigma_m", "method"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    num = lambda c: F.col(c).try_cast("double")
    day = F.coalesce(F.try_to_date("date", "yyyy-MM-dd"), F.try_to_date("date", "yyyyMMdd"))
    broken = (
        F.when(F.coalesce(F.trim("site_id"), F.lit("")) == "", "VAL-002")
        .when(num("lat").isNull() | ~num("lat").between(-90, 90), "VAL-003")
        .when(num("lon").isNull() | ~num("lon").between(-180, 180), "VAL-004")
        .when(day.isNull(), "VAL-005")
        .when(num("up_m").isNull() & (num("east_m").isNull() | num("north_m").isNull()), "VAL-006")
        .when(num("sigma_m") < 0, "VAL-007")
    )
    rows = raw.withColumn("rule", broken)
    good = rows.where("rule is null").select(
        "site_id", *[num(c).alias(c) for c in ("lat", "lon", "elev_m", "up_m", "east_m", "north_m", "sigma_m")], day.alias("date"), F.coalesce("method", F.lit("leveling")).alias("method")
    )
    return good, rows.where("rule is not null").select("rule", "site_id", "date")


def combined_ground_truth(levelling: DataFrame | None = None, gnss: DataFrame | None = None) -> DataFrame:
    """Both kinds of ground truth in one table; refused where there is neither."""
    given = [df for df in (levelling, gnss) if df is not None]
    if not given:
        raise ValueError("VAL-014: neither levelling nor GNSS was given")
    out = given[0]
    for df in given[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_orbits(spark: SparkSession, path: str) -> DataFrame:
    """(time, x, y, z, vx, vy, vz) of the state vectors in orbit files, in order of time by file."""
    schema = "UTC string, X struct<_VALUE:double,_unit:string>, Y struct<_VALUE:double,_unit:string>, Z struct<_VALUE:double,_unit:string>, VX struct<_VALUE:double,_unit:string>, VY struct<_VALUE:double,_unit:string>, VZ struct<_VALUE:double,_unit:string>"
    raw = spark.read.format("xml").option("rowTag", "OSV").schema(schema).load(path)
    time = F.to_timestamp(F.regexp_replace("UTC", "^UTC=", ""))
    return raw.select(F.input_file_name().alias("file"), time.alias("time"), *[F.col(f"{c}._VALUE").alias(c.lower()) for c in ("X", "Y", "Z", "VX", "VY", "VZ")])


def orbit_file_parts(name) -> list:
    """Mission, type and validity of an orbit file's name, as columns."""
    pattern = r"(S1[A-D])_OPER_AUX_(POEORB|RESORB|PREORB)_OPOD_(\d{8}T\d{6})_V(\d{8}T\d{6})_(\d{8}T\d{6})"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    time = lambda k: F.try_to_timestamp(part(k), F.lit("yyyyMMdd'T'HHmmss"))
    return [part(1).alias("mission"), part(2).alias("kind"), time(3).alias("created"), time(4).alias("start"), time(5).alias("stop")]


def read_job_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, step, line_no, command) of job files: blanks, comments and waits dropped, a trailing & cut off."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    command = F.trim(F.regexp_replace(F.trim("line"), r"\s*&\s*$", ""))
    step = F.regexp_extract("file", r"(\d+)[^/]*$", 1).try_cast("int")
    rows = raw.select("file", step.alias("step"), (F.col("line_no") + 1).alias("line_no"), command.alias("command"))
    return rows.where((F.length("command") > 0) & ~F.col("command").startswith("#") & (F.col("command") != "wait"))


def read_logs(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".log", ".out", ".err", ".txt"), tail: int = 4 << 20) -> DataFrame:
    """(path, text) of log files below a folder: known suffixes, no binary files, newlines normalised, long files by their end."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = raw.where(F.lower("path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    text_only = named.where(F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 4096)), "(..)", "$1 ")) == 0)
    end = F.when(F.length("content") > tail, F.substring("content", -tail, tail)).otherwise(F.col("content"))
    return text_only.select("path", F.regexp_replace(F.decode(end, "UTF-8"), "\r\n?", "\n").alias("text"))


def append_layers(spark: SparkSession, layers: DataFrame, path: str, key: str = "pair") -> int:
    """Append the layers whose key the store doesn't hold; the number of those it held."""
    try:
        have = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # a store that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    fresh = layers if have is None else layers.join(have, key, "left_anti")
    again = 0 if have is None else layers.join(have, key, "left_semi").select(key).distinct().count()
    fresh.repartition(key).write.mode("append").partitionBy(key).parquet(path)
    return again

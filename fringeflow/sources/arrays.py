"""Arrays in files as long pixel tables: interchange stacks, time series, tiles, flat binary rasters."""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Data types and byte orders of flat rasters.
RASTER_TYPES = {"BYTE": "u1", "SHORT": "i2", "INT": "i4", "LONG": "i8", "FLOAT": "f4", "DOUBLE": "f8", "CFLOAT": "c8", "CDOUBLE": "c16"}
BYTE_ORDERS = {"l": "<", "b": ">"}


def _npz(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _number(a: np.ndarray) -> pa.Array:
    """Doubles, missing ones null."""
    a = np.asarray(a, np.float64).ravel()
    return pa.array(a, mask=~np.isfinite(a))


def read_pair_stack(spark: SparkSession, path: str) -> DataFrame:
    """(path, pair, row, col, wrapped, coh, mask, unw, conncomp) of interchange stacks; arrays that a file lacks are null."""
    names = (("wrapped", "wrapped"), ("coherence", "coh"), ("mask", "mask"), ("unw", "unw"), ("conncomp", "conncomp"))

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = _npz(content.as_py())
                ny, nx = z["wrapped"].shape[1:]
                row, col = (pa.array(x.ravel().astype(np.int32)) for x in np.mgrid[0:ny, 0:nx])
                for k, pair in enumerate(z["pairs"].tolist()):
                    layer = [_number(z[n][k] if z[n].ndim == 3 else z[n]) if n in z else pa.nulls(ny * nx, pa.float64()) for n, _ in names]
                    yield pa.RecordBatch.from_arrays([pa.array([where] * (ny * nx)), pa.array([str(pair)] * (ny * nx)), row, col, *layer], ["path", "pair", "row", "col", *[c for _, c in names]])

    out = _files(spark, path).mapInArrow(run, "path string, pair string, row int, col int, wrapped double, coh double, mask double, unw double, conncomp double")
    return out.withColumn("mask", F.col("mask").cast("boolean")).withColumn("conncomp", F.col("conncomp").cast("int"))


def read_time_series(spark: SparkSession, path: str, *, corner: tuple[float, float] | None = None, centre: tuple[float, float] | None = (37.55, 126.95), pixel_m: float = 40.0) -> DataFrame:
    """(path, date, row, col, displacement_m, lat, lon) of time-series files.

    Where a file has no coordinates they are made up: from the north-west
    ``corner`` if given, metres per degree of longitude shortened by its
    latitude, else around ``centre``.
    """

    def grid(z, ny, nx):
        if "lat" in z and "lon" in z:
            return z["lat"], z["lon"]
        y, x = np.mgrid[0:ny, 0:nx].astype(np.float64)
        if corner is not None:
            return corner[0] - y * pixel_m / 111_320.0, corner[1] + x * pixel_m / (111_320.0 * np.cos(np.radians(corner[0])))
        return centre[0] - (y - (ny - 1) / 2) * pixel_m / 111_320.0, centre[1] + (x - (nx - 1) / 2) * pixel_m / (111_320.0 * np.cos(np.radians(centre[0])))

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = _npz(content.as_py())
                d = z["displacement_m"]
                ny, nx = d.shape[1:]
                lat, lon = (_number(np.broadcast_to(g, (ny, nx))) for g in grid(z, ny, nx))
                row, col = (pa.array(x.ravel().astype(np.int32)) for x in np.mgrid[0:ny, 0:nx])
                for k, day in enumerate(z["dates"].tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array([where] * (ny * nx)), pa.array([str(day)] * (ny * nx)), row, col, _number(d[k]), lat, lon], ["path", "date", "row", "col", "displacement_m", "lat", "lon"])

    return _files(spark, path).mapInArrow(run, "path string, date string, row int, col int, displacement_m double, lat double, lon double").withColumn("date", F.to_date("date"))


def sidecar(xml: str) -> dict:
    """Width, length, type, scheme, bands and byte order that a raster's sidecar names, whatever the case of the names."""
    given = {n.strip().lower(): v.strip() for n, v in re.findall(r"<property\s+name=\"([^\"]+)\"\s*>\s*(?:<[^>]*>[^<]*</[^>]*>\s*)*?<value>([^<]*)</value>", xml)}
    out = {
        "width": int(given["width"]), "length": int(given["length"]), "type": given.get("data_type", "FLOAT").upper(),
        "scheme": given.get("scheme", "BIP").upper(), "bands": int(given.get("number_bands", 1)), "order": given.get("byte_order", "l"),
    }
    if out["type"] not in RASTER_TYPES or out["scheme"] not in ("BIL", "BIP", "BSQ") or out["order"] not in BYTE_ORDERS:
        raise ValueError(f"a raster of unknown form: {out}")
    return out


def raster(content: bytes, form: dict) -> np.ndarray:
    """(band, row, col) of a flat raster."""
    a = np.frombuffer(content, BYTE_ORDERS[form["order"]] + RASTER_TYPES[form["type"]])
    b, ny, nx = form["bands"], form["length"], form["width"]
    if form["scheme"] == "BSQ":
        return a.reshape(b, ny, nx)
    if form["scheme"] == "BIL":
        return a.reshape(ny, b, nx).transpose(1, 0, 2)
    return a.reshape(ny, nx, b).transpose(2, 0, 1)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, band, row, col, re, im) of flat binary rasters that have a sidecar of their name with ``.xml`` added; ``im`` is null for real types."""
    both = spark.read.format("binaryFile").load(path).select("path", "content")
    forms = both.where(F.col("path").endswith(".xml")).select(F.regexp_replace("path", r"\.xml$", "").alias("path"), F.decode("content", "UTF-8").alias("xml"))
    data = both.where(~F.col("path").endswith(".xml")).join(forms, "path").select("path", "content", "xml")

    def run(batches):
        for batch in batches:
            for where, content, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = raster(content, sidecar(xml))
                ny, nx = a.shape[1:]
                row, col = (pa.array(x.ravel().astype(np.int32)) for x in np.mgrid[0:ny, 0:nx])
                for k, layer in enumerate(a):
                    im = _number(layer.imag) if np.iscomplexobj(layer) else pa.nulls(ny * nx, pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([where] * (ny * nx)), pa.array(np.full(ny * nx, k, np.int32)), row, col, _number(layer.real), im], ["path", "band", "row", "col", "re", "im"])

    return data.mapInArrow(run, "path string, band int, row int, col int, re double, im double")


def point(stack: DataFrame, row: int, col: int) -> DataFrame:
    """All pairs at one pixel, in order."""
    return stack.where((F.col("row") == row) & (F.col("col") == col)).orderBy("pair")


def layer(stack: DataFrame, pair: str) -> DataFrame:
    """All arrays of one pair; of a store partitioned by pair only its files are read."""
    return stack.where(F.col("pair") == pair)


def window(stack: DataFrame, rows: tuple[int, int], cols: tuple[int, int], name: str = "wrapped") -> DataFrame:
    """One array over all pairs within rows and columns, the ends left out."""
    return stack.where(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1)).select("pair", "row", "col", name)


def from_first_date(series: DataFrame, scale: float = 1.0) -> DataFrame:
    """Displacements since the reference date: scaled, with an epoch of zeros before the first; ``series``: ref, date, row, col, value.

    The reference is the smallest; series of another reference are left out.
    """
    first = F.broadcast(series.agg(F.min("ref").alias("_first")))  # one row
    own = series.join(first, F.col("ref") == F.col("_first"))
    zero = own.select(F.col("ref").alias("date"), "row", "col").distinct().withColumn("displacement_m", F.lit(0.0))
    return zero.unionByName(own.select("date", "row", "col", (F.col("value") * scale).alias("displacement_m")))


def store_info(stack: DataFrame) -> DataFrame:
    """Pairs, pixels and rows of a store, and how many values are there."""
    return stack.agg(F.count_distinct("pair").alias("n_pairs"), F.count_distinct("row", "col").alias("n_pixels"), F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in stack.columns if c not in ("path", "pair", "row", "col")])

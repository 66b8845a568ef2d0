"""Folders on the driver: whole-file writes, caches by content key, tile exchange files."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE, KEY = ".complete", "key.json"


def write_whole(path: str | Path, text: str) -> Path:
    """A file that is seen with all of its text or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex[:8]}")
    try:
        part.write_text(text, encoding="utf-8")
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)
    return target


def write_manifest(folder: str | Path, entries: Mapping[str, Mapping], keep: Iterable[str] | None = None, name: str = "manifest.json") -> Path:
    """Entries by key, sorted; with ``keep``, files beside the manifest that it doesn't name go, hidden ones excepted."""
    target = write_whole(Path(folder) / name, json.dumps({"version": 1, "entries": dict(entries)}, ensure_ascii=False, indent=2, sort_keys=True))
    if keep is not None:
        named = {name, *keep}
        for f in target.parent.iterdir():
            if f.is_file() and f.name not in named and not f.name.startswith("."):
                f.unlink(missing_ok=True)
    return target


class Offline(RuntimeError):
    """A file that is not in the cache was asked for offline."""


@contextlib.contextmanager
def _alone(lock: Path, patience: float) -> Iterator[None]:
    """Held by whoever made the lock file first."""
    end = time.monotonic() + patience
    while True:
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
            break
        except FileExistsError:
            if time.monotonic() > end:
                raise TimeoutError(f"{lock} is held by another process") from None
            time.sleep(0.05)
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)


def fetched(root: str | Path, key: Mapping, fetch: Callable[[Path], None], space: str = "generic", offline: bool = False, patience: float = 3600.0) -> Path:
    """The cache's folder for a request; ``fetch`` fills a fresh one where there is none.

    A folder is moved to its place when it is whole, so others see it with all
    files or not at all; one process fetches, the rest wait for it.  A fetch
    that fails or brings nothing leaves nothing behind.
    """
    digest = hashlib.sha256(json.dumps(dict(key), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:32]
    entry = Path(root) / space / digest
    if (entry / DONE).exists():
        return entry
    if offline:
        raise Offline(f"{space}/{digest} is not in the cache")
    entry.parent.mkdir(parents=True, exist_ok=True)
    with _alone(entry.with_name(digest + ".lock"), patience):
        if (entry / DONE).exists():
            return entry
        fresh = entry.with_name(f"{digest}.{uuid.uuid4().hex[:8]}")
        fresh.mkdir()
        try:
            fetch(fresh)
            files = sorted(f for f in fresh.rglob("*") if f.is_file())
            if not files:
                raise FileNotFoundError(f"nothing was fetched for {space}/{digest}")
            about = {"key": dict(key), "files": [f.relative_to(fresh).as_posix() for f in files], "bytes": sum(f.stat().st_size for f in files)}
            (fresh / KEY).write_text(json.dumps(about, sort_keys=True, default=str), encoding="utf-8")
            (fresh / DONE).touch()
            shutil.rmtree(entry, ignore_errors=True)  # one without the mark is a rest
            fresh.rename(entry)
        finally:
            shutil.rmtree(fresh, ignore_errors=True)
    return entry


def _tiles(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    import numpy as np

    for batch in files:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                extents = z["extents"]
                for k, (y0, y1, x0, x1) in enumerate(extents):
                    v = z[f"tile_{k}"].astype(float)
                    if v.shape != (y1 - y0, x1 - x0):
                        raise ValueError(f"{path}: tile {k} is {v.shape}, its extent {y1 - y0} by {x1 - x0}")
                    y, x = np.mgrid[y0:y1, x0:x1]
                    yield pd.DataFrame({"path": path, "tile": k, "row": y.ravel(), "col": x.ravel(), "value": v.ravel()})


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, tile, row, col, value): tiles of array files that hold ``extents`` (y0, y1, x0, x1 a row) and ``tile_0``, ``tile_1``...; rows and columns are the raster's."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_tiles, "path string, tile long, row long, col long, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as a table in parts by tile, to be read back with ``spark.read.parquet``."""
    tiles.repartition("tile").write.mode("overwrite").partitionBy("tile").parquet(path)

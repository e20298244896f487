"""Image files: scan, decode, reject."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.errors import PathNotFound, UndecodableImage
from hashloom.functions.numbering import numbered
from hashloom.functions.paths import plain, user_of
from hashloom.runtime import hadoop_path
from hashloom.sources.vectors import GRID

#: Weights of red, green and blue in the gray value, in 1/65536 (fixed values: 0.299, 0.587, 0.114).
GRAY = (19595, 38470, 7471)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(image_id, path, user) of every file under root, or of root itself, numbered by path; no file is opened."""
    fs, path = hadoop_path(spark, root)
    if not fs.exists(path):
        raise PathNotFound(root)
    whole = fs.makeQualified(path).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain(F.col("path")).alias("path"))
    return numbered(files, ["path"], "image_id").select("image_id", "path", user_of(F.col("path"), whole).alias("user"))


def safe_name(name: str | None) -> str:
    """The last part of a name that may hold folders of any system; empty if there is none or it would name a folder."""
    base = re.split(r"[/\\]", name or "")[-1].strip()
    return "" if base in (".", "..") or "\0" in base else base


def rejects(images: DataFrame, path: str = "path") -> DataFrame:
    """The images that can't be read by their path alone: null, or naming a folder; with the error."""
    error = F.when(F.col(path).isNull(), "no path").when(F.trim(path) == "", "no path").when(F.col(path).endswith("/"), "no file name")
    return images.withColumn("error", error).where(F.col("error").isNotNull())


def decoded(spark: SparkSession, root: str, images: DataFrame) -> DataFrame:
    """Grids of the images under root that can be decoded; the others have no row."""
    source = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    pixels = source.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = []
            for h, w, n, data in zip(b["h"], b["w"], b["n"], b["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                if n == 1:
                    px.append(x[:, :, 0].ravel().astype(np.int32))
                else:  # stored blue, green, red
                    px.append(((x[:, :, 2] * GRAY[0] + x[:, :, 1] * GRAY[1] + x[:, :, 0] * GRAY[2] + 32768) >> 16).ravel().astype(np.int32))
            yield b.assign(px=px)[["image_id", "path", "user", "h", "w", "px"]]

    joined = images.withColumn("_p", plain(F.col("path"))).join(pixels.withColumn("_p", plain(F.col("path"))).drop("path"), "_p").drop("_p")
    return joined.select("image_id", "path", "user", "h", "w", "n", "data").mapInPandas(gray, GRID)


def undecodable(images: DataFrame, grids: DataFrame) -> DataFrame:
    """Images that were scanned but have no grid."""
    return images.join(grids.select("image_id"), "image_id", "left_anti")


def require_decodable(missing: DataFrame, path: str = "path") -> None:
    """Raises UndecodableImage for the first of them by path; for a caller who wants no file skipped."""
    row = missing.orderBy(path).first()
    if row is not None:
        raise UndecodableImage(row[path])

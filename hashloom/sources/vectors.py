"""Number vectors as square grayscale grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = "image_id bigint, path string, user string, h int, w int, px array<int>"


def vector_grids(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(image_id, path, user, h, w, px): each vector scaled from its least to its largest value to 0..255.

    Vectors whose length is no square, null ones, and ones that hold a null or NaN are left out; a
    constant vector is all 0.
    """
    side = F.sqrt(F.size(embedding)).cast("int")
    rows = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & (side * side == F.size(embedding)))
    rows = rows.where(~F.exists(embedding, lambda x: x.isNull() | F.isnan(x)))
    rows = rows.select(F.col(vec_id).cast("bigint").alias("image_id"), F.concat(F.lit("/img/user"), label, F.lit("/"), vec_id, F.lit(".png")).alias("path"), F.concat(F.lit("user"), label).alias("user"), side.alias("h"), side.alias("w"), F.col(embedding).cast("array<double>").alias("e"))
    low, high = F.array_min("e"), F.array_max("e")
    # a struct of array and ends keeps the ends from being computed anew for each value
    ends = F.transform(F.array(F.struct(F.col("e").alias("e"), low.alias("low"), high.alias("high"))), lambda s: F.transform(s["e"], lambda x: F.when(s["high"] > s["low"], F.floor((x - s["low"]) * 255.0 / (s["high"] - s["low"])).cast("int")).otherwise(0)))
    return rows.select("image_id", "path", "user", "h", "w", F.get(ends, F.lit(0)).alias("px"))

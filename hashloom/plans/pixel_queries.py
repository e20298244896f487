"""Queries over vectors as grids: modifications and hashes, with the same whole-number arithmetic in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom import registry
from hashloom.functions import grids
from hashloom.functions.bits import bit_text
from hashloom.operators.variants import hash_variants, hashed, modified
from hashloom.runtime import table
from hashloom.sources.vectors import vector_grids

N = 8
MODIFICATIONS = {"rot90": registry.rotation(90), "rot180": registry.rotation(180), "rot270": registry.rotation(270), "blur": registry.blurring(0.9)}
METHODS = {"average8": registry.average_hash(8), "average16": registry.average_hash(16), "vert_gradient8": registry.vert_gradient(8), "gradient8": registry.gradient(8)}


def image_grids(spark: SparkSession, d: str) -> DataFrame:
    return vector_grids(table(spark, d, "embeddings"))


def grid_dim(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as images: path, user, size and pixels."""
    return image_grids(spark, d).withColumn("px", F.array_join(F.col("px").cast("array<string>"), ","))


def _modified(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = modified(image_grids(spark, d), [(0, MODIFICATIONS[name])])
        return rows.select("image_id", F.array_join(F.col("px").cast("array<string>"), ",").alias("px"))

    return query


def modified_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Every image under every modification; the unmodified image isn't among them."""
    rows = modified(image_grids(spark, d), list(enumerate(MODIFICATIONS.values())))
    return rows.select("image_id", "modification_id", F.array_join(F.col("px").cast("array<string>"), ",").alias("px"))


def _hashed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = hashed(image_grids(spark, d).withColumn("modification_id", F.lit(0)), [(0, METHODS[name])])
        return rows.select("image_id", bit_text(F.col("words"), F.col("nbits")).alias("bits"))

    return query


#: The larger of the default sizes, by both default kinds.
LARGE = (64, 256)


def hash_large(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the larger default sizes, as their number of ones and the sum of the ones' places (thousands of bits make a long text)."""
    methods = [(registry.average_hash(s), registry.vert_gradient(s)) for s in LARGE]
    named = {i: m for i, m in enumerate(m for pair in methods for m in pair)}
    rows = hashed(image_grids(spark, d).withColumn("modification_id", F.lit(0)), list(named.items()))
    name = F.element_at(F.array(*(F.lit(m.name) for m in named.values())), F.col("hashing_method_id") + 1)
    word = lambda at: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.get(F.col("words"), at).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), 63 - b)) != 0)
    place = F.aggregate(F.sequence(F.lit(0), F.size("words") - 1), F.lit(0).cast("bigint"), lambda s, at: s + F.aggregate(word(at), F.lit(0).cast("bigint"), lambda x, b: x + at * 64 + b))
    ones = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s + F.bit_count(w))
    return rows.select("image_id", name.alias("method"), "nbits", ones.alias("ones"), place.alias("places"))


def fanout(spark: SparkSession, d: str) -> DataFrame:
    return hash_variants(image_grids(spark, d), list(enumerate(MODIFICATIONS.values())), list(enumerate(METHODS.values())))


def hash_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Every image under every modification by every method."""
    return fanout(spark, d).select("image_id", "modification_id", "hashing_method_id", bit_text(F.col("words"), F.col("nbits")).alias("bits"))


GRID_SQL = """SELECT vec_id AS image_id, '/img/user' || label || '/' || vec_id || '.png' AS path, 'user' || label AS "user", 8 AS h, 8 AS w,
 list_transform(e, lambda x: CASE WHEN list_max(e) = list_min(e) THEN 0 ELSE floor((x - list_min(e)) * 255.0::DOUBLE / (list_max(e) - list_min(e)))::INTEGER END) AS px, label
 FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)"""


def _list(table: np.ndarray) -> str:
    return "[" + ", ".join(map(str, table.ravel())) + "]"


def _pass(px: str, h: int, w: int, rows: np.ndarray, columns: np.ndarray) -> str:
    """SQL of a vertical and a horizontal pass."""
    o, p = len(rows), len(columns)
    down = f"list_transform(range({o * w}), lambda i: ((32768 + list_sum(list_transform(range({h}), lambda k: {_list(rows)}[((i // {w}) * {h} + k + 1)::INT]::BIGINT * {px}[(k * {w} + i % {w} + 1)::INT]))::BIGINT) >> 16)::INT)"
    return down, f"list_transform(range({o * p}), lambda i: ((32768 + list_sum(list_transform(range({w}), lambda k: {_list(columns)}[((i % {p}) * {w} + k + 1)::INT]::BIGINT * m[((i // {p}) * {w} + k + 1)::INT]))::BIGINT) >> 16)::INT)"


def _resampled(source: str, rows: np.ndarray, columns: np.ndarray, keep: str = "image_id") -> str:
    down, across = _pass("px", N, N, rows, columns)
    return f"SELECT {keep}, {across} AS px FROM (SELECT {keep}, {down} AS m FROM ({source}))"


def modified_sql(name: str, source: str = GRID_SQL, keep: str = "image_id") -> str:
    index = {"rot90": "px[((7 - i % 8) * 8 + i // 8 + 1)::INT]", "rot180": "px[(64 - i)::INT]", "rot270": "px[((i % 8) * 8 + 7 - i // 8 + 1)::INT]"}
    if name in index:
        return f"SELECT {keep}, list_transform(range(64), lambda i: {index[name]}) AS px FROM ({source})"
    blur = grids.blur_table(N, 0.9)
    return _resampled(source, blur, blur, keep)


def bits_sql(name: str, source: str = GRID_SQL, keep: str = "image_id") -> str:
    """SQL of the bit text of each grid."""
    up = lambda to: grids.resize_table(N, to)
    if name.startswith("average"):
        size = int(name[7:])
        source = source if size == N else _resampled(source, up(size), up(size), keep)
        return f"SELECT {keep}, array_to_string(list_transform(px, lambda p: (p * {size * size} >= list_sum(px))::INT), '') AS bits FROM ({source})"
    if name == "vert_gradient8":
        source = _resampled(source, up(9), up(8), keep)
        return f"SELECT {keep}, array_to_string(list_transform(range(64), lambda i: (px[(i + 1)::INT] < px[(i + 9)::INT])::INT), '') AS bits FROM ({source})"
    source = _resampled(source, up(8), up(9), keep)
    return f"SELECT {keep}, array_to_string(list_transform(range(64), lambda i: (px[((i // 8) * 9 + i % 8 + 1)::INT] < px[((i // 8) * 9 + i % 8 + 2)::INT])::INT), '') AS bits FROM ({source})"


def _px(sql: str, keep: str) -> str:
    return f"SELECT {keep}, array_to_string(px, ',') AS px FROM ({sql})"


def _weights(table: np.ndarray) -> str:
    """The table's weights that aren't zero, as rows (o, k, w)."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({o}, {k}, {table[o, k]})" for o, k in zip(*np.nonzero(table), strict=True)) + ") AS t(o, k, w)"


def _large_sql(name: str, size: int) -> str:
    """Resampling and comparison of one large hash by joins: a row a pixel instead of a list a picture."""
    rows = size + (name == "vert_gradient")
    down, across = _weights(grids.resize_table(N, rows)), _weights(grids.resize_table(N, size))
    pixels = "SELECT image_id, i // 8 AS r, i % 8 AS c, px[(i + 1)::INT]::BIGINT AS v FROM g, range(64) AS t(i)"
    first = f"SELECT image_id, d.o AS r, c, (32768 + sum(v * w)::BIGINT) >> 16 AS v FROM ({pixels}) p JOIN ({down}) d ON d.k = p.r GROUP BY ALL"
    both = f"SELECT image_id, r, a.o AS c, (32768 + sum(v * w)::BIGINT) >> 16 AS v FROM ({first}) f JOIN ({across}) a ON a.k = f.c GROUP BY image_id, r, a.o"
    if name == "average_hash":
        bits = f"SELECT image_id, r * {size} + c AS i, v * {size * size} >= sum(v) OVER (PARTITION BY image_id) AS b FROM ({both})"
    else:
        bits = f"SELECT * FROM (SELECT image_id, r * {size} + c AS i, v < lead(v) OVER (PARTITION BY image_id, c ORDER BY r) AS b, r FROM ({both})) WHERE r < {size}"
    return f"SELECT image_id, '{name}{size}' AS method, {size * size} AS nbits, count(*) FILTER (WHERE b) AS ones, coalesce(sum(i) FILTER (WHERE b), 0)::BIGINT AS places FROM ({bits}) GROUP BY image_id"


_ALL = " UNION ALL ".join(f"SELECT image_id, {i} AS modification_id, px FROM ({modified_sql(n)})" for i, n in enumerate(MODIFICATIONS))

QUERIES = {
    "grid_dim": grid_dim,
    **{f"mod_{n}": _modified(n) for n in MODIFICATIONS},
    "modified_fanout": modified_fanout,
    **{f"hash_{n}": _hashed(n) for n in METHODS},
    "hash_large": hash_large,
    "hash_fanout": hash_fanout,
}
SQL = {
    "grid_dim": f'SELECT image_id, path, "user", h, w, array_to_string(px, \',\') AS px FROM ({GRID_SQL})',
    **{f"mod_{n}": _px(modified_sql(n), "image_id") for n in MODIFICATIONS},
    "modified_fanout": _px(_ALL, "image_id, modification_id"),
    **{f"hash_{n}": bits_sql(n) for n in METHODS},
    "hash_fanout": " UNION ALL ".join(f"SELECT image_id, modification_id, {i} AS hashing_method_id, bits FROM ({bits_sql(n, 'SELECT * FROM v', 'image_id, modification_id')})" for i, n in enumerate(METHODS)),
}
SQL["hash_fanout"] = f"WITH v AS MATERIALIZED ({_ALL}) {SQL['hash_fanout']}"
SQL["hash_large"] = f"WITH g AS MATERIALIZED ({GRID_SQL}) " + " UNION ALL ".join(_large_sql(n, s) for s in LARGE for n in ("average_hash", "vert_gradient"))

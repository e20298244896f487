"""Queries over the image store: scan, registries, inserts, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom import registry
from hashloom.functions.bits import bit_text, bytes_of, hex_text, words_of
from hashloom.functions.numbering import numbered
from hashloom.functions.paths import file_name, user_of
from hashloom.operators import upserts, views
from hashloom.operators.roc import thresholds as threshold_grid
from hashloom.runtime import table
from hashloom.sources.images import rejects

#: What was loaded before this counts as stored, the rest as new.
CUT = "2024-06-01"
PICKED = [3, 1, 1, 99]


def runs_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").select("id", "timestamp", F.to_date(F.timestamp_millis("timestamp")).alias("day"))


def runs_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").where("timestamp is not null").select("id", F.to_json(F.struct("id", "timestamp")).alias("body"))


def image_dim(spark: SparkSession, d: str) -> DataFrame:
    """Images numbered from 0 in the order of their path, equal paths by id."""
    return numbered(table(spark, d, "images").select("id", "path", "user"), ["path", "id"], "image_no")


def user_from_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "images").select("id", user_of(F.col("path")).alias("path_user"), file_name(F.col("path")).alias("file"))


def scan_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rejects(table(spark, d, "images").select("id", "path"))


def registry_select(spark: SparkSession, d: str) -> DataFrame:
    return registry.registry_frame(spark, registry.default_methods(), PICKED).select("id", "name")


def registry_renumber(spark: SparkSession, d: str) -> DataFrame:
    return registry.registry_frame(spark, registry.example_modifications(), PICKED)


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Names of methods written again in capitals: those stored keep their name."""
    names = table(spark, d, "hashing_methods").select("id", "name")
    return upserts.insert_ignore(names.where("id < 3"), names.withColumn("name", F.upper("name")), ["id"])


def insert_ignore_images(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "images")
    new = rows.select("id", "path", user_of(F.col("path")).alias("user"))
    return upserts.insert_ignore(rows.where(F.col("loaded_at") < CUT).select("id", "path", "user"), new, ["id"])


def insert_ignore_hashes(spark: SparkSession, d: str) -> DataFrame:
    """First writer wins on (mod_image_id, hashing_method_id)."""
    rows = table(spark, d, "hashes").where("mod_image_id is not null")
    key = ["mod_image_id", "hashing_method_id"]
    old = rows.where(F.col("loaded_at") < CUT).select(*key, "id")
    return upserts.insert_ignore(old, rows.select(*key, (-F.col("id")).alias("id")), key)


def upsert_returning(spark: SparkSession, d: str) -> DataFrame:
    """Every (image, modification) with its id: the stored one, or the next."""
    rows = table(spark, d, "modified_images").where("image_id is not null and modification_id is not null")
    key = ["image_id", "modification_id"]
    old = rows.where(F.col("loaded_at") < CUT).select("id", *key)
    return upserts.upsert_returning(old, rows, key)[1]


def run_append(spark: SparkSession, d: str) -> DataFrame:
    """A new run for each day on which images came in."""
    days = table(spark, d, "images").select(F.to_date("loaded_at").alias("day")).distinct()
    new = days.select((F.unix_date("day").cast("bigint") * 86400000).alias("timestamp"))
    return upserts.append(table(spark, d, "runs"), new, ["timestamp"])


def program_replace(spark: SparkSession, d: str) -> DataFrame:
    """The pointer to the active run: the last by (timestamp, id)."""
    runs = table(spark, d, "runs").where("timestamp is not null").orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(1)
    return upserts.replace_single(runs.select(F.lit(0).alias("id"), F.col("id").alias("run_id")))


def run_images_append(spark: SparkSession, d: str) -> DataFrame:
    """All images listed under the next run."""
    new = table(spark, d, "images").select(F.lit(upserts.next_id(table(spark, d, "runs"))).cast("bigint").alias("run_id"), F.col("id").alias("image_id"))
    return upserts.append(table(spark, d, "run_images").select("id", "run_id", "image_id"), new, ["image_id"])


def active_run_modified_images(spark: SparkSession, d: str) -> DataFrame:
    return views.active_run_modified_images(program_replace(spark, d), *(table(spark, d, t) for t in ("run_images", "images", "modified_images")))


def active_run_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = views.active_run_hashes(program_replace(spark, d), *(table(spark, d, t) for t in ("run_images", "images", "modified_images", "hashes")))
    return rows.withColumn("hash", hex_text(F.col("hash")))


def fetch_method_hashes(spark: SparkSession, d: str) -> DataFrame:
    """What matching reads for one method: ids and hashes of the active run."""
    return active_run_hashes(spark, d).where("hashing_method_id = 1").select("hash_id", "hash")


def images_results_join(spark: SparkSession, d: str) -> DataFrame:
    """Images with their number of hashes; an image without any has no row."""
    variants = table(spark, d, "modified_images").select(F.col("id").alias("mod_image_id"), "image_id")
    counts = table(spark, d, "hashes").select("mod_image_id").join(variants, "mod_image_id").groupBy("image_id").agg(F.count(F.lit(1)).alias("hashes"))
    return table(spark, d, "images").select(F.col("id").alias("image_id"), "path").join(counts, "image_id")


def match_append(spark: SparkSession, d: str) -> DataFrame:
    """Later matches written after the stored ones, numbered on."""
    cols = ["hamming_distance", "hash_len", "hash1_id", "hash2_id"]
    rows = table(spark, d, "matches")
    new = rows.where(F.col("loaded_at") >= CUT).select(*cols, F.col("id").alias("_old")).withColumnRenamed("_old", "source_id")
    old = rows.where(F.col("loaded_at") < CUT).select("id", *cols).withColumn("source_id", F.lit(None).cast("bigint"))
    return upserts.append(old, new, ["source_id"])


def upload_insert(spark: SparkSession, d: str) -> DataFrame:
    """Uploads (here: events with a user) become images after the stored ones."""
    new = table(spark, d, "events").where("user_id is not null").select(F.concat(F.lit("/uploads/"), "user_id", F.lit("/"), "event_id", F.lit(".png")).alias("path"), F.concat(F.lit("user"), "user_id").alias("user"), "event_id")
    ids = numbered(new, ["event_id"], "id", upserts.next_id(table(spark, d, "images")))
    return ids.select("id", "path", "user")


def hash_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hashes").select("id", hex_text(F.col("hash")).alias("hex"))


def hash_render(spark: SparkSession, d: str) -> DataFrame:
    """Each hash as text of its bits, as it is kept by the text form of the store."""
    return table(spark, d, "hashes").select("id", bit_text(F.col("words"), F.col("nbits")).alias("bits"))


def hash_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes to words and words to bytes."""
    rows = table(spark, d, "hashes")
    return rows.select("id", F.array_join(words_of(F.col("hash")).cast("array<string>"), ",").alias("words"), hex_text(bytes_of(F.col("words"), F.col("nbits"))).alias("hex"))


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return threshold_grid(spark)


_ACTIVE = "SELECT 0 AS id, id AS run_id FROM runs WHERE timestamp IS NOT NULL ORDER BY timestamp DESC, id DESC LIMIT 1"
_VARIANTS = f"SELECT mi.id AS modified_image_id, mi.image_id, mi.modification_id FROM modified_images mi JOIN images i ON i.id = mi.image_id JOIN run_images ri ON ri.image_id = i.id JOIN ({_ACTIVE}) p ON p.run_id = ri.run_id"
_USER = "CASE WHEN path IS NULL THEN NULL ELSE coalesce(CASE WHEN len(string_split(path, '/')) > 1 THEN nullif(string_split(path, '/')[-2], '') END, 'undefined') END"
_HASHES = f"SELECT h.id AS hash_id, lower(hex(h.hash)) AS hash, h.hashing_method_id, v.modified_image_id, v.image_id, v.modification_id FROM hashes h JOIN ({_VARIANTS}) v ON v.modified_image_id = h.mod_image_id"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS t({names})"


QUERIES = {
    f.__name__: f
    for f in (
        runs_list, runs_json, image_dim, user_from_path, scan_rejects, registry_select, registry_renumber, insert_ignore, insert_ignore_images, insert_ignore_hashes, upsert_returning, run_append, program_replace,
        run_images_append, active_run_modified_images, active_run_hashes, fetch_method_hashes, images_results_join, match_append, upload_insert, hash_hex, hash_render, hash_bytes, thresholds,
    )
}

SQL = {
    "runs_list": "SELECT id, timestamp, CAST(epoch_ms(timestamp) AS DATE) AS day FROM runs",
    "runs_json": """SELECT id, '{"id":' || id || ',"timestamp":' || timestamp || '}' AS body FROM runs WHERE timestamp IS NOT NULL""",
    "image_dim": "SELECT id, path, \"user\", row_number() OVER (ORDER BY path NULLS FIRST, id) - 1 AS image_no FROM images",
    "user_from_path": f"SELECT id, {_USER} AS path_user, string_split(path, '/')[-1] AS file FROM images",
    "scan_rejects": "SELECT id, path, CASE WHEN path IS NULL OR trim(path) = '' THEN 'no path' ELSE 'no file name' END AS error FROM images WHERE path IS NULL OR trim(path) = '' OR path LIKE '%/'",
    "registry_select": _values([(1, "average_hash16"), (3, "average_hash256")], "id, name"),
    "registry_renumber": _values([(0, 1, "rotate90"), (1, 3, "blur0.5")], "local_id, id, name"),
    "insert_ignore": "SELECT id, CASE WHEN id < 3 THEN name ELSE upper(name) END AS name FROM hashing_methods",
    "insert_ignore_images": f"SELECT id, path, CASE WHEN loaded_at < TIMESTAMP '{CUT}' THEN \"user\" ELSE {_USER} END AS \"user\" FROM images",
    "insert_ignore_hashes": f"SELECT mod_image_id, hashing_method_id, CASE WHEN loaded_at < TIMESTAMP '{CUT}' THEN id ELSE -id END AS id FROM hashes WHERE mod_image_id IS NOT NULL",
    "upsert_returning": f"""
WITH r AS (SELECT * FROM modified_images WHERE image_id IS NOT NULL AND modification_id IS NOT NULL), o AS (SELECT * FROM r WHERE loaded_at < TIMESTAMP '{CUT}')
SELECT id, image_id, modification_id FROM o UNION ALL
SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY image_id, modification_id) AS id, image_id, modification_id FROM r WHERE loaded_at >= TIMESTAMP '{CUT}'""",
    "run_append": "SELECT id, timestamp FROM runs UNION ALL SELECT (SELECT max(id) FROM runs) + row_number() OVER (ORDER BY day) AS id, epoch_ms(day) AS timestamp FROM (SELECT DISTINCT date_trunc('day', loaded_at)::TIMESTAMP AS day FROM images)",
    "program_replace": _ACTIVE,
    "run_images_append": "SELECT id, run_id, image_id FROM run_images UNION ALL SELECT (SELECT max(id) FROM run_images) + row_number() OVER (ORDER BY id), (SELECT max(id) + 1 FROM runs), id FROM images",
    "active_run_modified_images": _VARIANTS,
    "active_run_hashes": _HASHES,
    "fetch_method_hashes": f"SELECT hash_id, hash FROM ({_HASHES}) WHERE hashing_method_id = 1",
    "images_results_join": "SELECT i.id AS image_id, i.path, count(*) AS hashes FROM images i JOIN modified_images mi ON mi.image_id = i.id JOIN hashes h ON h.mod_image_id = mi.id GROUP BY i.id, i.path",
    "match_append": f"""
SELECT id, hamming_distance, hash_len, hash1_id, hash2_id, CAST(NULL AS BIGINT) AS source_id FROM matches WHERE loaded_at < TIMESTAMP '{CUT}' UNION ALL
SELECT coalesce((SELECT max(id) FROM matches WHERE loaded_at < TIMESTAMP '{CUT}'), 0) + row_number() OVER (ORDER BY id), hamming_distance, hash_len, hash1_id, hash2_id, id FROM matches WHERE loaded_at >= TIMESTAMP '{CUT}'""",
    "upload_insert": "SELECT (SELECT max(id) FROM images) + row_number() OVER (ORDER BY event_id) AS id, '/uploads/' || user_id || '/' || event_id || '.png' AS path, 'user' || user_id AS \"user\" FROM events WHERE user_id IS NOT NULL",
    "hash_hex": "SELECT id, lower(hex(hash)) AS hex FROM hashes",
    "hash_render": "SELECT id, CASE WHEN words IS NULL THEN NULL ELSE left(array_to_string(list_transform(words, lambda w: lpad(bin(w), 64, '0')), ''), nbits) END AS bits FROM hashes",
    "hash_bytes": "SELECT id, array_to_string(words, ',') AS words, lower(hex(hash)) AS hex FROM hashes",
    "thresholds": "SELECT i::INTEGER AS threshold_idx, (i::DOUBLE / 100)::FLOAT AS threshold FROM range(1, 100) AS t(i)",
}

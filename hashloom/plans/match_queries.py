"""Queries over pairs: distances, star joins, confusion matrices, ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom import registry
from hashloom.functions.bits import differing_bits, relative
from hashloom.functions.skew import heavy_keys, salted_join
from hashloom.operators import matching, roc, views
from hashloom.operators.variants import hashed
from hashloom.plans.pixel_queries import bits_sql, image_grids
from hashloom.runtime import table
from hashloom.streaming.incoming import near_stored

THRESHOLD = 40


def hamming(spark: SparkSession, d: str) -> DataFrame:
    """Each match with the distance of its two hashes, null where they can't be compared."""
    matches = table(spark, d, "matches").select("id", "hash1_id", "hash2_id", "hamming_distance")
    words = table(spark, d, "hashes").select("id", "words")
    one = salted_join(matches, words.select(F.col("id").alias("hash1_id"), F.col("words").alias("words1")), "hash1_id", heavy_keys(matches, "hash1_id"))
    two = salted_join(one, words.select(F.col("id").alias("hash2_id"), F.col("words").alias("words2")), "hash2_id", heavy_keys(matches, "hash2_id"))
    return two.select("id", "hamming_distance", differing_bits(F.col("words1"), F.col("words2")).alias("distance"))


def hamming_relative(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matches").select("id", relative(F.col("hamming_distance"), F.col("hash_len")).alias("relative"))


def pair_length_guard(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each method that matching leaves out, since the lengths differ."""
    return matching.unequal_lengths(table(spark, d, "hashes"))


def method_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return matching.method_counts(table(spark, d, "hashes"))


def _with_image(spark: SparkSession, d: str) -> DataFrame:
    variants = table(spark, d, "modified_images").select(F.col("id").alias("mod_image_id"), "image_id")
    return table(spark, d, "hashes").select("id", "hashing_method_id", "nbits", "words", "mod_image_id").join(variants, "mod_image_id", "left")


def pair_histogram(spark: SparkSession, d: str) -> DataFrame:
    """All unique pairs of all hashes, counted by method, length, distance, and whether the image is the same."""
    return matching.pair_histogram(_with_image(spark, d), "image_id")


def roc_hashes(spark: SparkSession, d: str) -> DataFrame:
    """ROC of each method over all unique pairs of its hashes."""
    counts = pair_histogram(spark, d).select("hashing_method_id", "hamming_distance", F.col("nbits").alias("hash_len"), "same", F.col("pairs").alias("n"))
    return roc.rates(roc.confusion(counts, ["hashing_method_id"], roc.thresholds(spark)))


def _grid_hashes(spark: SparkSession, d: str) -> DataFrame:
    grids = image_grids(spark, d).withColumn("modification_id", F.lit(0))
    return hashed(grids, [(0, registry.average_hash(8))]).withColumnRenamed("image_id", "id")


def pair_unique(spark: SparkSession, d: str) -> DataFrame:
    """Every hash over all its unique pairs: partners, sum of distances, the nearest, and links (8 bits or fewer)."""
    return matching.partner_summary(_grid_hashes(spark, d), 8)


def unique_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The match stage: every unique pair of the vectors' hashes with its distance."""
    return matching.unique_pairs(_grid_hashes(spark, d))


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The match stage as a large store runs it: only pairs below a relative distance of 0.3 leave their tile."""
    return matching.unique_pairs(_grid_hashes(spark, d), within=0.3)


def roc_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: vectors as grids, average hash, all unique pairs, 99 thresholds; truth is an equal label."""
    rows = _grid_hashes(spark, d).withColumn("truth", F.substring("user", 5, 20).cast("bigint"))
    counts = matching.pair_histogram(rows, "truth").select("hamming_distance", F.col("nbits").alias("hash_len"), "same", F.col("pairs").alias("n"))
    return roc.rates(roc.confusion(counts, [], roc.thresholds(spark)))


def match_star(spark: SparkSession, d: str) -> DataFrame:
    described = views.described_hashes(*(table(spark, d, t) for t in ("hashes", "hashing_methods", "modified_images", "modifications")))
    return views.match_star(table(spark, d, "matches").select("id", "hamming_distance", "hash_len", "hash1_id", "hash2_id"), described)


def match_star_join(spark: SparkSession, d: str) -> DataFrame:
    return match_star(spark, d).select("id", "method_1", "method_2", "modification_1", "modification_2", "image_id_1", "image_id_2")


def match_count(spark: SparkSession, d: str) -> DataFrame:
    """Matches for each modification and method name, the same on both sides."""
    rows = views.paired(match_star(spark, d), "same_modification")
    return rows.groupBy(F.col("modification_1").alias("modification"), F.col("method_1").alias("method")).agg(F.count(F.lit(1)).alias("matches"))


def same_image(spark: SparkSession, d: str) -> DataFrame:
    return match_star(spark, d).select("id", (F.col("image_id_1") == F.col("image_id_2")).alias("same_image"))


def same_user(spark: SparkSession, d: str) -> DataFrame:
    """Whether both images are one user's (an extension: another kind of truth)."""
    star, users = match_star(spark, d).select("id", "image_id_1", "image_id_2"), table(spark, d, "images").select("id", "user")
    for side in ("1", "2"):
        star = salted_join(star, users.select(F.col("id").alias(f"image_id_{side}"), F.col("user").alias(f"user_{side}")), f"image_id_{side}", heavy_keys(star, f"image_id_{side}"))
    return star.select("id", (F.col("user_1") == F.col("user_2")).alias("same_user"))


def _same() -> Column:
    return F.col("image_id_1") == F.col("image_id_2")


def classify(spark: SparkSession, d: str) -> DataFrame:
    """Matches of one method, judged at one threshold."""
    rows = views.paired(match_star(spark, d))
    limit = (F.lit(THRESHOLD) / 100).cast("float")
    return rows.select("id", roc.classification(limit, relative(F.col("hamming_distance"), F.col("hash_len")), _same()).alias("class"))


def _counts(spark: SparkSession, d: str, pairing: str = "all") -> DataFrame:
    rows = views.paired(match_star(spark, d), pairing).withColumn("method", F.col("method_1"))
    if pairing == "same_modification":
        return roc.counted(rows.withColumn("modification", F.col("modification_1")), ["modification", "method"], _same())
    return roc.counted(rows, ["method"], _same())


def confusion_by_group(spark: SparkSession, d: str) -> DataFrame:
    return roc.confusion(_counts(spark, d), ["method"], roc.thresholds(spark))


def roc_merged(spark: SparkSession, d: str) -> DataFrame:
    return roc.rates(roc.merged(confusion_by_group(spark, d)))


def confusion_by_modification(spark: SparkSession, d: str) -> DataFrame:
    """A matrix for each modification, method and threshold, of the pairs under the same modification name."""
    return roc.confusion(_counts(spark, d, "same_modification"), ["modification", "method"], roc.thresholds(spark))


def roc_same_modification(spark: SparkSession, d: str) -> DataFrame:
    """Only pairs under the same modification name, as the literal reading has it."""
    return roc.rates(roc.merged(confusion_by_modification(spark, d)))


def roc_histogram(spark: SparkSession, d: str) -> DataFrame:
    return roc.rate_histogram(roc_merged(spark, d))


def incoming_near(spark: SparkSession, d: str) -> DataFrame:
    """The probes as incoming hashes: the stored ones at most 10 bits away (the stream's batch step)."""
    probes = table(spark, d, "probe_hashes").select(F.col("hash_id").alias("id")).distinct()
    rows = table(spark, d, "hashes").select("id", "hashing_method_id", "nbits", "words")
    return near_stored(rows.join(probes, "id", "left_semi"), rows, 10)


_DESCRIBED = "SELECT h.id AS hash_id, hm.name AS method, mi.image_id, mo.name AS modification FROM hashes h JOIN hashing_methods hm ON hm.id = h.hashing_method_id JOIN modified_images mi ON mi.id = h.mod_image_id JOIN modifications mo ON mo.id = mi.modification_id"
_STAR = f"""SELECT m.id, m.hamming_distance, m.hash_len, a.method AS method_1, b.method AS method_2, a.modification AS modification_1, b.modification AS modification_2, a.image_id AS image_id_1, b.image_id AS image_id_2
 FROM matches m JOIN ({_DESCRIBED}) a ON a.hash_id = m.hash1_id JOIN ({_DESCRIBED}) b ON b.hash_id = m.hash2_id"""
_REL = "(CASE WHEN hash_len <> 0 THEN (hamming_distance::DOUBLE / hash_len)::FLOAT END)"
_GRID = "SELECT i::INTEGER AS threshold_idx, (i::DOUBLE / 100)::FLOAT AS threshold FROM range(1, 100) AS t(i)"
_CELLS = ", ".join(f"coalesce(sum(n) FILTER (WHERE {rule}), 0)::BIGINT AS {name}" for name, rule in (("tp", "same AND entry < threshold"), ("fn", "same AND NOT entry < threshold"), ("fp", "NOT same AND entry < threshold"), ("tn", "NOT same AND NOT entry < threshold")))
_RATES = "CASE WHEN fp + tn > 0 THEN (fp::DOUBLE / (fp + tn))::FLOAT END AS fp_rate, CASE WHEN tp + fn > 0 THEN (tp::DOUBLE / (tp + fn))::FLOAT END AS tp_rate"


def _confusion_sql(where: str, group: str = "method_1 AS method", names: str = "method") -> str:
    counts = f"SELECT {group}, {_REL} AS entry, image_id_1 = image_id_2 AS same, count(*) AS n FROM ({_STAR}) WHERE {where} AND {_REL} IS NOT NULL AND image_id_1 = image_id_2 IS NOT NULL GROUP BY ALL"
    return f"SELECT {names}, threshold_idx, threshold, {_CELLS} FROM ({counts}), ({_GRID}) GROUP BY {names}, threshold_idx, threshold"


def _merged_sql(where: str) -> str:
    cells = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("tp", "fn", "fp", "tn"))
    return f"SELECT *, {_RATES} FROM (SELECT threshold_idx, threshold, {cells} FROM ({_confusion_sql(where)}) GROUP BY threshold_idx, threshold)"


_PAIRS = """SELECT a.hashing_method_id, a.nbits, list_sum(list_transform(list_zip(a.words, b.words), lambda z: bit_count(xor(z[1], z[2]))::INTEGER))::INTEGER AS hamming_distance, coalesce(a.image_id = b.image_id, false) AS same
 FROM (SELECT h.*, mi.image_id FROM hashes h LEFT JOIN modified_images mi ON mi.id = h.mod_image_id WHERE words IS NOT NULL) a
 JOIN (SELECT h.*, mi.image_id FROM hashes h LEFT JOIN modified_images mi ON mi.id = h.mod_image_id WHERE words IS NOT NULL) b ON a.hashing_method_id = b.hashing_method_id AND a.nbits = b.nbits AND a.id < b.id"""
_HISTOGRAM = f"SELECT hashing_method_id, nbits, hamming_distance, same, count(*) AS pairs FROM ({_PAIRS}) GROUP BY ALL"
_EMB = f"SELECT image_id, label, list_transform(range(1, 65), lambda i: (bits[i::INT])::INT) AS b FROM ({bits_sql('average8', keep='image_id, label')})"
_EMB_PAIRS = "SELECT x.image_id AS i, y.image_id AS j, list_sum(list_transform(list_zip(x.b, y.b), lambda z: abs(z[1] - z[2])))::INTEGER AS d, x.label = y.label AS same FROM e x JOIN e y ON x.image_id < y.image_id"

QUERIES = {
    f.__name__: f
    for f in (
        hamming, hamming_relative, pair_length_guard, method_cardinality, pair_histogram, roc_hashes, pair_unique, unique_pairs, near_pairs, roc_rates, match_star_join, match_count, same_image, same_user, classify, confusion_by_group, confusion_by_modification, roc_merged, roc_same_modification, roc_histogram,
        incoming_near,
    )
}
SQL = {
    "hamming": """SELECT m.id, m.hamming_distance, CASE WHEN len(a.words) = len(b.words) THEN list_sum(list_transform(list_zip(a.words, b.words), lambda z: bit_count(xor(z[1], z[2]))::INTEGER))::INTEGER END AS distance
 FROM matches m JOIN hashes a ON a.id = m.hash1_id JOIN hashes b ON b.id = m.hash2_id""",
    "hamming_relative": f"SELECT id, {_REL} AS relative FROM matches",
    "pair_length_guard": "WITH p AS (SELECT hashing_method_id, nbits, count(*) AS n FROM hashes WHERE words IS NOT NULL GROUP BY ALL) SELECT hashing_method_id, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS pairs FROM p GROUP BY hashing_method_id",
    "method_cardinality": "SELECT hashing_method_id, count(words) AS n, CASE WHEN count(words) > 1 THEN 'ready' ELSE 'not_enough' END AS status FROM hashes GROUP BY hashing_method_id",
    "pair_histogram": _HISTOGRAM,
    "roc_hashes": f"SELECT *, {_RATES} FROM (SELECT hashing_method_id, threshold_idx, threshold, {_CELLS} FROM (SELECT hashing_method_id, (hamming_distance::DOUBLE / nbits)::FLOAT AS entry, same, sum(pairs) AS n FROM ({_HISTOGRAM}) GROUP BY ALL), ({_GRID}) GROUP BY hashing_method_id, threshold_idx, threshold)",
    "pair_unique": f"""WITH e AS MATERIALIZED ({_EMB}), p AS ({_EMB_PAIRS}), s AS (SELECT i AS id, d FROM p UNION ALL SELECT j, d FROM p)
SELECT id, count(*) AS partners, sum(d)::BIGINT AS sum_distance, min(d) AS nearest, count(*) FILTER (WHERE d <= 8) AS links FROM s GROUP BY id""",
    "unique_pairs": f"WITH e AS MATERIALIZED ({_EMB}) SELECT i AS hash1_id, j AS hash2_id, d AS hamming_distance, 64 AS hash_len, 0 AS hashing_method_id FROM ({_EMB_PAIRS})",
    "near_pairs": f"WITH e AS MATERIALIZED ({_EMB}) SELECT i AS hash1_id, j AS hash2_id, d AS hamming_distance, 64 AS hash_len, 0 AS hashing_method_id FROM ({_EMB_PAIRS}) WHERE d < 0.3 * 64",
    "roc_rates": f"WITH e AS MATERIALIZED ({_EMB}), c AS (SELECT (d::DOUBLE / 64)::FLOAT AS entry, same, count(*) AS n FROM ({_EMB_PAIRS}) GROUP BY ALL) SELECT *, {_RATES} FROM (SELECT threshold_idx, threshold, {_CELLS} FROM c, ({_GRID}) GROUP BY threshold_idx, threshold)",
    "match_star_join": f"SELECT id, method_1, method_2, modification_1, modification_2, image_id_1, image_id_2 FROM ({_STAR})",
    "match_count": f"SELECT modification_1 AS modification, method_1 AS method, count(*) AS matches FROM ({_STAR}) WHERE method_1 = method_2 AND modification_1 = modification_2 GROUP BY ALL",
    "same_image": f"SELECT id, image_id_1 = image_id_2 AS same_image FROM ({_STAR})",
    "same_user": f"SELECT s.id, u.\"user\" = v.\"user\" AS same_user FROM ({_STAR}) s JOIN images u ON u.id = s.image_id_1 JOIN images v ON v.id = s.image_id_2",
    "classify": f"""SELECT id, CASE WHEN {_REL} IS NULL OR image_id_1 = image_id_2 IS NULL THEN NULL WHEN image_id_1 = image_id_2 THEN CASE WHEN {_REL} < 0.4::FLOAT THEN 'TP' ELSE 'FN' END
 WHEN {_REL} < 0.4::FLOAT THEN 'FP' ELSE 'TN' END AS class FROM ({_STAR}) WHERE method_1 = method_2""",
    "confusion_by_group": _confusion_sql("method_1 = method_2"),
    "confusion_by_modification": _confusion_sql("method_1 = method_2 AND modification_1 = modification_2", "modification_1 AS modification, method_1 AS method", "modification, method"),
    "roc_merged": _merged_sql("method_1 = method_2"),
    "roc_same_modification": _merged_sql("method_1 = method_2 AND modification_1 = modification_2"),
    "roc_histogram": f"""WITH r AS ({_merged_sql("method_1 = method_2")}), a AS (SELECT 'fp_rate' AS axis, floor(fp_rate::DOUBLE * 100)::INTEGER AS bin FROM r UNION ALL SELECT 'tp_rate', floor(tp_rate::DOUBLE * 100)::INTEGER FROM r)
SELECT axis, bin, count(*) AS n FROM a WHERE bin IS NOT NULL GROUP BY ALL""",
    "incoming_near": """SELECT * FROM (SELECT a.id AS new_id, b.id AS hash_id, list_sum(list_transform(list_zip(a.words, b.words), lambda z: bit_count(xor(z[1], z[2]))::INTEGER))::INTEGER AS hamming_distance
 FROM hashes a JOIN hashes b ON a.hashing_method_id = b.hashing_method_id AND a.nbits = b.nbits WHERE a.id IN (SELECT hash_id FROM probe_hashes) AND a.words IS NOT NULL AND b.words IS NOT NULL) WHERE hamming_distance <= 10""",
}

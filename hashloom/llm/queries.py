"""The training-data queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.skew import heavy_keys, salted_join
from hashloom.llm import dedup, leaks, nearest, packing, quantiles, spam, topn
from hashloom.runtime import durable, remove, shared_dir, table, tokenizer_dir

PCTS = [1, 5, 25, 50, 75, 95, 99]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five closest partners of every hash1_id."""
    rows = table(spark, sf_dir, "matches").select("hash1_id", "hash2_id", "hamming_distance", "id").where("hash1_id is not null and hash2_id is not null and hamming_distance >= 0 and hash1_id <> hash2_id")
    best = topn.best_row_per_key(rows, ["hash1_id", "hash2_id"], ["hamming_distance", "id"])
    return topn.top_n_per_group(best, ["hash1_id"], [F.col("hamming_distance"), F.col("hash2_id")], 5).select("hash1_id", F.col("id").alias("match_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that repeat or nearly repeat one accepted from an earlier run."""
    rows = dedup.arrivals(*(table(spark, sf_dir, t) for t in ("hashes", "modified_images", "run_images", "runs")))
    store = dedup.FingerprintStore(spark, f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}")
    try:
        return durable(dedup.deduplicate(rows, store).select(F.col("id").alias("hash_id")))
    finally:
        store.drop()


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hashing_method_id, hash_len, hamming_distance, day) of the matches that count."""
    rows = table(spark, sf_dir, "matches").where("hash1_id is not null and hash_len is not null and hamming_distance >= 0").select("hash1_id", "hash_len", "hamming_distance", F.to_date("loaded_at").alias("day"))
    methods = table(spark, sf_dir, "hashes").select(F.col("id").alias("hash1_id"), "hashing_method_id")
    return salted_join(rows, methods, "hash1_id", heavy_keys(rows, "hash1_id")).select("hashing_method_id", "hash_len", "hamming_distance", "day")


_GROUP = ["hashing_method_id", "hash_len"]


def p4_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each method, length and day, as what is read from it: its row count and its median."""
    return p4_daily_summaries(spark, sf_dir).drop("sketch")


def p4_daily_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each method, length and day, kept as rows that later merge: the sketch, its row count and median."""
    parts = quantiles.sketches(_distances(spark, sf_dir), _GROUP, "hamming_distance", ["day"])
    return parts.select(*_GROUP, "day", "sketch", F.kll_sketch_get_n_bigint("sketch").alias("n"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)).alias("median"))


def p4_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by method and length from the merged summaries of the days alone, each with the bounds of its rank error."""
    parts = quantiles.sketches(_distances(spark, sf_dir), _GROUP, "hamming_distance", ["day"])
    return quantiles.bounded_percentiles(quantiles.merge_sketches(parts, _GROUP), _GROUP, PCTS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the distance by method and length: daily summaries, merged, then settled by one more pass over the joined rows."""
    path = f"{shared_dir(spark)}/distances-{uuid.uuid4().hex}"
    try:
        _distances(spark, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
        parts = durable(quantiles.sketches(rows, _GROUP, "hamming_distance", ["day"]))
        merged = quantiles.merge_sketches(parts, _GROUP)
        return durable(quantiles.exact_percentiles(rows, _GROUP, "hamming_distance", merged, PCTS).select(*_GROUP, "pct", F.col("value").cast("int").alias("hamming_distance")))
    finally:
        remove(spark, path)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest hashes of every probe, as pairs."""
    rows = nearest.vector_rows(table(spark, sf_dir, "hashes"), "id", ["hashing_method_id", "nbits"], "hash")
    index = nearest.NearestIndex(spark, f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}")
    try:
        near = index.build(rows, 5, codes=False).search(table(spark, sf_dir, "probe_hashes"), "hash_id", 5, epsilon=None)
        return durable(near.select(F.least("query_id", "id").alias("hash_a"), F.greatest("query_id", "id").alias("hash_b")).distinct())
    finally:
        index.drop()


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container, a place in it and a step group for every non-empty post."""
    sizes = durable(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_dir()))
    return packing.pack(sizes, "doc_id", "tokens").withColumnRenamed("item_id", "doc_id").withColumnRenamed("n", "tokens")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = leaks.TrainingSuffixes(spark, f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}")
    try:
        return durable(kept.build(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "eval_items")))
    finally:
        kept.drop()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and the test items they hold."""
    return _passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common passage of each post and item, with its place in both."""
    return _passages(spark, sf_dir)


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the posts that hold no test passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return leaks.without_leaks(docs, _passages(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts made of repeated keywords, link lists or tags."""
    return spam.stuffed_pages(table(spark, sf_dir, "documents")).distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every post, how many characters are its own, in lists, and in heaps of keywords."""
    return spam.stuffed_shares(table(spark, sf_dir, "documents"))


_P4_ROWS = "SELECT h.hashing_method_id, m.hash_len, m.hamming_distance, CAST(m.loaded_at AS DATE) AS day FROM matches m JOIN hashes h ON h.id = m.hash1_id WHERE m.hash_len IS NOT NULL AND m.hamming_distance >= 0"

_TAG = r"(?is)<!--.*?-->|</?[a-zA-Z][^<>]*>|\[/?(?:quote|b|i|u|s|url|img|code|size|color|font|list|center|left|right|spoiler|email|youtube|\*)(?:=[^\[\]]*)?\]"


def _decoded(text: str) -> str:
    """SQL that decodes the entities that the texts hold, once: the ampersand's own comes last."""
    for entity, char in (("&nbsp;", " "), ("&#8212;", " "), ("&#44;", ","), ("&#63;", "?"), ("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "''"), ("&AMP;", "&"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def _grams(table: str, key: str) -> str:
    """SQL of the stretches of 12 words of each text of a table, with the place (from 0) of the first."""
    plain = f"regexp_replace(regexp_replace({_decoded('text')}, '{_TAG}', ' ', 'g'), '[\\x{{00AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    words = f"SELECT {key}, regexp_extract_all(lower({plain}), '[a-z0-9]+') AS w FROM {table} WHERE text IS NOT NULL"
    return f"SELECT {key}, i - 1 AS {key}_at, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM ({words}) WHERE len(w) >= 12)"


_SHARED = f"SELECT doc_id, item_id, doc_id_at AS d, item_id_at AS i FROM ({_grams('documents', 'doc_id')}) JOIN ({_grams('eval_items', 'item_id')}) USING (gram)"
_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_SHARED})"

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p4_daily_sketches": p4_daily_sketches, "p4_daily_summaries": p4_daily_summaries, "p4_bounded": p4_bounded, "p3_found": p3_found, "p6_assignment": p6_assignment, "p7_found": p7_found, "p7_passages": p7_passages, "p7_clean": p7_clean, "p8_found": p8_found, "p8_shares": p8_shares}
SQL = {
    "p1_found": """
WITH best AS (SELECT hash1_id, hash2_id, hamming_distance, id, row_number() OVER (PARTITION BY hash1_id, hash2_id ORDER BY hamming_distance, id) AS r FROM matches
 WHERE hash1_id IS NOT NULL AND hash2_id IS NOT NULL AND hamming_distance >= 0 AND hash1_id <> hash2_id),
ranked AS (SELECT hash1_id, id AS match_id, row_number() OVER (PARTITION BY hash1_id ORDER BY hamming_distance, hash2_id) AS k FROM best WHERE r = 1)
SELECT hash1_id, match_id FROM ranked WHERE k <= 5""",
    "p4_found": f"""
WITH d AS ({_P4_ROWS}), c AS (SELECT hashing_method_id, hash_len, hamming_distance, count(*) AS n FROM d GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY hashing_method_id, hash_len ORDER BY hamming_distance) AS upto, sum(n) OVER (PARTITION BY hashing_method_id, hash_len) AS total FROM c)
SELECT hashing_method_id, hash_len, pct, min(hamming_distance) AS hamming_distance FROM u, (SELECT unnest([1, 5, 25, 50, 75, 95, 99])::INTEGER AS pct) WHERE upto * 100 >= pct * total GROUP BY hashing_method_id, hash_len, pct""",
    "p3_found": """
WITH q AS (SELECT DISTINCT h.id, h.hashing_method_id, h.nbits, h.words FROM hashes h JOIN probe_hashes p ON p.hash_id = h.id WHERE h.words IS NOT NULL),
d AS (SELECT q.id AS q, h.id AS o, list_sum(list_transform(list_zip(q.words, h.words), lambda z: bit_count(xor(z[1], z[2]))::INTEGER)) AS dist
 FROM q JOIN hashes h ON h.hashing_method_id = q.hashing_method_id AND h.nbits = q.nbits AND h.id <> q.id WHERE h.words IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, o) AS k FROM d)
SELECT DISTINCT least(q, o) AS hash_a, greatest(q, o) AS hash_b FROM r WHERE k <= 5""",
    "p2_found": """
WITH RECURSIVE run_no AS (SELECT id AS run_id, row_number() OVER (ORDER BY timestamp, id) AS r FROM runs WHERE timestamp IS NOT NULL),
first AS (SELECT image_id, min(r) AS r FROM run_images JOIN run_no USING (run_id) WHERE image_id IS NOT NULL GROUP BY image_id),
h AS MATERIALIZED (SELECT h.id, h.hashing_method_id AS m, h.words[1] AS a, h.words[2] AS b, h.words[3] AS c, h.words[4] AS d, r
 FROM hashes h JOIN modified_images v ON v.id = h.mod_image_id JOIN first USING (image_id) WHERE nbits = 256),
near AS MATERIALIZED (SELECT x.id, x.r, y.id AS other FROM h x JOIN h y ON x.m = y.m AND y.r < x.r
 WHERE bit_count(xor(x.a, y.a))::INTEGER + bit_count(xor(x.b, y.b))::INTEGER + bit_count(xor(x.c, y.c))::INTEGER + bit_count(xor(x.d, y.d))::INTEGER <= 10),
steps AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS cases UNION ALL
 SELECT s.r + 1, list_concat(s.cases, coalesce((SELECT list(DISTINCT n.id) FROM near n WHERE n.r = s.r + 1 AND NOT list_contains(s.cases, n.other)), [])) FROM steps s WHERE s.r < (SELECT max(r) FROM run_no))
SELECT unnest(cases) AS hash_id FROM steps WHERE r = (SELECT max(r) FROM run_no)""",
    "p7_found": _LEAKS,
    "p7_passages": f"""
WITH s AS ({_SHARED}), g AS (SELECT *, d - row_number() OVER (PARTITION BY doc_id, item_id, d - i ORDER BY d) AS run FROM s),
p AS (SELECT doc_id, item_id, min(d) AS doc_word, min(i) AS item_word, count(*) + 11 AS n_words FROM g GROUP BY doc_id, item_id, d - i, run)
SELECT doc_id, item_id, doc_word, item_word, n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) AS k FROM p) WHERE k = 1""",
    "p7_clean": f"SELECT doc_id FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM ({_LEAKS}) WHERE doc_id IS NOT NULL)",
    "p4_daily_sketches": f"""
WITH c AS (SELECT hashing_method_id, hash_len, day, hamming_distance, count(*) AS n FROM ({_P4_ROWS}) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY hashing_method_id, hash_len, day ORDER BY hamming_distance) AS upto, sum(n) OVER (PARTITION BY hashing_method_id, hash_len, day) AS total FROM c)
SELECT hashing_method_id, hash_len, day, any_value(total)::BIGINT AS n, min(hamming_distance) FILTER (WHERE 2 * upto >= total)::BIGINT AS median FROM u GROUP BY hashing_method_id, hash_len, day""",
}

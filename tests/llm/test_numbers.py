import random

import pytest
from pyspark.sql import functions as F

from hashloom.llm import quantiles, topn

M = "id bigint, hamming_distance int, hash1_id bigint, hash2_id bigint, extra string"


def test_top_n_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3, 9]), rng.choice([7, 7, 7, rng.randrange(40), None]), rng.randrange(12), "x") for i in range(3000)] + [(9000, 1, 7, 3, "x")] * 2
    df = spark.createDataFrame(rows, M)
    kept = df.where("hash1_id is not null and hamming_distance is not null")
    best = topn.best_row_per_key(kept, ["hash1_id", "hash2_id"], ["hamming_distance", "id"])
    got = sorted((r.hash1_id, r.id) for r in topn.top_n_per_group(best, ["hash1_id"], [F.col("hamming_distance"), F.col("hash2_id")], 5).collect())
    least = {}
    for i, d, a, b, _ in rows:
        if d is not None and a is not None:
            least[a, b] = min(least.get((a, b), (99, 0)), (d, i))
    want = []
    for a in {k[0] for k in least}:
        want += [(a, i) for _, _, i in sorted((d, b, i) for (x, b), (d, i) in least.items() if x == a)[:5]]
    assert got == sorted(want)


def test_top_n_edges(spark):
    df = spark.createDataFrame([(1, 5, None, 2, "a"), (2, 5, None, 1, "b")], M)
    order = [F.col("hamming_distance"), F.col("hash2_id")]
    assert [r.id for r in topn.top_n_per_group(df, ["hash1_id"], order, 1).collect()] == [2]  # nulls are a group
    assert topn.top_n_per_group(df, ["hash1_id"], order, 0).count() == 0
    assert topn.top_n_per_group(df.where("false"), ["hash1_id"], order, 5).count() == 0
    clash = df.withColumn("_rank", F.lit("kept"))
    assert {r["_rank"] for r in topn.top_n_per_group(clash, ["hash1_id"], order, 1).collect()} == {"kept"}
    assert "extra" in topn.top_n_per_group(df, ["hash1_id"], order, 1).columns


def test_group_limit_in_plan(spark):
    df = spark.createDataFrame([(1, 5, 1, 2, "a")], M)
    plan = topn.top_n_per_group(df, ["hash1_id"], [F.col("hamming_distance"), F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _exact(values, p):
    values = sorted(values)
    return next(v for i, v in enumerate(values, 1) if i * 100 >= p * len(values))


@pytest.mark.parametrize("k,widen", [(1600, 2.0), (8, 0.0)])
def test_percentiles_against_brute_force(spark, k, widen):
    """The second case has brackets that miss, so that the full count settles them."""
    rng = random.Random(5)
    rows = [(g, rng.randrange(7), int(rng.gauss(500, 200)) if g != 2 else 4) for g in (0, 1, 1, 1, 2) for _ in range(2500)] + [(3, 0, 9), (0, 1, None), (None, 1, 3), (None, 2, 5)]
    df = spark.createDataFrame(rows, "g int, day int, v int").withColumn("total", F.lit("x")).withColumn("cell", F.lit("y"))  # names the operator uses
    pcts = [1, 5, 25, 50, 75, 95, 99]
    parts = quantiles.sketches(df, ["g"], "v", ["day"], k)
    merged = quantiles.merge_sketches(parts, ["g"], k)
    got = {(r.g, r.pct): r.value for r in quantiles.exact_percentiles(df, ["g"], "v", merged, pcts, k, widen).collect()}
    groups = {}
    for g, _, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {(g, p): _exact(v, p) for g, v in groups.items() for p in pcts}


def test_sketch_error_is_bounded_and_merges(spark):
    df = spark.range(0, 60000).select((F.col("id") * 7919 % 60000).cast("int").alias("v"), (F.col("id") % 9).alias("day"), F.lit(1).alias("g"))
    k = 400
    parts = quantiles.sketches(df, ["g"], "v", ["day"], k)
    whole = quantiles.percentiles(quantiles.merge_sketches(parts, ["g"], k), ["g"], [1, 50, 99]).collect()
    assert len(whole) == 3
    for r in whole:
        assert abs(r.value / 60000 - r.pct / 100) <= 2 * quantiles.rank_error(k)
    assert quantiles.sketches(df.where("false"), ["g"], "v", ["day"]).count() == 0


def test_daily_summaries(spark, tmp_path):
    from hashloom.llm import queries

    spark.createDataFrame([(i, i % 10, 0, 64, i % 21) for i in range(210)], "id bigint, hash1_id bigint, hash2_id bigint, hash_len int, hamming_distance int").selectExpr("*", "timestamp_ntz'2024-01-02 03:04:05' as loaded_at").write.parquet(f"{tmp_path}/matches.parquet")
    spark.range(0, 10).selectExpr("id", "1 as hashing_method_id").write.parquet(f"{tmp_path}/hashes.parquet")
    counts = queries.p4_daily_sketches(spark, str(tmp_path))
    assert [(r.n, r.median) for r in counts.collect()] == [(210, 10)]
    assert "kll_sketch_agg" in counts._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.n, r.median) for r in queries.p4_daily_summaries(spark, str(tmp_path)).collect()] == [(210, 10)]


def test_kept_summaries_merge_by_day(spark, tmp_path):
    """Days come in one by one, a day again; percentiles come from what is kept, within the bounds."""
    path, k = str(tmp_path / "kept"), 200
    rows = spark.range(0, 40000).select((F.col("id") * 7919 % 40000).cast("int").alias("v"), (F.col("id") % 4).cast("int").alias("day"), F.lit(1).alias("g"))
    for day in (0, 1, 2, 3, 2):
        quantiles.write_sketches(quantiles.sketches(rows.where(F.col("day") == day), ["g"], "v", ["day"], k), path, ["day"])
    kept = spark.read.parquet(path)
    assert kept.count() == 4
    found = quantiles.bounded_percentiles(quantiles.merge_sketches(kept, ["g"], k), ["g"], [1, 50, 99], k).collect()
    assert len(found) == 3
    for r in found:
        assert r.low <= r.value <= r.high and r.low <= 40000 * r.pct / 100 <= r.high


def test_percentiles_of_one_large_group_are_counted_in_slices(spark):
    df = spark.range(0, 30000).select((F.col("id") * 7919 % 30011).alias("v"), F.lit(1).alias("g"), (F.col("id") % 3).alias("day"))
    merged = quantiles.merge_sketches(quantiles.sketches(df, ["g"], "v", ["day"], 100), ["g"], 100)
    values = [r.v for r in df.collect()]
    got = {r.pct: r.value for r in quantiles.exact_percentiles(df, ["g"], "v", merged, [5, 50, 95], 100).collect()}
    assert got == {p: _exact(values, p) for p in (5, 50, 95)}

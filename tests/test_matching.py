import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.errors import NotEnoughHashes
from hashloom.operators import matching, roc
from hashloom.plans import match_queries

SCHEMA = "id bigint, hashing_method_id int, nbits int, words array<bigint>, truth bigint, extra string"


def _hashes(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        method = i % 2
        words = [int(w) for w in rng.integers(-(2**62), 2**62, 1 + 3 * method)]
        if i % 7 == 0 and i >= 14:
            words = rows[i - 14][3]
        rows.append((i, method, 64 * len(words), words, None if i % 5 == 0 else i % 3, "x"))
    return rows


def _brute(rows):
    out = []
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            a, b = rows[x], rows[y]
            if a[1] == b[1] and a[3] and b[3] and a[2] == b[2]:
                d = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(a[3], b[3], strict=True))
                out.append((a[0], b[0], d, a[1], a[4] is not None and a[4] == b[4]))
    return out


@pytest.mark.parametrize("block", [5, 1000])
def test_pairs_against_brute_force(spark, block):
    rows = _hashes(60) + [(60, 0, None, None, 1, "x"), (61, 0, 128, [1, 2], 1, "x"), (62, 0, 128, [1, 3], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows)
    got = matching.unique_pairs(df, block=block).collect()
    assert sorted((r.hash1_id, r.hash2_id, r.hamming_distance) for r in got) == sorted(p[:3] for p in want)
    counts = matching.pair_histogram(df, "truth", block).collect()
    assert sum(r.pairs for r in counts) == len(want)
    assert sum(r.pairs for r in counts if r.same) == sum(p[4] for p in want)
    assert sum(r.pairs * r.hamming_distance for r in counts) == sum(p[2] for p in want)
    summary = {r.id: r for r in matching.partner_summary(df, 8, block).collect()}
    assert 60 not in summary
    for i, s in summary.items():
        mine = [p[2] for p in want if i in p[:2]]
        assert (s.partners, s.sum_distance, s.nearest, s.links) == (len(mine), sum(mine), min(mine), sum(d <= 8 for d in mine))


def test_guards(spark):
    df = spark.createDataFrame([(1, 0, 64, [1], None, ""), (2, 0, 128, [1, 2], None, ""), (3, 1, 64, [1], None, "")], SCHEMA)
    assert {(r[0], r["status"]) for r in matching.method_counts(df).collect()} == {(0, "ready"), (1, "not_enough")}
    assert {tuple(r) for r in matching.unequal_lengths(df).collect()} == {(0, 1), (1, 0)}
    with pytest.raises(NotEnoughHashes) as e:
        matching.require_enough(df)
    assert (e.value.method_id, e.value.found) == (1, 1)
    empty = spark.createDataFrame([], SCHEMA)
    assert matching.unique_pairs(empty).count() == 0
    assert matching.pair_histogram(empty, "truth").count() == 0
    assert matching.partner_summary(empty, 8).count() == 0


def test_renderings(spark):
    df = spark.createDataFrame([(1, 0, 64, [1], None, ""), (2, 0, 64, [3], None, "")], SCHEMA)
    lengths = [matching.unique_pairs(df, r).first()["hash_len"] for r in ("bits", "list_bits", "list_bytes")]
    assert lengths == [64, 192, 80]


def test_roc(spark):
    rows = [(1, 10, 100, True), (2, 50, 100, True), (3, 50, 100, False), (4, 90, 100, False), (5, None, 100, True), (6, 5, 0, True), (7, 5, 100, None)]
    df = spark.createDataFrame(rows, "id int, hamming_distance int, hash_len int, truth boolean")
    grid = roc.thresholds(spark)
    assert grid.count() == 99
    counts = roc.counted(df, [], F.col("truth"))
    out = {r.threshold_idx: r for r in roc.rates(roc.confusion(counts, [], grid)).collect()}
    assert len(out) == 99
    assert (out[50].tp, out[50].fn, out[50].fp, out[50].tn) == (1, 1, 0, 2)  # strictly below
    assert (out[51].tp, out[51].fn, out[51].fp, out[51].tn) == (2, 0, 1, 1)
    assert all(r.tp + r.fn == 2 and r.fp + r.tn == 2 for r in out.values())
    tps = [out[i].tp for i in range(1, 100)]
    assert tps == sorted(tps)
    only = roc.counted(df.where("truth"), [], F.col("truth"))
    assert all(r.fp_rate is None for r in roc.rates(roc.confusion(only, [], grid)).collect())
    assert roc.confusion(roc.counted(df.where("false"), [], F.col("truth")), [], grid).count() == 0
    judged = df.select("id", roc.classification(F.lit(0.5).cast("float"), (F.col("hamming_distance") / 100).cast("float"), F.col("truth")).alias("c"))
    assert {r.id: r.c for r in judged.collect()} == {1: "TP", 2: "FN", 3: "TN", 4: "TN", 5: None, 6: "TP", 7: None}


def test_merge_of_parts_is_the_whole(spark):
    rows = [(g, d, 64, d % 3 == 0) for g in ("a", "b") for d in range(64)]
    df = spark.createDataFrame(rows, "g string, hamming_distance int, hash_len int, truth boolean")
    grid = roc.thresholds(spark)
    parts = roc.merged(roc.confusion(roc.counted(df, ["g"], F.col("truth")), ["g"], grid))
    whole = roc.confusion(roc.counted(df, [], F.col("truth")), [], grid)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.select(parts.columns).collect()))


def test_same_modification_has_matrices_by_modification(spark, monkeypatch):
    from hashloom.plans import match_queries

    rows = [("h", "h", "a", "a", 1, 1, 2, 64), ("h", "h", "a", "a", 1, 2, 2, 64), ("h", "h", "b", "b", 1, 1, 60, 64), ("h", "h", "a", "b", 1, 1, 2, 64), ("h", "k", "a", "a", 1, 1, 2, 64)]
    star = spark.createDataFrame(rows, "method_1 string, method_2 string, modification_1 string, modification_2 string, image_id_1 int, image_id_2 int, hamming_distance int, hash_len int")
    monkeypatch.setattr(match_queries, "match_star", lambda *_: star)
    got = {(r.modification, r.method): (r.tp, r.fn, r.fp, r.tn) for r in match_queries.confusion_by_modification(spark, "").where("threshold_idx = 50").collect()}
    assert got == {("a", "h"): (1, 0, 1, 0), ("b", "h"): (0, 1, 0, 0)}
    whole = match_queries.roc_same_modification(spark, "").where("threshold_idx = 50").first()
    assert (whole.tp, whole.fn, whole.fp, whole.tn) == (1, 1, 1, 0)


def test_histogram_writes_no_hash_once_a_tile(spark):
    """On a gigabyte every hash was shuffled once for each of some hundred tiles; equal and opposite hashes, hot truths."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(330):
        words = [int(w) for w in rng.integers(-(2**63), 2**63, (1, 4, 5)[i % 3])]
        if i % 10 == 0 and i:
            words = [~w for w in rows[i - 9][3]] if i % 20 else rows[i - 9][3]
        rows.append((i if i % 11 else None, i % 3, 64 * len(words), words, (None, 1, 1, 1, i)[i % 5], "x"))
    want = {}
    for _, _, d, method, same in _brute(rows):
        want[method, d, same] = want.get((method, d, same), 0) + 1
    assert {(1, 256), (1, 0)} <= {k[:2] for k in want}
    found = matching.pair_histogram(spark.createDataFrame(rows, SCHEMA), "truth", 7)
    assert {(r.hashing_method_id, r.hamming_distance, r.same): r.pairs for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "SortMergeJoin" not in plan


def test_packed_blocks_hold_each_hash_once(spark):
    rows = [r for r in _hashes(200) if r[3]]
    blocks = matching._packed(spark.createDataFrame(rows, SCHEMA), "truth", 10).collect()
    assert sum(len(b.words) for b in blocks) == 8 * sum(len(r[3]) for r in rows) and len(blocks) > 15
    assert all(b.block <= b["last"] for b in blocks)


def test_roc_of_hashes_writes_no_hash_once_a_tile(spark, tmp_path):
    """The query as it is: at 1 GB the tiles of its histogram filled the disk; a hash without an image has a truth of its own."""
    rows = [r for r in _hashes(120) if r[3]]
    spark.createDataFrame(rows, SCHEMA).withColumn("mod_image_id", F.col("id")).drop("truth").write.parquet(str(tmp_path / "hashes.parquet"))
    spark.createDataFrame([(r[0], r[4]) for r in rows], "id bigint, image_id bigint").where("id % 4 <> 0").write.parquet(str(tmp_path / "modified_images.parquet"))
    found = match_queries.roc_hashes(spark, str(tmp_path))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = _brute([r if r[0] % 4 else (*r[:4], None, "x") for r in rows])
    for r in found.where("threshold_idx in (20, 50)").collect():
        mine = [(np.float32(d / (64 + 192 * m)) < np.float32(r.threshold_idx / 100), same) for *_, d, m, same in pairs if m == r.hashing_method_id]
        assert (r.tp, r.fn, r.fp, r.tn) == tuple(mine.count(x) for x in ((True, True), (False, True), (True, False), (False, False)))


def test_equal_hashes_are_compared_once(spark, monkeypatch):
    """Repeats were compared one by one; hot ones, more numbers of repeats than are kept apart, and truths that repeat as well."""
    rng = np.random.default_rng(12)
    rows = []
    for value in range(90):
        method = value % 2
        words = [int(w) for w in rng.integers(-(2**63), 2**63, 1 + 3 * method)]
        rows += [(len(rows) + i, method, 64 * len(words), words, (None, 1, value, i)[i % 4], "x") for i in range((1, 2, 3, 6, value // 3 + 1)[value % 5])]
    rows += [(len(rows) + i, 0, 64, [5], i % 40, "x") for i in range(150)]
    want = {}
    for _, _, d, method, same in _brute(rows):
        want[method, d, same] = want.get((method, d, same), 0) + 1
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (6, 50, 1000):
        assert {(r.hashing_method_id, r.hamming_distance, r.same): r.pairs for r in matching.pair_histogram(df, "truth", block).collect()} == want
    seen, compared = matching._distances_seen, []
    monkeypatch.setattr(matching, "_distances_seen", lambda a, b: compared.append(a.shape[1] * b.shape[1]) or seen(a, b))
    words = np.repeat(rng.integers(0, 2**63, (4, 50)), 6, axis=1).astype("<u8")
    tile = {"hashing_method_id": 1, "nbits": 256, "block": 0, "block2": 0, "width": 4, "words": [words.tobytes()], "truth": [b""], "words2": [words.tobytes()], "truth2": [b""]}
    import pandas as pd

    counted = pd.concat(matching._count_tiles(iter([pd.DataFrame(tile)])))
    assert sum(compared) == 50 * 50 and counted["pairs"].sum() == 300 * 299 // 2


def test_many_numbers_of_repeats_are_put_together_from_powers_of_two():
    words = np.repeat(np.arange(40, dtype="<u8")[None, :], np.arange(1, 41), axis=1)
    groups = matching._by_repeats(words)
    assert len(groups) <= 6
    times = np.zeros(40, int)
    for n, found in groups:
        times[found[0].astype(int)] += n
    assert times.tolist() == list(range(1, 41))

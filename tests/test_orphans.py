import datetime as dt
import random

from hashloom.operators.orphans import contiguous_runs, orphan_references

P = "id bigint, loaded_at timestamp_ntz, extra string"
C = "id bigint, ref bigint, loaded_at timestamp_ntz, extra string"
DAY = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]


def _brute(kids, parents):
    return sorted(i for i, ref, at, _ in kids if ref is not None and not any(p == ref and t is not None and at is not None and t <= at for p, t, _ in parents))


def _found(spark, kids, parents, bucket=16):
    out = orphan_references(spark.createDataFrame(kids, C), "id", "ref", "loaded_at", spark.createDataFrame(parents, P), "id", "loaded_at", bucket)
    return sorted(r.child_id for r in out.collect())


def test_against_brute_force(spark):
    rng = random.Random(7)
    parents = [(i, rng.choice(DAY), "p") for i in range(-40, 200) if rng.random() < 0.8] + [(None, DAY[0], "p"), (500, None, "p"), (20, DAY[3], "p"), (20, DAY[9], "p")]
    kids = [(k, rng.choice([None, 7, 7, 7, rng.randrange(-60, 260)]), rng.choice([*DAY, None]), "c") for k in range(800)] + [(900, 500, DAY[5], "c"), (900, 500, DAY[5], "c")]
    assert _found(spark, kids, parents) == _brute(kids, parents)


def test_hot_reference(spark):
    kids = [(k, 99 if k % 3 else k, DAY[1], "c") for k in range(6000)]
    parents = [(i, DAY[0], "p") for i in range(6000) if i != 99]
    assert _found(spark, kids, parents) == [k for k, ref, *_ in kids if ref == 99]


def test_empty_tables(spark):
    assert _found(spark, [], []) == []
    assert _found(spark, [], [(1, DAY[0], "")]) == []
    assert _found(spark, [(1, 5, DAY[0], ""), (2, None, DAY[0], "")], []) == [1]


def test_runs(spark):
    parents = [(i, DAY[0], "") for i in (1, 2, 3, 5, 6)] + [(7, DAY[1], ""), (17, DAY[1], "")]
    runs = sorted((r.start, r.end) for r in contiguous_runs(spark.createDataFrame(parents, P), "id", "loaded_at", 16).collect())
    assert runs == [(1, 3), (5, 6), (7, 7), (17, 17)]

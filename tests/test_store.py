import pytest
from pyspark.sql import functions as F

from hashloom.errors import StoreError
from hashloom.functions.bits import bit_text, bytes_of, differing_bits, hash_len, hex_text, words_of
from hashloom.functions.numbering import numbered
from hashloom.functions.paths import file_name, user_of
from hashloom.functions.skew import heavy_keys, salted_join
from hashloom.operators import upserts, views
from hashloom.sources.images import rejects
from hashloom.sources.warehouse import Warehouse


def test_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "c"), (4, None)], "id int, name string")
    assert sorted(map(tuple, upserts.insert_ignore(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, None)]
    assert upserts.insert_ignore(old, new.where("false"), ["id"]).count() == 2
    assert upserts.insert_ignore(old.where("false"), new, ["id"]).count() == 3


def test_upsert_returning(spark):
    old = spark.createDataFrame([(5, 1, 1), (9, 1, 2)], "id bigint, image_id bigint, modification_id int")
    new = spark.createDataFrame([(1, 2, "x"), (1, 3, "x"), (1, 3, "y"), (0, 7, "z")], "image_id bigint, modification_id int, extra string")
    table, back = upserts.upsert_returning(old, new, ["image_id", "modification_id"])
    assert sorted(map(tuple, table.collect())) == [(5, 1, 1), (9, 1, 2), (10, 0, 7), (11, 1, 3)]
    assert sorted(map(tuple, back.collect())) == [(9, 1, 2), (10, 0, 7), (11, 1, 3)]


def test_numbering(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    rows = numbered(df, ["k"], "n", 3, 7).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(3, 5003)) and [r.k for r in rows] == sorted(r.k for r in rows)
    assert numbered(df.where("false"), ["k"], "n").count() == 0


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create()
    w.create()
    assert w.read("runs").count() == 0
    w.append("runs", spark.createDataFrame([(1, 10)], "id bigint, timestamp bigint"))
    w.append("runs", spark.createDataFrame([(2, 20)], "id bigint, timestamp bigint"))
    assert sorted(map(tuple, w.read("runs").collect())) == [(1, 10), (2, 20)]
    w.replace("runs", w.read("runs").where("id = 2"))
    assert [tuple(r) for r in w.read("runs").collect()] == [(2, 20)]
    with pytest.raises(StoreError):
        w.append("other", w.read("runs"))


def test_a_write_that_is_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create()
    one = spark.createDataFrame([(1, 10)], "id bigint, timestamp bigint")
    w.append("runs", one)
    with monkeypatch.context() as m:  # stopped after the rows and before the pointer
        m.setattr(Warehouse, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            w.append("runs", one)
    (tmp_path / "w" / "runs" / "new-0").write_text("[")  # stopped while the pointer was written
    again = Warehouse(spark, str(tmp_path / "w"))
    again.create()
    assert again.read("runs").count() == 1
    again.append("runs", one)
    assert again.read("runs").count() == 2
    assert again.vacuum() >= 2 and again.read("runs").count() == 2
    with pytest.raises(StoreError):  # another writer had the number
        again._point("runs", [], again._latest("runs"))
    assert again.read("runs").count() == 2
    for f in (tmp_path / "w" / "runs").glob("*CURRENT-*"):
        f.unlink()
    with pytest.raises(StoreError):  # rows without a pointer aren't an empty table
        Warehouse(spark, str(tmp_path / "w")).create()


def test_paths(spark):
    df = spark.createDataFrame([("root/u1/a.png",), ("root/a.png",), ("a.png",), ("/a.png",), (None,), ("u//x.png",), ("d/",)], "path string")
    got = [tuple(r) for r in df.select(user_of(F.col("path")), file_name(F.col("path"))).collect()]
    assert got == [("u1", "a.png"), ("root", "a.png"), ("undefined", "a.png"), ("undefined", "a.png"), (None, None), ("undefined", "x.png"), ("d", "")]
    assert df.select(user_of(F.col("path"), "root/a.png")).collect()[1][0] == "undefined"
    assert {r.error for r in rejects(df).collect()} == {"no path", "no file name"}


def test_bits(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x80\x01"), [-(1 << 63) | 1 << 48], 16), (2, None, None, None)], "id int, hash binary, words array<bigint>, nbits int")
    one, two = df.select(hex_text(F.col("hash")), bit_text(F.col("words"), F.col("nbits")), differing_bits(F.col("words"), F.array(F.lit(0).cast("bigint"))), differing_bits(F.col("words"), F.array(F.lit(0), F.lit(0)).cast("array<bigint>"))).collect()
    assert tuple(one) == ("8001", "1000000000000001", 2, None) and tuple(two) == (None,) * 4
    assert [tuple(r) for r in df.select(words_of(F.col("hash")), bytes_of(F.col("words"), F.col("nbits"))).collect()] == [([-(1 << 63) | 1 << 48], bytearray(b"\x80\x01")), (None, None)]
    assert spark.sql("select binary('') h").select(words_of(F.col("h"))).first()[0] == []
    with pytest.raises(ValueError):
        hash_len(F.lit(1), "other")


def test_salted_join(spark):
    big = spark.range(0, 9000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("bigint").alias("k"))
    small = spark.createDataFrame([(1, "a"), (4, "b"), (None, "c")], "k bigint, name string")
    heavy = heavy_keys(big, "k")
    assert heavy == [1]
    plain, salted = salted_join(big, small, "k", []), salted_join(big, small, "k", heavy)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect())) and plain.count() == 3002
    assert salted_join(big, small, "k", heavy, how="left").count() == 9000
    assert heavy_keys(big.where("false"), "k") == []


def test_heavy_keys_take_one_job(spark):
    big = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("bigint").alias("k"))
    group = "one-job"
    spark.sparkContext.setJobGroup(group, "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert heavy_keys(big.where("k is not null"), "k") == [1]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2  # adaptive execution runs the shuffle's map side as its own job
    assert heavy_keys(spark.createDataFrame([(None,)], "k bigint"), "k") == []


def test_star_keeps_clashing_names_apart(spark):
    described = spark.createDataFrame([(1, "m", 7, "rot"), (2, "m", 8, "blur")], "hash_id bigint, method string, image_id bigint, modification string")
    matches = spark.createDataFrame([(1, 1, 2), (2, 1, 99), (3, None, 1), (4, 2, 2)], "id bigint, hash1_id bigint, hash2_id bigint")
    rows = views.match_star(matches, described).collect()
    assert sorted((r.id, r.image_id_1, r.image_id_2) for r in rows) == [(1, 7, 8), (4, 8, 8)]
    star = views.match_star(matches, described)
    assert views.paired(star, "same_modification").count() == 1 and views.paired(star, "cross_modification").count() == 1 and views.paired(star).count() == 2
    with pytest.raises(ValueError):
        views.paired(star, "none")

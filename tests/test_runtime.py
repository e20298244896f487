import pytest
from pyspark.sql import functions as F

from hashloom import runtime
from hashloom.errors import StoreError


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, named=None):
        self.sparkContext, self.named = _Context(master), named
        self.conf = self

    def get(self, key, default):
        return self.named if key == "spark.checkpoint.dir" and self.named else default


def test_a_cluster_has_to_name_its_shared_folder():
    with pytest.raises(StoreError):
        runtime.shared_dir(_Session("spark://host:7077"))
    assert runtime.shared_dir(_Session("spark://host:7077", "/shared")) == "/shared"
    assert "hashloom-" in runtime.shared_dir(_Session("local[2]"))


def test_scratch_goes_with_its_block(spark):
    with runtime.Scratch(spark) as s:
        kept = s.keep(spark.range(0, 10).select("id", F.lit(None).cast("string").alias("x")))
        assert kept.count() == 10 and s.keep(kept.where("id < 3")).count() == 3
        path = s.path
        assert runtime.exists(spark, path)
    assert not runtime.exists(spark, path)


def test_spread_keeps_rows_and_wide_tables(spark):
    one = spark.range(0, 100, 1, 1)
    assert runtime.spread(one).rdd.getNumPartitions() == 4 and sorted(r.id for r in runtime.spread(one).collect()) == list(range(100))
    wide = spark.range(0, 100, 1, 9)
    assert runtime.spread(wide) is wide


def test_files_of_the_shared_folder(spark, tmp_path):
    path = str(tmp_path / "a" / "b.txt")
    runtime.write_text(spark, path, "h\u00e9")
    assert runtime.read_text(spark, path) == "h\u00e9" and runtime.exists(spark, path)
    runtime.write_bytes(spark, path, b"\x00\xff")
    assert (tmp_path / "a" / "b.txt").read_bytes() == b"\x00\xff"
    runtime.remove(spark, str(tmp_path / "a"))
    assert not runtime.exists(spark, path)

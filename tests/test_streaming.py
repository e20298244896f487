import random

from hashloom.streaming import incoming as stream
from hashloom.streaming.incoming import detect, keep, near_stored

SCHEMA = "id bigint, hashing_method_id int, nbits int, words array<bigint>"


def _rows(n, start, base=None):
    rng = random.Random(start)
    out = []
    for i in range(n):
        w = rng.getrandbits(64)
        if base and i % 2:
            w = base[i % len(base)][3][0] & (2**64 - 1)
            for b in rng.sample(range(64), rng.randrange(0, 9)):
                w ^= 1 << b
        out.append((start + i, 0, 64, [w - (1 << 64) if w >> 63 else w]))
    return out


def _near(a, b, limit):
    d = bin((a[3][0] ^ b[3][0]) & (2**64 - 1)).count("1")
    return d if d <= limit else None


def test_near_stored(spark):
    stored = _rows(80, 0)
    new = [*_rows(60, 1000, stored), (5000, 0, None, None), (5001, 0, 128, [1, 2])]
    got = sorted(map(tuple, near_stored(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(stored, SCHEMA), 6).collect()))
    want = sorted((a[0], b[0], d) for a in new[:60] for b in stored if (d := _near(a, b, 6)) is not None)
    assert got == want and want
    assert near_stored(spark.createDataFrame([], SCHEMA), spark.createDataFrame(stored, SCHEMA), 6).count() == 0


def test_wide_and_unequal_hashes(spark):
    rng = random.Random(4)
    stored = [(i, i % 2, 256, [rng.getrandbits(63) for _ in range(4)]) for i in range(40)]
    new = []
    for i, m, n, words in stored[:20]:
        v = int.from_bytes(b"".join(w.to_bytes(8, "big") for w in words), "big")
        for b in rng.sample([b for b in range(256) if b % 64 != 63], 3):
            v ^= 1 << b
        data = v.to_bytes(32, "big")
        new.append((100 + i, m, n, [int.from_bytes(data[k : k + 8], "big", signed=True) for k in range(0, 32, 8)]))
    got = sorted(map(tuple, near_stored(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(stored, SCHEMA), 3).collect()))
    assert got == [(100 + i, i, 3) for i in range(20)]  # 64-bit bands, across words
    assert near_stored(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(stored, SCHEMA), 1).count() == 0


def test_stream(spark, tmp_path):
    stored, new = _rows(40, 0), None
    store, source, found = (str(tmp_path / x) for x in ("store", "in", "found"))
    keep(spark.createDataFrame(stored, SCHEMA), store, 6, -1)
    new = _rows(30, 1000, stored)
    spark.createDataFrame(new, SCHEMA).coalesce(1).write.parquet(source)
    for _ in range(2):  # the second start finds nothing new
        incoming = spark.readStream.schema(SCHEMA).parquet(source)
        detect(incoming, store, found, str(tmp_path / "check"), 6, available_now=True).awaitTermination(120)
    got = spark.read.parquet(f"{found}/*").collect()
    want = sorted((a[0], b[0], d) for a in new for b in stored if (d := _near(a, b, 6)) is not None)
    assert sorted(map(tuple, got)) == want
    assert spark.read.parquet(store).select("id").distinct().count() == 70


def test_a_batch_reads_the_folders_of_its_bands_only(spark, tmp_path):
    store = str(tmp_path / "store")
    keep(spark.createDataFrame(_rows(400, 0), SCHEMA), store, 3, 0)
    one = stream._banded(spark.createDataFrame(_rows(1, 9000), SCHEMA), 3)
    read = stream.earlier(store, one, 1)
    assert 0 < read.select("bucket").distinct().count() <= 4 and read.count() < 400
    assert stream.earlier(store, one, 0).count() == 0

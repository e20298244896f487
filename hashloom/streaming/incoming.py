"""Incoming hashes held against the stored ones, batch by batch (an extension: the batch pipeline's use case, as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.bits import differing_bits
from hashloom.functions.skew import heavy_keys, salted_join
from hashloom.runtime import exists


def bands(hashes: DataFrame, count: int) -> DataFrame:
    """Each hash once for each of ``count`` aligned bands of its bits, under a 64-bit key of method, length, band and bits.

    A band longer than 63 bits goes by its last 63: still equal where the whole band is. Unequal
    bands may share a key; whoever joins on it compares the hashes anyway.
    """
    shift = lambda way, x, by: F.call_function(way, x, by)
    rows = hashes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    rows = rows.withColumn("_end", F.floor((F.col("_i") + 1) * F.col("nbits") / count).cast("int"))
    rows = rows.withColumn("_size", F.least(F.lit(63), F.col("_end") - F.floor(F.col("_i") * F.col("nbits") / count).cast("int")))
    first, last = F.floor((F.col("_end") - F.col("_size")) / 64).cast("int"), F.floor((F.col("_end") - 1) / 64).cast("int")
    low = F.col("_end") - last * 64
    right = F.when(low == 64, F.get("words", last)).otherwise(shift("shiftrightunsigned", F.get("words", last), 64 - low))
    both = F.when(first == last, right).otherwise(shift("shiftleft", F.get("words", first), low).bitwiseOR(right))
    bits = F.when(F.col("_size") > 0, both.bitwiseAND(shift("shiftrightunsigned", F.lit(-1).cast("bigint"), 64 - F.col("_size")))).otherwise(F.lit(0).cast("bigint"))
    return rows.withColumn("band_key", F.xxhash64("hashing_method_id", "nbits", "_i", bits)).drop("_i", "_end", "_size")


def near_stored(new: DataFrame, stored: DataFrame, distance: int) -> DataFrame:
    """(new_id, hash_id, hamming_distance): stored hashes of the same method and length at most ``distance`` bits away.

    Two hashes that differ in ``distance`` bits agree in one of distance + 1 bands, so they meet
    under an equal key; no pair is lost and all pairs are never made. A band that a large share of
    the new hashes have is salted; adaptive execution splits one that only the stored have.
    """
    return _near(_banded(new, distance), _banded(stored, distance), distance)


def _banded(hashes: DataFrame, distance: int) -> DataFrame:
    return bands(hashes.where("words is not null and nbits > 0").select("id", "hashing_method_id", "nbits", "words"), distance + 1)


def _near(new: DataFrame, stored: DataFrame, distance: int) -> DataFrame:
    a = new.select(F.col("id").alias("new_id"), F.col("words").alias("new_words"), "band_key")
    b = stored.select(F.col("id").alias("hash_id"), "words", "band_key")
    both = salted_join(b, a, "band_key", heavy_keys(a, "band_key")).withColumn("hamming_distance", differing_bits(F.col("words"), F.col("new_words")))
    return both.where(F.col("hamming_distance") <= distance).select("new_id", "hash_id", "hamming_distance").distinct()


#: Folders of a store's batch, by band key. A batch reads only the folders its own bands fall into.
BUCKETS = 64
STORED = "id bigint, hashing_method_id int, nbits int, words array<bigint>, band_key bigint, batch bigint, bucket int"


def keep(hashes: DataFrame, store: str, distance: int, batch: int) -> None:
    """Writes the hashes to the store under their bands, as that batch; written again, a batch replaces itself.

    Stored hashes that no batch brought are loaded as batch -1.
    """
    rows = _banded(hashes, distance).withColumn("bucket", F.pmod("band_key", F.lit(BUCKETS)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "band_key").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch}")


def earlier(store: str, new: DataFrame, batch: int) -> DataFrame:
    """Band rows of the batches before ``batch`` in the folders that the bands of ``new`` (banded) fall into; other folders aren't read."""
    touched = [r[0] for r in new.select(F.pmod("band_key", F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().collect()]  # BUCKETS numbers at most
    known = new.sparkSession.read.schema(STORED).option("basePath", store).parquet(store)
    return known.where((F.col("batch") < batch) & F.col("bucket").isin(touched))


def detect(incoming: DataFrame, store: str, found: str, checkpoint: str, distance: int, available_now: bool = False):
    """Starts the stream: each batch is matched with the store, its matches are written, then it joins the store.

    Both writes go to a folder named by the batch number and replace it, so a batch that runs again
    after a failure leaves the same rows: the batch is matched with the batches before it only. The
    store holds each hash under its bands, sorted, so a batch neither computes them anew nor reads
    folders it shares no band with.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", "hashing_method_id", "nbits", "words")
        mine = _banded(rows, distance)
        spark = batch.sparkSession
        if exists(spark, store):
            _near(mine, earlier(store, mine, number), distance).write.mode("overwrite").parquet(f"{found}/batch-{number}")
        keep(rows, store, distance, number)

    writer = incoming.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

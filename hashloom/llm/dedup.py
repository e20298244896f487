"""Deduplicating new batches of hashes against all history.

Two hashes of BITS bits that differ in at most DISTANCE of them differ in at most one bit of one of
DISTANCE // 2 + 1 aligned blocks (6 blocks of 42 or 43 bits): these blocks are what the store keeps
of a hash, its fingerprints. (Winnowing keeps, of each window of grams, one, such that a shared
stretch of a window's length always shares a kept gram. Two hashes DISTANCE bits apart may share no
stretch longer than 23 bits, and a fixed-length hash has no shifts, so aligned blocks are used.)

The store is a set of layers. A layer holds the fingerprints in folders by their hash, sorted, and
partitioned Bloom filters of a fixed size, as many as its fingerprints need; layers of like size are
merged, so there are few. A new batch asks the filters for each of its fingerprints and for each
that differs in one bit. To this end a fingerprint is filed twice, under either of its halves: the
one-bit variants of a fingerprint keep one half, so they are all tried where that half's filter is
and never shuffled. What the filters let through is looked up in the folders it falls into, and
only there; what is found is verified by the number of differing bits. What remains is resolved
within the batch in the order of its runs, and what is accepted becomes a layer of the store.

Within a batch, which has a bounded number of values, the fingerprints are DISTANCE + 1 blocks, one
of which two near hashes have in common.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.numbering import numbered
from hashloom.functions.skew import heavy_keys, salted_join
from hashloom.runtime import durable, exists, hadoop_path, read_text, remove, write_text

BITS, DISTANCE = 256, 10
#: Of a block longer than this, its last bits are the fingerprint.
PRINT_BITS = 43
#: A Bloom filter's bits, the fingerprints it is made for (each is filed twice), and its hash functions.
FILTER_BITS, FILTER_PRINTS, FILTER_HASHES = 1 << 16, 4096, 8
#: Fingerprints in a folder of a layer, about.
BUCKET_ROWS = 1 << 18
#: So many layers of like size are merged.
FANOUT = 8
#: A fingerprint that more values share is looked up by a second one as well.
HOT = 200
#: Tasks that the questions about a hot half are spread over.
SALTS = 16
#: At least so many batches, and at most so many rows in one.
BATCHES, BATCH_ROWS = 4, 1 << 22
VALUE = ["kind", "value", "run_no", "w0", "w1", "w2", "w3"]
STORED = ["kind", "print", "run_no", "w0", "w1", "w2", "w3"]
_STORED = "kind int, print bigint, run_no bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint, bucket int"


def _bits(words: list[Column], start: int, end: int) -> Column:
    """Bits start to end (at most 63 of them), counted from the most significant of the first word."""
    a, b = start // 64, (end - 1) // 64
    mask = F.lit((1 << (end - start)) - 1)
    if a == b:
        return F.shiftrightunsigned(words[a], 64 - (end - 64 * a)).bitwiseAND(mask)
    low = end - 64 * b
    return F.shiftleft(words[a], low).bitwiseOR(F.shiftrightunsigned(words[b], 64 - low)).bitwiseAND(mask)


def blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """The ends of n aligned blocks; of a block longer than a fingerprint, its last bits."""
    return [(max(i * bits // n, (i + 1) * bits // n - PRINT_BITS), (i + 1) * bits // n) for i in range(n)]


def coarse(distance: int) -> int:
    """Blocks such that two near values differ in at most one bit of one of them."""
    return distance // 2 + 1


def _words(prefix: str = "w") -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(BITS // 64)]


def differing(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(BITS // 64)))


def fingerprints(values: DataFrame, n: int) -> DataFrame:
    """Each value once for each of its n blocks, as print (block number and bits)."""
    each = [F.shiftleft(F.lit(i).cast("bigint"), 48).bitwiseOR(_bits(_words(), a, b)) for i, (a, b) in enumerate(blocks(BITS, n))]
    return values.withColumn("print", F.explode(F.array(*each)))


def _second(prints: DataFrame, n: int, distance: int) -> DataFrame:
    """Fingerprint rows once for each of distance + 1 blocks of the bits outside their own block: two near values agree in one of those too."""
    spans = blocks(BITS, n)
    words = _words()

    def turned(by: int, i: int) -> Column:
        q, r = by // 64, by % 64
        x, y = words[(i + q) % 4], words[(i + q + 1) % 4]
        return F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(y, 64 - r)) if r else x

    block = F.shiftright("print", 48)
    for i in range(4):
        choice = reduce(lambda c, s: c.when(block == s[0], turned(s[1][1] % BITS, i)), enumerate(spans), F)  # noqa: B023
        prints = prints.withColumn(f"r{i}", choice)
    rest = BITS - -(-BITS // n)
    inner = [F.shiftleft(F.lit(i).cast("bigint"), 48).bitwiseOR(_bits(_words("r"), a, b)) for i, (a, b) in enumerate(blocks(rest, distance + 1))]
    return prints.withColumn("print2", F.explode(F.array(*inner))).drop("r0", "r1", "r2", "r3")


def near(left: DataFrame, right: DataFrame, hot: DataFrame | None, n: int, distance: int, pairs: bool = False) -> DataFrame:
    """(value), some of them repeatedly, of the fingerprint rows of left that are within the distance of one of right of an earlier run; with ``pairs`` (value, other).

    ``hot`` names fingerprints (kind, print) that many values of right share, as flat pictures do;
    they are joined by a second fingerprint as well, so that a bucket of unlike values isn't
    compared in pairs. Without ``pairs`` a value is done with its first match.
    """

    def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        rule = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on)) & (differing("a", "b") <= distance) & (F.col("b.run_no") < F.col("a.run_no"))
        if pairs:
            return a.alias("a").join(b.alias("b"), rule).select(F.col("a.value").alias("value"), F.col("b.value").alias("other"))
        return a.alias("a").join(b.alias("b"), rule, "left_semi").select("value")

    key = ["kind", "print"]
    if hot is None:
        return joined(left, right, key)
    cold = joined(left.join(hot, key, "left_anti"), right.join(hot, key, "left_anti"), key)
    return cold.unionByName(joined(_second(left.join(hot, key, "left_semi"), n, distance), _second(right.join(hot, key, "left_semi"), n, distance), [*key, "print2"]))


def _kept(df: DataFrame, measure: Column | None = None) -> tuple[DataFrame, int]:
    """The durable rows, and their number (or another measure) as seen on the way, without a job of its own."""
    seen = Observation()
    rows = durable(df.observe(seen, F.coalesce(F.count(F.lit(1)) if measure is None else measure, F.lit(0)).cast("bigint").alias("n")))
    return rows, seen.get["n"]


def fallen(values: DataFrame, distance: int) -> DataFrame | None:
    """(value) of a batch's distinct values that are near to an accepted one of an earlier run of the batch; None if there are none.

    Only fingerprints shared by values of different runs matter; most values have none and are
    accepted without a comparison. Where a fingerprint is hot, values that are the earliest under
    all of theirs are accepted first and what is near to them falls, which thins out dense heaps
    before values are compared with each other. Then, round by round, values near to one without
    an earlier open neighbour fall; each round settles at least the earliest run, so there are at
    most as many rounds as the batch has runs. Values of one run aren't held against each other.
    """
    n = distance + 1
    prints = fingerprints(values, n)
    buckets = prints.groupBy("kind", "print").agg(F.count(F.lit(1)).alias("n"), F.min("run_no").alias("first"), F.max("run_no").alias("last")).where("first < last")
    open_prints, most = _kept(prints.join(buckets.select("kind", "print", "n", "first"), ["kind", "print"]), F.max("n"))
    if not most:
        return None
    hot, down = None, None
    if most > HOT:
        hot = durable(open_prints.where(F.col("n") > HOT).select("kind", "print").distinct())
        leaders = durable(open_prints.groupBy("value").agg(F.min((F.col("run_no") == F.col("first")).cast("int")).alias("leads")).where("leads = 1").select("value"))
        others = open_prints.join(leaders, "value", "left_anti")
        down = durable(near(others, open_prints.join(leaders, "value", "left_semi"), hot, n, distance))
        open_prints = durable(others.join(down, "value", "left_anti"))
    edges, left = _kept(near(open_prints, open_prints, hot, n, distance, True))
    while left:
        free = edges.select("other").join(edges.select(F.col("value").alias("other")), "other", "left_anti")
        falls = durable(edges.join(free, "other", "left_semi").select("value"))
        down = falls if down is None else down.unionByName(falls)
        edges, left = _kept(edges.join(falls, "value", "left_anti").join(falls.select(F.col("value").alias("other")), "other", "left_anti").select("value", "other"))
    return down


def _halves(n: int) -> list[tuple[int, int]]:
    """Bits of the high and of the low half of each block's fingerprint."""
    return [((b - a) // 2, (b - a) - (b - a) // 2) for a, b in blocks(BITS, n)]


def filed(prints: DataFrame, n: int) -> DataFrame:
    """(kind, print, half, at): each fingerprint under its high (0) and its low half (1); ``at`` is the hash of the half."""
    low = reduce(lambda c, x: c.when(F.shiftright("print", 48) == x[0], F.lit((1 << x[1][1]) - 1)), enumerate(_halves(n)), F)
    kept = F.when(F.col("half") == 0, F.col("print").bitwiseAND(F.bitwise_not(low))).otherwise(F.col("print").bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftright("print", 48), 48)))
    return prints.select("kind", "print", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn("at", F.xxhash64("kind", "half", kept))


def _range_of(at: Column, bits: int) -> Column:
    """The number of the 2^bits equal ranges of hashes that ``at`` falls into."""
    return (F.shiftright(at, 64 - bits) + (1 << (bits - 1))).cast("bigint") if bits else F.lit(0).cast("bigint")


def _mixed(prints: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = prints.astype(np.uint64) ^ (kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    return ((a + np.uint64(i) * b) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def build_filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bloom filters from rows (block, kind, print) that come in the order of their block: one filter is held at a time, whatever falls into it."""
    block, bits = None, np.zeros(0, bool)
    for pdf in batches:
        blocks_ = pdf["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks_)) + 1), len(pdf)]
        a, b = _mixed(pdf["print"].to_numpy(), pdf["kind"].to_numpy())
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if blocks_[start] != block:
                if block is not None:
                    yield pd.DataFrame({"block": [block], "bits": [np.packbits(bits).tobytes()]})
                block, bits = blocks_[start], np.zeros(FILTER_BITS, bool)
            for i in range(FILTER_HASHES):
                bits[_place(a[start:end], b[start:end], i)] = True
    if block is not None:
        yield pd.DataFrame({"block": [block], "bits": [np.packbits(bits).tobytes()]})


def known_variants(prints: np.ndarray, kinds: np.ndarray, halves: np.ndarray, filters: list[np.ndarray], sizes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, variant): which of the fingerprints with at most one bit of the other half turned some filter may hold.

    The unturned one is tried under the high half only.
    """
    rows, variants = [], []
    block = prints >> 48
    for n in np.unique(block):
        high, low = sizes[n]
        for half, flips in ((0, [0, *(1 << i for i in range(low))]), (1, [1 << i for i in range(low, low + high)])):
            at = np.flatnonzero((block == n) & (halves == half))
            for some in np.array_split(at, -(-len(at) // 4096)) if len(at) else ():
                tried = (prints[some, None] ^ np.array(flips, dtype=np.int64)).ravel()
                a, b = _mixed(tried, np.repeat(kinds[some], len(flips)))
                held = np.zeros(len(tried), bool)
                for bits in filters:
                    left = np.flatnonzero(bits[_place(a, b, 0)])
                    for i in range(1, FILTER_HASHES):
                        left = left[bits[_place(a[left], b[left], i)]]
                    held[left] = True
                found = np.flatnonzero(held)
                rows.append(some[found // len(flips)])
                variants.append(tried[found])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(variants)) if rows else (none, none)


def _screen(batches: Iterator[pd.DataFrame], sizes: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """Fingerprints that may be known, from rows in the order of (part, salt, at, asked): filters come before what is asked of them.

    Of each layer one filter is held at a time, so a task's memory doesn't grow with what is asked.
    """
    group, packed, ready = None, {}, {}
    for pdf in batches:
        groups = pdf["part"].to_numpy() * SALTS + pdf["salt"].to_numpy()
        asked = pdf["asked"].to_numpy().astype(bool)
        kinds, prints, halves = (pdf[c].fillna(0).to_numpy(np.int64) for c in ("kind", "print", "half"))
        cuts = np.unique(np.concatenate([[0, len(pdf)], np.flatnonzero(np.diff(groups)) + 1, np.flatnonzero(~asked), np.flatnonzero(~asked) + 1]))
        for start, end in zip(cuts, cuts[1:], strict=False):
            if groups[start] != group:
                group, packed, ready = groups[start], {}, {}
            if not asked[start]:
                layer = pdf["layer"].iloc[start]
                packed[layer] = pdf["bits"].iloc[start]
                ready.pop(layer, None)
                continue
            for layer in packed.keys() - ready.keys():
                ready[layer] = np.unpackbits(np.frombuffer(packed[layer], np.uint8)).astype(bool)
            part = slice(start, end)
            rows, variants = known_variants(prints[part], kinds[part], halves[part], list(ready.values()), sizes)
            if len(rows):
                yield pd.DataFrame({"kind": kinds[part][rows].astype(np.int32), "print": prints[part][rows], "variant": variants})


class FingerprintStore:
    """Accepted hashes in a folder, as layers named by the newest manifest.

    A batch's layer is written first and counts once the next manifest, renamed into place as the
    last step, names it; a job that is cut off and begun again leaves nothing behind that counts.
    A store that is opened again goes on with what the newest manifest names. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS, fanout: int = FANOUT):
        self.spark, self.path, self.distance, self.bucket_rows, self.fanout = spark, path.rstrip("/"), distance, bucket_rows, fanout
        self.n = coarse(distance)
        fs, root = hadoop_path(spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        self.version = max((int(x[9:]) for x in names if x.startswith("manifest-") and x[9:].isdecimal()), default=0)
        state = json.loads(read_text(spark, f"{self.path}/manifest-{self.version}")) if self.version else {"batches": 0, "layers": []}
        self.batches, self.layers = state["batches"], state["layers"]

    def _commit(self, layers: list[dict], batches: int) -> None:
        fs, _ = hadoop_path(self.spark, self.path)
        new = f"{self.path}/new-{uuid.uuid4().hex}"
        write_text(self.spark, new, json.dumps({"batches": batches, "layers": layers}))
        if not fs.rename(hadoop_path(self.spark, new)[1], hadoop_path(self.spark, f"{self.path}/manifest-{self.version + 1}")[1]):
            raise OSError("the manifest can't be moved")
        gone = [x["name"] for x in self.layers if x["name"] not in {y["name"] for y in layers}]
        self.version, self.batches, self.layers = self.version + 1, batches, layers
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")
        if self.version > 2 and exists(self.spark, f"{self.path}/manifest-{self.version - 2}"):
            remove(self.spark, f"{self.path}/manifest-{self.version - 2}")

    def _prints(self, layer: dict) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/{layer['name']}/prints")

    def _write(self, prints: DataFrame, count: int) -> dict:
        """A layer of the fingerprint rows (STORED)."""
        layer = {"name": f"layer-{uuid.uuid4().hex}", "prints": count, "bucket_bits": max(0, math.ceil(math.log2(max(1, count / self.bucket_rows)))), "filter_bits": max(0, math.ceil(math.log2(max(1, 2 * count / FILTER_PRINTS))))}
        root = f"{self.path}/{layer['name']}"
        placed = prints.select(*STORED).withColumn("bucket", F.pmod(F.xxhash64("kind", "print"), F.lit(1 << layer["bucket_bits"])).cast("int"))
        placed.repartition(1 << layer["bucket_bits"], "bucket").sortWithinPartitions("bucket", "kind", "print").write.partitionBy("bucket").parquet(f"{root}/prints")
        rows = filed(self._prints(layer).select("kind", "print"), self.n).select(_range_of(F.col("at"), layer["filter_bits"]).alias("block"), "kind", "print")
        rows.repartition("block").sortWithinPartitions("block").mapInPandas(build_filters, "block bigint, bits binary").write.parquet(f"{root}/filters")
        return layer

    def screened(self, values: DataFrame) -> DataFrame:
        """(kind, print, variant): fingerprints of the values, and of each the ones within a bit that the filters may hold."""
        asked = filed(fingerprints(values, self.n), self.n)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bits = max(1, math.ceil(math.log2(parts)))
        hot = heavy_keys(asked, "at")
        salt = F.when(F.col("at").isin(hot), F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int")) if hot else F.lit(None)
        asked = asked.select(_range_of(F.col("at"), bits).alias("part"), F.coalesce(salt, F.lit(0)).alias("salt"), "at", F.lit(1).alias("asked"), F.lit(None).cast("int").alias("layer"), F.lit(None).cast("binary").alias("bits"), "kind", "print", "half")
        hot_parts = sorted({(h >> (64 - bits)) + (1 << (bits - 1)) for h in hot})
        none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("print", "bigint"), ("half", "int"))]
        for i, layer in enumerate(self.layers):
            b = layer["filter_bits"]
            wide, narrow = max(0, bits - b), max(0, b - bits)  # a small layer's filter serves several parts
            rows = self.spark.read.schema("block bigint, bits binary").parquet(f"{self.path}/{layer['name']}/filters")
            rows = rows.select("block", "bits", F.explode(F.sequence(F.lit(0), F.lit((1 << wide) - 1))).alias("k")).withColumn("part", F.shiftright("block", narrow) * (1 << wide) + F.col("k"))
            salts = F.when(F.col("part").isin(hot_parts), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot_parts else F.array(F.lit(0))
            start = _start(F.col("part"), bits) if wide else _start(F.col("block"), b)
            asked = asked.unionByName(rows.select("part", F.explode(salts).alias("salt"), start.alias("at"), F.lit(0).alias("asked"), F.lit(i).alias("layer"), "bits", *none))
        sizes = _halves(self.n)
        ordered = asked.repartition(parts, "part", "salt").sortWithinPartitions("part", "salt", "at", "asked")
        return ordered.mapInPandas(lambda batches: _screen(batches, sizes), "kind int, print bigint, variant bigint")

    def lookup(self, screened: DataFrame) -> DataFrame:
        """The stored rows (STORED) of the folders that the variants fall into; no other folder is read."""
        most = max(x["bucket_bits"] for x in self.layers)
        touched = {0}
        if most:
            touched = {r[0] for r in screened.select(F.pmod(F.xxhash64("kind", "variant"), F.lit(1 << most)).cast("int").alias("b")).distinct().collect()}  # a number a folder at most
        read = [self._prints(x).where(F.col("bucket").isin(sorted({t & ((1 << x["bucket_bits"]) - 1) for t in touched}))).select(*STORED) for x in self.layers]
        return reduce(DataFrame.unionByName, read)

    def known(self, values: DataFrame) -> DataFrame:
        """(value) of those near to an accepted one of an earlier run, each once."""
        found = self._known(values) if self.layers else None
        return values.select("value").where("false") if found is None else found.distinct()

    def _known(self, values: DataFrame) -> DataFrame | None:
        """known, some of them repeatedly; None if there are none."""
        found, n = _kept(self.screened(values))
        if not n:
            return None
        wanted = found.select("kind", F.col("variant").alias("print"))
        held, n = _kept(self.lookup(found).join(wanted, ["kind", "print"], "left_semi").withColumn("value", F.lit(0)))
        if not n:
            return None
        hot = None
        if n > HOT:
            hot, many = _kept(held.groupBy("kind", "print").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("kind", "print"))
            hot = hot if many else None
        looked = fingerprints(values, self.n).join(found, ["kind", "print"]).select(*VALUE, F.col("variant").alias("print"))
        return near(looked, held, hot, self.n, self.distance)

    def ingest(self, values: DataFrame) -> DataFrame:
        """VALUE rows accepted of a durable batch of distinct values (kind, value, run_no, w0..w3); the store then holds them.

        ``value`` is whatever tells the batch's values apart. An empty batch accepts nothing. Values
        of one run, even in different batches, aren't held against each other.
        """
        fresh = values.select(*VALUE)
        if self.layers and (known := self._known(values)) is not None:
            fresh = durable(fresh.join(known, "value", "left_anti").select(*VALUE))
        down = fallen(fresh, self.distance)
        accepted, count = _kept(fresh if down is None else fresh.join(down, "value", "left_anti").select(*VALUE))
        layers = self.layers + ([self._write(fingerprints(accepted, self.n), count * self.n)] if count else [])
        self._commit(layers, self.batches + 1)
        self.compact()
        return accepted

    def compact(self) -> None:
        """Merges layers of like size, ``fanout`` or more of them, until there are none: a fingerprint is rewritten as often as the logarithm of the store's size."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for x in self.layers:
                tiers.setdefault(int(math.log(max(1, x["prints"]), self.fanout)), []).append(x)
            full = next((t for t in tiers.values() if len(t) >= self.fanout), None)
            if full is None:
                return
            rows = reduce(DataFrame.unionByName, (self._prints(x).select(*STORED) for x in full))
            merged = self._write(rows, sum(x["prints"] for x in full))
            self._commit([x for x in self.layers if x not in full] + [merged], self.batches)

    def drop(self) -> None:
        """Removes the store's folder."""
        remove(self.spark, self.path)


def _start(number: Column, bits: int) -> Column:
    """The first hash of the numbered one of 2^bits ranges."""
    least = F.lit(-(1 << 63)).cast("bigint")
    return least if not bits else F.shiftleft((number - (1 << (bits - 1))).cast("bigint"), 64 - bits)


def arrivals(hashes: DataFrame, modified_images: DataFrame, run_images: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, kind, run_no, w0..w3) of the whole 256-bit hashes that have a run, numbered in the order of (timestamp, id).

    A hash's run is the first that lists its image; runs without a timestamp, and hashes without
    a run, are left out.
    """
    dated = runs.where("timestamp is not null and id is not null").select(F.col("id").alias("run_id"), "timestamp").distinct()
    dated = numbered(dated, ["timestamp", "run_id"], "run_no")
    seen = run_images.where("image_id is not null").select("run_id", "image_id").join(dated, "run_id").groupBy("image_id").agg(F.min("run_no").alias("run_no"))
    variants = modified_images.where("id is not null and image_id is not null").select(F.col("id").alias("mod_image_id"), "image_id").join(seen, "image_id").groupBy("mod_image_id").agg(F.min("run_no").alias("run_no"))
    whole = hashes.where((F.col("nbits") == BITS) & F.col("words").isNotNull() & (F.size("words") == BITS // 64) & F.col("hashing_method_id").isNotNull())
    whole = whole.select("id", F.col("hashing_method_id").cast("int").alias("kind"), "mod_image_id", *(F.get("words", i).alias(f"w{i}") for i in range(BITS // 64)))
    return whole.join(variants, "mod_image_id").select("id", "kind", "run_no", "w0", "w1", "w2", "w3")


def deduplicate(rows: DataFrame, store: FingerprintStore, batches: int = BATCHES, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(id) of the rows of ``arrivals`` that repeat or nearly repeat a hash accepted from an earlier run.

    The rows come in as ``batches`` batches, or as many more as keep a batch below about
    ``batch_rows``, in the order of their runs; a run that is larger than a batch is cut. Of equal
    hashes the first run's decide; those of later runs always repeat. The result doesn't depend on
    the batches.
    """
    place = F.col("run_no") + F.pmod(F.xxhash64("kind", "w0", "w1", "w2", "w3"), F.lit(1 << 20)) / F.lit(1 << 20)
    rows, n = _kept(rows.withColumn("place", place))
    batches = max(batches, -(-n // batch_rows))
    cuts = sorted(set(rows.approxQuantile("place", [i / batches for i in range(1, batches)], 0.2 / batches))) if batches > 1 else []
    taken = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("place") > low)
        if high is not None:
            batch = batch.where(F.col("place") <= high)
        values = batch.groupBy("kind", "w0", "w1", "w2", "w3").agg(F.min("run_no").alias("run_no")).withColumn("value", F.monotonically_increasing_id())
        accepted = store.ingest(durable(values))
        taken = accepted if taken is None else taken.unionByName(accepted)
    same = ["kind", "run_no", "w0", "w1", "w2", "w3"]
    rows = rows.select("id", *same).withColumn("key", F.xxhash64(*same))
    first = taken.select(F.xxhash64(*same).alias("key"), *(F.col(c).alias(f"_{c}") for c in same))
    both = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{c}") for c in same))
    return salted_join(rows, first, "key", heavy_keys(rows, "key"), "left_anti", both).select("id")

"""All unique pairs of the hashes of one method, by Hamming distance.

One method is one key, so the pairs are cut into tiles: each hash belongs to one of B blocks of
its method; a tile holds two blocks. Inside a tile the distances come from packed words. Most
questions about the pairs (histograms, counts, the nearest) are answered in the tile, and the pairs
themselves are never written.

A histogram needs no ids, so each block is packed into one row and written once, and the tiles are
made by reading blocks against each other: nothing is written B times. Equal hashes are in one block,
where each different one is compared once and counted as often as it is there. Where ids come out
(tiles()), each hash goes to the B pairs of blocks it takes part in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.errors import HashesNotEqualLength, NotEnoughHashes
from hashloom.functions.bits import hash_len
from hashloom.runtime import durable

#: Hashes in a block, about: a tile holds twice as many, whatever the table's size.
BLOCK = 4096
#: The same where the pairs themselves leave the tile: at most its square, some 25 MB.
PAIR_BLOCK = 1024
ROWS = 512
#: Rows of a slice whose words are compared at once: they stay in the processor's cache.
AT_ONCE = 64
#: Rows of a block, about, as a multiple of its different hashes; a hash that alone has more is spread by id.
REPEATS = 8
#: Different numbers of repeats in a block; where there are more, powers of two stand for them.
TIMES = 12
#: Pairs of the same truth whose distances are taken at once.
SAME_AT_ONCE = 1 << 18


def method_counts(hashes: DataFrame, method: str = "hashing_method_id") -> DataFrame:
    """(method, n, status): ready with two hashes or more, else not_enough. Hashes without words don't count."""
    counts = hashes.groupBy(method).agg(F.count("words").alias("n"))
    return counts.withColumn("status", F.when(F.col("n") > 1, "ready").otherwise("not_enough"))


def require_enough(hashes: DataFrame, method: str = "hashing_method_id") -> None:
    """Raises NotEnoughHashes for the first method that can't be matched."""
    short = method_counts(hashes, method).where("n < 2").orderBy(method).first()
    if short:
        raise NotEnoughHashes(short[0], short["n"])


def require_equal_lengths(hashes: DataFrame, method: str = "hashing_method_id") -> None:
    """Raises HashesNotEqualLength for the first method whose hashes differ in length."""
    ends = hashes.where("words is not null").groupBy(method).agg(F.min("nbits").alias("low"), F.max("nbits").alias("high"))
    row = ends.where("low < high").orderBy(method).first()
    if row:
        raise HashesNotEqualLength(row["low"], row["high"])


def unequal_lengths(hashes: DataFrame, method: str = "hashing_method_id") -> DataFrame:
    """(method, pairs): pairs that matching leaves out because the lengths differ."""
    per = hashes.where("words is not null").groupBy(method, "nbits").agg(F.count(F.lit(1)).alias("n"))
    both = per.groupBy(method).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return both.select(method, ((F.col("all") * F.col("all") - F.col("same")) / 2).cast("bigint").alias("pairs"))


def tiles(hashes: DataFrame, truth: str | None = None, block: int = BLOCK) -> DataFrame:
    """Each hash once for every tile it takes part in: method, length, t1, t2, own (its block), id, words, truth.

    The number of blocks of a kind (method and length) follows its number of hashes; a block holds
    about ``block`` of them, so a tile fits in a task at any size.
    """
    rows = hashes.where("words is not null").select(F.col("id"), F.col("hashing_method_id"), F.col("nbits"), F.col("words"), (F.col(truth) if truth else F.lit(None)).cast("bigint").alias("truth"))
    sizes = rows.groupBy("hashing_method_id", "nbits").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes.where("blocks > 0")), ["hashing_method_id", "nbits"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("hashing_method_id", "nbits", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "id", "words", "truth")


def _over_tile(pdf: pd.DataFrame, each: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], None]) -> None:
    """Calls each(left rows, right rows, distances, wanted) for slices of the tile; every unordered pair of ids is wanted once."""
    pdf = pdf.sort_values("id", kind="stable")
    same = pdf["t1"].iloc[0] == pdf["t2"].iloc[0]
    left = pdf[pdf["own"] == pdf["t1"].iloc[0]]
    right = left if same else pdf[pdf["own"] == pdf["t2"].iloc[0]]
    if not len(left) or not len(right):
        return
    a, b = (np.ascontiguousarray(np.stack(x["words"].to_numpy()).astype(np.int64).view(np.uint64).T) for x in (left, right))
    for start in range(0, len(left), ROWS):
        part = slice(start, min(start + ROWS, len(left)))
        d = np.zeros((part.stop - part.start, len(right)), np.int32)
        for word in range(len(a)):
            d += np.bitwise_count(a[word, part, None] ^ b[word][None, :])
        wanted = np.ones(d.shape, bool) if not same else np.arange(len(right))[None, :] > np.arange(part.start, part.stop)[:, None]
        each(left.iloc[part], right, d, wanted)


def _packed(hashes: DataFrame, truth: str | None, block: int) -> DataFrame | None:
    """A row a block: its kind, its number and the last one of its kind, and the hashes' words and truths, those with a truth first and by it. None without hashes."""
    rows = hashes.where("words is not null").select(F.col("hashing_method_id"), F.col("nbits"), F.col("id"), F.col("words"), (F.col(truth) if truth else F.lit(None)).cast("bigint").alias("truth"))
    rows = rows.withColumn("value", F.xxhash64("words"))
    each = rows.where("hashing_method_id is not null and nbits is not null").groupBy("hashing_method_id", "nbits", "value").agg(F.count(F.lit(1)).alias("n"))
    hot = F.collect_list(F.when(F.col("n") > REPEATS * block, F.col("value")))
    sizes = each.groupBy("hashing_method_id", "nbits").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), hot.alias("hot")).orderBy("hashing_method_id", "nbits").collect()
    kinds, total = [], 0
    for kind in sizes:
        blocks = max(-(-kind["values"] // block), -(-kind["n"] // (REPEATS * block)))
        kinds.append((kind["hashing_method_id"], kind["nbits"], blocks, total, total + blocks - 1, kind["hot"]))
        total += blocks
    if not kinds:
        return None

    sizes = hashes.sparkSession.createDataFrame(kinds, "hashing_method_id int, nbits int, blocks int, first int, last int, hot array<bigint>")
    key = F.when(F.array_contains("hot", F.col("value")), F.xxhash64("id", "truth")).otherwise(F.col("value"))
    rows = rows.join(F.broadcast(sizes), ["hashing_method_id", "nbits"]).withColumn("block", (F.pmod(key, F.col("blocks")) + F.col("first")).cast("int"))
    cores = hashes.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(math.sqrt(2 * cores)), math.ceil(1.5 * math.sqrt(total)))  # tiles are made in the square of these
    known = rows.select("hashing_method_id", "nbits", "block", "last", "words", F.coalesce("truth", F.lit(0).cast("bigint")).alias("truth"), F.col("truth").isNotNull().alias("known"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["truth"].to_numpy(np.int64), ~pdf["known"].to_numpy(bool)))
        words = np.stack(pdf["words"].to_numpy()).astype("<i8")[order]
        truths = pdf["truth"].to_numpy("<i8")[order[: int(pdf["known"].sum())]]
        return pdf[["hashing_method_id", "nbits", "block", "last"]].head(1).assign(width=words.shape[1], words=[words.T.tobytes()], truth=[truths.tobytes()])

    return durable(known.repartition(parts, "block").groupBy("block").applyInPandas(pack, "hashing_method_id int, nbits int, block int, last int, width int, words binary, truth binary"))


def _by_repeats(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(times, words): the different columns of words, by how often each is there; a number of times may be put together from powers of two."""
    words = words[:, np.lexsort(words)]
    first = np.flatnonzero(np.r_[True, (words[:, 1:] != words[:, :-1]).any(axis=0)])
    times, words = np.diff(np.r_[first, words.shape[1]]), words[:, first]
    counts = np.unique(times)
    if len(counts) > TIMES:
        groups = ((1 << k, times >> k & 1 == 1) for k in range(int(counts[-1]).bit_length()))
    else:
        groups = ((int(n), times == n) for n in counts)
    return [(n, np.ascontiguousarray(words[:, those])) for n, those in groups if those.any()]


def _distances_seen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often each distance is seen between the columns of a and those of b (words, hashes), of all bits that the words have."""
    bits = 64 * len(a)
    seen = np.zeros(bits + 1, np.int64)
    small = bits <= 256  # a distance of 256 is kept as 0 then, and found by its last word
    n, m = a.shape[1], b.shape[1]
    x, ones, d = np.empty((AT_ONCE, m), np.uint64), np.empty((AT_ONCE, m), np.uint8), np.empty((min(n, ROWS), m), np.uint8 if small else np.int32)
    for start in range(0, n, ROWS):
        end = min(start + ROWS, n)
        for first in range(start, end, AT_ONCE):
            k = min(AT_ONCE, end - first)
            out = d[first - start : first - start + k]
            for w in range(len(a)):
                np.bitwise_xor(a[w, first : first + k, None], b[w][None, :], out=x[:k])
                if w:
                    out += np.bitwise_count(x[:k], out=ones[:k])
                else:
                    out[:] = np.bitwise_count(x[:k], out=ones[:k])
            if bits == 256 and not out.all():
                whole = int(((out == 0) & (ones[:k] == 64)).sum())
                seen[0] -= whole
                seen[256] += whole
        flat = d[: end - start].ravel()
        if not small or len(flat) < 1 << 17:
            seen += np.bincount(flat, minlength=bits + 1)
            continue
        pairs = np.bincount(flat[: len(flat) // 2 * 2].view(np.uint16), minlength=1 << 16).reshape(256, 256)  # two distances are counted at a time
        both = pairs.sum(axis=0) + pairs.sum(axis=1)
        if len(flat) % 2:
            both[flat[-1]] += 1
        seen[:256] += both[: bits + 1]
    return seen


def _same_seen(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Like _distances_seen, of the pairs with the same truth: x and y are the truths of the first columns, in order."""
    seen = np.zeros(64 * len(a) + 1, np.int64)
    low = np.searchsorted(y, x)
    upto = np.cumsum(np.searchsorted(y, x, side="right") - low)
    total = int(upto[-1]) if len(upto) else 0
    for start in range(0, total, SAME_AT_ONCE):
        pair = np.arange(start, min(start + SAME_AT_ONCE, total))
        i = np.searchsorted(upto, pair, side="right")
        j = low[i] + pair - np.where(i > 0, upto[i - 1], 0)
        seen += np.bincount(sum(np.bitwise_count(a[w, i] ^ b[w, j]).astype(np.int32) for w in range(len(a))), minlength=len(seen))
    return seen


def _count_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of two blocks of a kind to the number of their pairs by distance and truth."""
    counts: dict[tuple[int, int], np.ndarray] = {}
    held: dict[int, list[tuple[int, np.ndarray]]] = {}  # of the blocks that this task holds against each other
    for batch in batches:
        for t in batch.itertuples(index=False):
            a, b = (np.frombuffer(words, "<u8").reshape(t.width, -1) for words in (t.words, t.words2))
            x, y = (np.frombuffer(truth, "<i8") for truth in (t.truth, t.truth2))
            for block, words in ((t.block, a), (t.block2, b)):
                if block not in held:
                    held[block] = _by_repeats(words)
            pairs = sum(n * m * _distances_seen(p, q) for n, p in held[t.block] for m, q in held[t.block2])
            same = _same_seen(a, b, x, y)
            if t.block == t.block2:  # each pair was seen twice, and each hash with itself
                pairs[0] -= a.shape[1]
                same[0] -= len(x)
                pairs, same = pairs // 2, same // 2
            seen = counts.setdefault((t.hashing_method_id, t.nbits), np.zeros((2, len(pairs)), np.int64))
            seen[0] += pairs - same
            seen[1] += same
    for (method, nbits), seen in counts.items():
        same, distance = np.nonzero(seen)
        yield pd.DataFrame({"hashing_method_id": method, "nbits": nbits, "hamming_distance": distance, "same": same.astype(bool), "pairs": seen[same, distance]})


def pair_histogram(hashes: DataFrame, truth: str | None = None, block: int = BLOCK) -> DataFrame:
    """(hashing_method_id, nbits, hamming_distance, same, pairs): unique pairs of equal length, counted.

    ``truth`` names a bigint column; a pair is the same if both have it and it is equal. A null id
    takes part like any other. Methods with fewer than two hashes have no row. The blocks are written
    once; a task holds some of them against some others, so disk follows the hashes, not their pairs,
    and time follows the pairs of different hashes.
    """
    schema = "hashing_method_id int, nbits int, hamming_distance int, same boolean, pairs bigint"
    blocks = _packed(hashes, truth, block)
    if blocks is None:
        return hashes.sparkSession.createDataFrame([], schema)
    others = blocks.select(F.col("block").alias("block2"), F.col("words").alias("words2"), F.col("truth").alias("truth2"))
    # Not by an equal key, which would bring a method to one task and its blocks to disk for every tile.
    tile = blocks.hint("shuffle_replicate_nl").join(others, (F.col("block2") >= F.col("block")) & (F.col("block2") <= F.col("last")))
    parts = tile.mapInPandas(_count_tiles, schema)
    return parts.groupBy("hashing_method_id", "nbits", "hamming_distance", "same").agg(F.sum("pairs").alias("pairs"))


def partner_summary(hashes: DataFrame, within: int, block: int = BLOCK) -> DataFrame:
    """(id, partners, sum_distance, nearest, links): of every hash, over all its unique pairs.

    links counts the partners at most ``within`` bits away. A hash without a partner has no row.
    """

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []

        def each(left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray, wanted: np.ndarray) -> None:
            far = np.where(wanted, d, 1 << 30)
            for rows, axis in ((left, 1), (right, 0)):
                out.append(pd.DataFrame({"id": rows["id"].to_numpy(), "partners": wanted.sum(axis=axis), "sum_distance": np.where(wanted, d, 0).sum(axis=axis, dtype=np.int64), "nearest": far.min(axis=axis), "links": (far <= within).sum(axis=axis)}))

        _over_tile(pdf, each)
        if not out:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id", "partners", "sum_distance", "nearest", "links")})
        return pd.concat(out).groupby("id", as_index=False).agg({"partners": "sum", "sum_distance": "sum", "nearest": "min", "links": "sum"})

    parts = tiles(hashes, None, block).groupBy("hashing_method_id", "nbits", "t1", "t2").applyInPandas(sums, "id bigint, partners bigint, sum_distance bigint, nearest int, links bigint")
    total = parts.groupBy("id").agg(F.sum("partners").alias("partners"), F.sum("sum_distance").alias("sum_distance"), F.min("nearest").alias("nearest"), F.sum("links").alias("links"))
    return total.where("partners > 0")


def unique_pairs(hashes: DataFrame, rendering: str = "bits", within: float | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """(hash1_id, hash2_id, hamming_distance, hash_len, hashing_method_id): every unique pair, hash1_id < hash2_id.

    Pairs of unequal length are left out. The result grows with the square of the hashes of a
    method; ``within`` keeps only the pairs below that relative distance, which the tile drops
    slice by slice before they leave it.
    """

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        nbits = int(pdf["nbits"].iloc[0])

        def each(left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray, wanted: np.ndarray) -> None:
            if within is not None:
                wanted = wanted & (d < within * nbits)
            i, j = np.nonzero(wanted)
            x, y = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
            out.append(pd.DataFrame({"hash1_id": np.minimum(x, y), "hash2_id": np.maximum(x, y), "hamming_distance": d[i, j]}))

        _over_tile(pdf, each)
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("hash1_id", "hash2_id", "hamming_distance")})
        return (pd.concat(out) if out else empty).assign(nbits=nbits, hashing_method_id=pdf["hashing_method_id"].iloc[0])

    found = tiles(hashes, None, block).groupBy("hashing_method_id", "nbits", "t1", "t2").applyInPandas(pairs, "hash1_id bigint, hash2_id bigint, hamming_distance int, nbits int, hashing_method_id int")
    return found.select("hash1_id", "hash2_id", "hamming_distance", hash_len(F.col("nbits"), rendering).alias("hash_len"), "hashing_method_id")

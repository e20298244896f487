"""Filling fixed-capacity containers with items, by hierarchical multi-length packing.

Items are routed to tiers by their size: a tier is a window length, and takes the items that fit its
windows and not the next shorter ones. Tier by tier, the longest first, the tier's own items open
windows, and the gaps are filled with items of the same and of shorter tiers; where that leaves more
unused than a longer window would, a longer window is opened instead. Each window length
divides the next, so the windows of all tiers, in the order of their lengths, fill the containers
without a gap of their own.

Sizes are whole numbers up to the capacity, so how many items of each size there are says all that
the packing needs to know: the driver packs this table of at most ``capacity`` counts, never the
items. Each window's layout is made for as many windows at once as the counts allow. The items then
find their window by their rank among the items of equal size, in parallel.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.runtime import spread

CAPACITY = 2048
#: The shortest window is the capacity halved so many times, where it can be.
HALVINGS = 3
SALTS = 128
STEP = 8


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, tokens) of the documents with a non-empty text; special tokens' strings are ordinary text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64
        import importlib.util
        import pathlib

        import tiktoken

        spec = importlib.util.spec_from_file_location("_tokenizers", f"{tokenizer_dir}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, pathlib.Path(tokenizer_dir, vocabulary).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("length(text) > 0")
    return spread(source).mapInPandas(count, "doc_id bigint, tokens bigint")


def tier_lengths(capacity: int, halvings: int = HALVINGS) -> list[int]:
    """Window lengths from short to long: the capacity and its halves, as long as they are whole."""
    lengths = [capacity]
    while len(lengths) <= halvings and lengths[0] % 2 == 0:
        lengths.insert(0, lengths[0] // 2)
    return lengths


def _window(left: dict[int, int], sizes: list[int], length: int, least: int) -> dict[int, int]:
    """The layout of a window: the largest item opens it, the gap is filled with the largest that fit, of this and shorter tiers."""
    layout, gap, top = {}, length, len(sizes)
    while gap and (top := bisect.bisect_right(sizes, gap, 0, top)):
        s = sizes[top - 1]
        u = min(gap // s, left[s])
        # a gap left at the end is closed by two sizes that fill it exactly, where there are such
        if layout and gap - u * s and gap <= 2 * least + 2 and gap not in left:
            pair = next((a for a in reversed(sizes[:top]) if 2 * a >= gap and a not in layout and (gap - a) in left and gap - a not in layout and gap - a != a), None)
            if pair:
                layout[pair] = layout[gap - pair] = 1
                break
        layout[s], gap, top = u, gap - u * s, top - 1
    return layout


def pack_counts(counts: dict[int, int], capacity: int, tiers: list[int] | None = None) -> list[tuple[int, int, dict[int, int]]]:
    """Layouts as (number of windows, window length, {size: items of that size}) that use up the counts, all sizes from 1 to capacity.

    ``tiers`` are the window lengths from short to long; each divides the next, the last is the capacity.
    """
    tiers = tiers or tier_lengths(capacity)
    if tiers[-1] != capacity or any(b % a or a >= b for a, b in zip(tiers, tiers[1:], strict=False)):
        raise ValueError("each window length divides the next, the last is the capacity")
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    layouts = []
    for k in reversed(range(len(tiers))):
        least = tiers[k - 1] if k else 0
        while sizes and sizes[-1] > least:
            # a longer window is opened where it is filled better, as where one odd size is all there is
            tried = [(length, _window(left, sizes, length, least)) for length in tiers[k:]]
            length, layout = min(tried, key=lambda x: (x[0] - sum(s * u for s, u in x[1].items())) / x[0])
            many = min(left[s] // u for s, u in layout.items())
            layouts.append((many, length, layout))
            for s, u in layout.items():
                left[s] -= many * u
                if not left[s]:
                    del left[s]
                    del sizes[bisect.bisect_left(sizes, s)]
    return layouts


def _slots(layouts: list[tuple[int, int, dict[int, int]]], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """For each layout and size the first rank it takes, and where its windows begin; long windows first, then by falling cost, so that steps can be balanced."""
    ordered = sorted(layouts, key=lambda x: (-x[1], -sum(u * s * s for s, u in x[2].items()), sorted(x[2].items())))
    used: dict[int, int] = {}
    rows, begin = [], 0
    for many, length, layout in ordered:
        at = 0
        for s in sorted(layout, reverse=True):
            u = layout[s]
            rows.append((s, used.get(s, 0), u, begin, at, length))
            used[s] = used.get(s, 0) + many * u
            at += u * s
        begin += many * length
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return {c: table[:, i] for i, c in enumerate(("size", "first", "each", "begin", "at", "length"))}, -(-begin // capacity)


def pack(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY, tiers: list[int] | None = None, salts: int | None = None, step: int = STEP) -> DataFrame:
    """(item_id, piece, n, container, start, step_group, tier, window): a place for every item.

    tier is the length that the item was routed to, window the one of the window it lies in: longer
    than its tier where the item fills a gap.

    Only an item larger than the capacity is split: into full containers and a remainder that is
    packed like an item. Items of null, zero or negative size have no place. Items with equal ids
    are packed one by one. Ties in rank go by item id, piece and a hash; equal rows are
    interchangeable. step_group numbers groups of at most ``step`` containers with balanced cost
    (sum of squared sizes). An empty table has no containers.

    items is read three times (size, count, rank): hand in a table or a durable result. Ranks are
    counted within ``salts`` parts of each size, by default so many that a part has some 100,000
    items; the driver gets a count a size and part.
    """
    lengths = tiers or tier_lengths(capacity)
    if salts is None:
        salts = max(SALTS, -(-items.count() // (100_000 * 16)))
    parts = items.where(F.col(size) > 0).select(F.col(item_id).alias("item_id"), F.explode(F.sequence(F.lit(0), ((F.col(size) - 1) / capacity).cast("int"))).alias("piece"), F.col(size).cast("bigint").alias("whole"))
    parts = parts.select("item_id", "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("int").alias("n")).withColumn("salt", F.pmod(F.xxhash64("item_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = parts.groupBy("n", "salt").agg(F.count(F.lit(1)).alias("many"))
    counted = by_salt.collect()  # at most capacity x salts rows
    counts: dict[int, int] = {}
    offsets = []
    for r in sorted(counted, key=lambda r: (r["n"], r["salt"])):
        offsets.append((r["n"], r["salt"], counts.get(r["n"], 0)))
        counts[r["n"]] = counts.get(r["n"], 0) + r["many"]
    slots, containers = _slots(pack_counts(counts, capacity, lengths), capacity)
    steps = max(1, -(-containers // step))
    shift = 44  # ranks below 2^44, sizes above
    keys = (slots["size"] << shift) + slots["first"]
    offset_keys, offset_values = np.array([n * salts + s for n, s, _ in offsets], dtype=np.int64), np.array([o for *_, o in offsets], dtype=np.int64)

    ends = np.array(lengths, dtype=np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(np.int64)
            rank = b["rank"].to_numpy(np.int64) - 1 + offset_values[np.searchsorted(offset_keys, n * salts + b["salt"].to_numpy(np.int64))]
            k = np.searchsorted(keys, (n << shift) + rank, "right") - 1
            within = rank - slots["first"][k]
            begin = slots["begin"][k] + within // slots["each"][k] * slots["length"][k] + slots["at"][k] + within % slots["each"][k] * n
            container = begin // capacity
            turn, pos = container // steps, container % steps
            yield pd.DataFrame({"item_id": b["item_id"], "piece": b["piece"], "n": b["n"], "container": container, "start": begin % capacity, "step_group": np.where(turn % 2 == 0, pos, steps - 1 - pos), "tier": ends[np.searchsorted(ends, n)], "window": slots["length"][k]})

    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("n", "salt").orderBy("item_id", "piece")))
    return ranked.mapInPandas(place, f"item_id {items.schema[item_id].dataType.simpleString()}, piece int, n int, container bigint, start bigint, step_group bigint, tier int, window int")

"""Evaluation texts leaking into training text, by suffix arrays of the training text.

A shard is as many whole documents as hold SHARD_WORDS words. Its suffix array orders every place
in it by all the words that follow up to the document's end. The shards are built once and kept in
a folder; any later test set is searched in them, and the training text isn't read again: every
suffix of every test item is looked up by binary search, each hit is extended to the longest
verbatim match, and its place is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.words import words
from hashloom.runtime import durable, exists, remove, spread

LEAST = 12
SHARD_WORDS = 1 << 19
#: Test items are held against the shards in blocks of about so many words, which bounds what is sent to a task and kept on the driver.
BLOCK_WORDS = 1 << 20
#: Hits that are extended at once.
SLICE = 1 << 18
PASSAGES = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint"
_SHARD = "vocabulary binary, text binary, suffixes binary, doc_ids array<bigint>, starts array<int>"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of a text of word numbers in the order of what follows them; 0 ends a document, and no two ends are equal.

    Prefix doubling: places are ordered by their next three words, then those that are still equal
    by twice as many, and so on until none are; long passages that occur twice take more rounds,
    for their places only.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    base = int(rank.max(initial=0)) + 1
    far = np.concatenate([rank, np.zeros(2, np.int64)])
    key = rank * base + far[1 : n + 1]
    if base < 1 << 21:
        key, reach = key * base + far[2 : n + 2], 3
    else:
        reach = 2
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[order] = group
    alone = heads & np.concatenate([heads[1:], [True]]) if n else heads
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        key = (rank[at] << 32) | rank[at + reach]
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[slots] = at
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(heads, slots, 0))
        slots = slots[~(heads & np.concatenate([heads[1:], [True]]))]
        reach *= 2
    return order


def shard_of(ids: list, tokens: list[list[str]], least: int = LEAST) -> pd.DataFrame:
    """One row: the words' numbers, the text in them, the places with ``least`` words or more before their document's end in suffix order, and where the documents begin."""
    numbers: dict[str, int] = {}
    coded = [[numbers.setdefault(w, len(numbers) + 1) for w in t] for t in tokens]
    starts = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1]
    text = np.array([x for c in coded for x in (*c, 0)], np.int32)
    ends = np.flatnonzero(text == 0)
    order = suffix_array(text)
    order = order[ends[np.searchsorted(ends, order)] - order >= least].astype(np.int32)
    return pd.DataFrame({"vocabulary": ["\n".join(numbers).encode()], "text": [text.tobytes()], "suffixes": [order.tobytes()], "doc_ids": [ids], "starts": [starts.astype(np.int32)]})


def _shards(batches: Iterator[pd.DataFrame], shard_words: int, least: int) -> Iterator[pd.DataFrame]:
    ids, tokens, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
            found = words(text)
            if len(found) < least:
                continue  # no passage fits into it
            ids.append(None if doc_id is pd.NA else int(doc_id))
            tokens.append(found)
            size += len(found) + 1
            if size >= shard_words:
                yield shard_of(ids, tokens, least)
                ids, tokens, size = [], [], 0
    if ids:
        yield shard_of(ids, tokens, least)


class TestSuffixes:
    """The suffixes, of ``least`` words or more, of a block of test items (id, words)."""

    __test__ = False

    def __init__(self, items: list[tuple], least: int = LEAST):
        self.least = least
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for _, t in items]
        self.text = np.array([x for c in coded for x in (*c, 0)] + [0] * least, np.int32)
        self.first = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1].astype(np.int64)
        lengths = np.array([len(c) for c in coded], np.int64)
        self.item = np.repeat(np.arange(len(coded)), np.maximum(0, lengths - least + 1))
        self.starts = np.concatenate([np.arange(f, f + max(0, n - least + 1)) for f, n in zip(self.first, lengths, strict=True)] or [np.zeros(0)]).astype(np.int64)
        windows = self.text[self.starts[:, None] + np.arange(least)] if len(self.starts) else np.zeros((0, least), np.int32)
        self.windows, self.window = np.unique(windows, axis=0, return_inverse=True)  # a passage that many items share is looked up once
        self.window = self.window.ravel()


def _bound(text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """In each interval of the suffix array the first place whose word at ``depth`` is at least (right: above) the given one."""
    lo, hi = lo.copy(), hi.copy()
    while (going := lo < hi).any():
        middle = (lo + hi) // 2
        here = text[order[np.minimum(middle, len(order) - 1)] + depth]
        up = going & ((here <= word) if right else (here < word))
        lo = np.where(up, middle + 1, lo)
        hi = np.where(going & ~up, middle, hi)
    return lo


def intervals(text: np.ndarray, order: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words the interval of the suffix array whose places begin with it; empty if there are none."""
    lo, hi = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    left = np.flatnonzero((windows >= 0).all(axis=1)) if len(order) else np.zeros(0, np.int64)
    a, b = np.zeros(len(left), np.int64), np.full(len(left), len(order), np.int64)
    for depth in range(windows.shape[1]):
        word = windows[left, depth]
        a, b = _bound(text, order, a, b, depth, word, False), _bound(text, order, a, b, depth, word, True)
        some = a < b
        left, a, b = left[some], a[some], b[some]
    lo[left], hi[left] = a, b
    return lo, hi


def search_shard(shard: pd.Series, tests: TestSuffixes, size: int = SLICE) -> Iterator[pd.DataFrame]:
    """Of each document of the shard and each item the longest match, as PASSAGES rows.

    Hits are extended ``size`` at a time, item by item, and only the best of each document is kept
    on, so memory doesn't grow with the number of hits.
    """
    names = bytes(shard["vocabulary"]).decode().split("\n")
    known = tests.vocabulary
    number = np.full(len(known) + 1, -1, np.int32)
    for i, name in enumerate(names, 1):
        if name in known:
            number[known[name]] = i
    number[0] = 0
    text, order = np.frombuffer(shard["text"], np.int32), np.frombuffer(shard["suffixes"], np.int32)
    lo, hi = intervals(text, order, number[tests.windows])
    hits = (hi - lo)[tests.window]
    asked = np.flatnonzero(hits)
    if not len(asked):
        return
    mine = number[tests.text]  # the items in the shard's numbers
    starts, ids = np.asarray(shard["starts"], np.int64), list(shard["doc_ids"])
    best = np.zeros((0, 5), np.int64)  # item, document, -length, place, place in the item
    total = np.cumsum(hits[asked])
    at, begun = 0, 0  # the test suffix, and how many of its hits are done
    while at < len(asked):
        done = total[at] - hits[asked[at]] + begun
        end = int(np.searchsorted(total, done + size, "left"))
        if end == at:  # one suffix with more hits than are extended at once
            some, first, n = asked[at : at + 1], np.array([begun]), np.array([min(size, hits[asked[at]] - begun)])
            begun += int(n[0])
            if begun == hits[asked[at]]:
                at, begun = at + 1, 0
        else:
            some = asked[at:end]
            first, n = np.zeros(len(some), np.int64), hits[some].copy()
            first[0], n[0] = begun, n[0] - begun
            at, begun = end, 0
        test = np.repeat(some, n)
        place = order[np.repeat(lo[tests.window[some]] + first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())].astype(np.int64)
        own = tests.starts[test]
        before, mine_before = text[place - 1], mine[own - 1]
        begins = (place == 0) | (own == 0) | (before <= 0) | (before != mine_before)  # else part of the match that begins one word earlier
        test, place, own = test[begins], place[begins], own[begins]
        length = np.full(len(place), tests.least)
        going = np.arange(len(place))
        while len(going):
            x, y = text[place[going] + length[going]], mine[own[going] + length[going]]
            going = going[(x == y) & (x > 0)]
            length[going] += 1
        item = tests.item[test]
        rows = np.column_stack([item, np.searchsorted(starts, place, "right") - 1, -length, place, own - tests.first[item]])
        rows = np.concatenate([best, rows])
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows
        last = tests.item[asked[at]] if at < len(asked) else -1
        best = rows[rows[:, 0] == last]
        yield _passages(rows[rows[:, 0] != last], tests, ids, starts)
    yield _passages(best, tests, ids, starts)


def _passages(rows: np.ndarray, tests: TestSuffixes, ids: list, starts: np.ndarray) -> pd.DataFrame:
    item, doc, length, place, own = rows.T
    number = lambda x: None if x is None or x != x else int(x)
    return pd.DataFrame({"doc_id": pd.array([number(ids[d]) for d in doc], dtype="Int64"), "item_id": pd.array([tests.ids[i] for i in item], dtype="Int64"), "doc_word": place - starts[doc], "item_word": own, "n_words": -length})


class TrainingSuffixes:
    """Suffix arrays of a training corpus, kept in a folder."""

    def __init__(self, spark: SparkSession, path: str, least: int = LEAST):
        self.spark, self.path, self.least = spark, path.rstrip("/"), least

    def built(self) -> bool:
        return exists(self.spark, f"{self.path}/_SUCCESS")

    def build(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> TrainingSuffixes:
        """One pass over the corpus. Whole texts are read, a document is never cut; null and empty texts are in no shard."""
        source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("length(text) > 0")
        least = self.least
        spread(source).mapInPandas(lambda batches: _shards(batches, shard_words, least), _SHARD).write.mode("overwrite").parquet(self.path)
        return self

    def search(self, items: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
        """PASSAGES: of each document and test item the longest common passage of ``least`` words or more.

        Of equally long passages the first in the document counts. Items with a null or shorter text
        match nothing; an id with several texts has a row for each; documents that occur twice come
        out twice; a null doc_id is kept. The items
        are cut into words in parallel and held against the shards block by block; a block's result
        is written before the next is fetched.
        """
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [words(t) for t in b["text"]]
                yield pd.DataFrame({"item_id": b["item_id"], "words": [" ".join(w) for w in found], "n": [len(w) for w in found]})

        source = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        tests = durable(source.mapInPandas(cut, "item_id bigint, words string, n bigint").where(F.col("n") >= self.least).distinct())
        total = tests.agg(F.sum("n")).first()[0] or 0
        blocks = max(1, -(-total // block_words))
        shards = self.spark.read.schema(_SHARD).parquet(self.path)
        tests = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
        out = None
        for k in range(blocks):
            block = TestSuffixes([(r["item_id"], r["words"].split(" ")) for r in tests.where(F.col("block") == k).select("item_id", "words").collect()], self.least)

            def held(batches: Iterator[pd.DataFrame], block: TestSuffixes = block) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for _, shard in b.iterrows():
                        yield from search_shard(shard, block)

            part = shards.mapInPandas(held, PASSAGES)
            part = durable(part) if blocks > 1 else part
            out = part if out is None else out.unionByName(part)
        return out

    def drop(self) -> None:
        remove(self.spark, self.path)


def without_leaks(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no test passage; those with a null id stay, since nothing names them."""
    return docs.join(passages.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")

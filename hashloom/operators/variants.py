"""Modified images and their hashes."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hashloom.functions import grids
from hashloom.registry import HashMethod, Modification

VARIANT = "image_id bigint, user string, modification_id int, h int, w int, px array<int>"
HASH = "image_id bigint, user string, modification_id int, hashing_method_id int, nbits int, hash binary, words array<bigint>"


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of one size together, with their pixels."""
    for (h, w), rows in pdf.groupby(["h", "w"], sort=True):
        yield rows, np.stack([np.asarray(p, dtype=np.int64) for p in rows["px"]]).reshape(len(rows), h, w)


def _tried(what: str, change: Callable[[np.ndarray], np.ndarray], px: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(places, results): what ``change`` makes of the batch; where it fails, of each image by itself, without those it fails on."""
    try:
        return np.arange(len(px)), change(px)
    except Exception as e:  # noqa: BLE001 - registered code may fail in any way
        logging.getLogger(__name__).warning("%s failed on a batch of %d, each image is tried by itself: %s", what, len(px), e)
    places, results = [], []
    for i in range(len(px)):
        try:
            results.append(change(px[i : i + 1]))
            places.append(i)
        except Exception as e:  # noqa: BLE001
            logging.getLogger(__name__).warning("%s failed, the image is skipped: %s", what, e)
    return np.array(places, dtype=np.int64), np.concatenate(results) if results else None


def modified(images: DataFrame, selected: list[tuple[int, Modification]]) -> DataFrame:
    """One row for each image and selected modification; the unmodified image is not among them.

    The pixels are decoded once for all modifications. No selection gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for rows, px in _batches(pdf):
                for i, m in selected:
                    at, out = _tried(m.name, m.apply, px)
                    if out is None:
                        continue
                    yield rows[["image_id", "user"]].iloc[at].assign(modification_id=i, h=out.shape[1], w=out.shape[2], px=list(out.reshape(len(out), -1).astype(np.int32)))

    return images.select("image_id", "user", "h", "w", "px").mapInPandas(run, VARIANT)


def hashed(variants: DataFrame, methods: list[tuple[int, HashMethod]]) -> DataFrame:
    """One row for each variant and method; the pixels stay behind. A variant without pixels has no hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for rows, px in _batches(pdf):
                for i, m in methods:
                    at, bits = _tried(m.name, m.bits, px)
                    if bits is None:
                        continue
                    data = grids.packed(bits)
                    yield rows[["image_id", "user", "modification_id"]].iloc[at].assign(hashing_method_id=i, nbits=m.nbits, hash=[d.tobytes() for d in data], words=list(grids.to_words(data)))

    return variants.mapInPandas(run, HASH)


def hash_variants(images: DataFrame, modifications: list[tuple[int, Modification]], methods: list[tuple[int, HashMethod]]) -> DataFrame:
    """modified and hashed in one pass: no variant's pixels leave the task.

    A modification or method that fails on an image loses that image's variant or hash only; the
    failure is logged where it happens.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for rows, px in _batches(pdf):
                for j, change in modifications:
                    done, out = _tried(change.name, change.apply, px)
                    if out is None:
                        continue
                    for i, m in methods:
                        at, bits = _tried(m.name, m.bits, out)
                        if bits is None:
                            continue
                        data = grids.packed(bits)
                        yield rows[["image_id", "user"]].iloc[done[at]].assign(modification_id=j, hashing_method_id=i, nbits=m.nbits, hash=[d.tobytes() for d in data], words=list(grids.to_words(data)))

    return images.select("image_id", "user", "h", "w", "px").mapInPandas(run, HASH)

"""Registered modifications and hashing methods; an entry's id is its position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hashloom.errors import HashingMethodNotFound, ModificationNotFound
from hashloom.functions import grids


@dataclass(frozen=True)
class Modification:
    """``apply`` maps a batch of grids to the modified batch."""

    name: str
    apply: Callable[[np.ndarray], np.ndarray]
    group: str | None = None

    @property
    def name_group(self) -> str:
        return self.group or self.name


@dataclass(frozen=True)
class HashMethod:
    """``bits`` maps a batch of grids to a row of bits each."""

    name: str
    nbits: int
    bits: Callable[[np.ndarray], np.ndarray]


def rotation(degrees: int) -> Modification:
    return Modification(f"rotate{degrees}", lambda px: grids.rotate(px, degrees))


def blurring(sigma: float = 0.9) -> Modification:
    """Named with its sigma, so that two blurs differ; both are of the group blur."""
    return Modification(f"blur{sigma:g}", lambda px: grids.blur(px, sigma), "blur")


def average_hash(size: int) -> HashMethod:
    return HashMethod(f"average_hash{size}", size * size, lambda px: grids.average_bits(px, size))


def vert_gradient(size: int) -> HashMethod:
    return HashMethod(f"vert_gradient{size}", size * size, lambda px: grids.vert_gradient_bits(px, size))


def gradient(size: int = 8) -> HashMethod:
    return HashMethod(f"gradient{size}", size * size, lambda px: grids.gradient_bits(px, size))


SIZES = (8, 16, 64, 256)


def default_modifications() -> list[Modification]:
    return [rotation(90), blurring(0.9)]


def default_methods() -> list[HashMethod]:
    return [average_hash(s) for s in SIZES] + [vert_gradient(s) for s in SIZES]


def example_modifications() -> list[Modification]:
    return [rotation(180), rotation(90), rotation(270), blurring(0.5), blurring(0.9)]


def select(registry: list, ids: list[int]) -> list[tuple[int, object]]:
    """(id, entry) of the entries whose position is among ids: in registry order, each once; ids beyond it are ignored."""
    wanted = set(ids)
    return [(i, entry) for i, entry in enumerate(registry) if i in wanted]


def renumbered(selected: list[tuple[int, object]]) -> list[tuple[int, int, object]]:
    """(number within the selection, id, entry)."""
    return [(k, i, entry) for k, (i, entry) in enumerate(selected)]


def modification(registry: list[Modification], name: str) -> Modification:
    for entry in registry:
        if entry.name == name:
            return entry
    raise ModificationNotFound(name)


def method(registry: list[HashMethod], name: str) -> HashMethod:
    for entry in registry:
        if entry.name == name:
            return entry
    raise HashingMethodNotFound(name)


def registry_frame(spark: SparkSession, registry: list, ids: list[int] | None = None) -> DataFrame:
    """(local_id, id, name) of the selected entries, or of all."""
    chosen = renumbered(select(registry, list(range(len(registry))) if ids is None else ids))
    return spark.createDataFrame([(k, i, e.name) for k, i, e in chosen], "local_id int, id int, name string")

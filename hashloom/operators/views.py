"""Views of the store: what the active run holds, and matches with all that is known of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.skew import heavy_keys, salted_join


def active_run_modified_images(program: DataFrame, run_images: DataFrame, images: DataFrame, modified_images: DataFrame) -> DataFrame:
    """(modified_image_id, image_id, modification_id) of the images that the active run lists.

    program has one row, so it is sent to all tasks; an image listed twice counts twice.
    """
    listed = run_images.join(F.broadcast(program.select("run_id")), "run_id").select("image_id")
    present = listed.join(images.select(F.col("id").alias("image_id")), "image_id")
    return modified_images.select(F.col("id").alias("modified_image_id"), "image_id", "modification_id").join(present, "image_id").select("modified_image_id", "image_id", "modification_id")


def active_run_hashes(program: DataFrame, run_images: DataFrame, images: DataFrame, modified_images: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash_id, hash, hashing_method_id, modified_image_id, image_id, modification_id)."""
    variants = active_run_modified_images(program, run_images, images, modified_images)
    rows = hashes.select(F.col("id").alias("hash_id"), "hash", "hashing_method_id", F.col("mod_image_id").alias("modified_image_id"))
    return rows.join(variants, "modified_image_id").select("hash_id", "hash", "hashing_method_id", "modified_image_id", "image_id", "modification_id")


def described_hashes(hashes: DataFrame, hashing_methods: DataFrame, modified_images: DataFrame, modifications: DataFrame) -> DataFrame:
    """(hash_id, hashing_method_id, method, image_id, modification_id, modification): each hash with its names."""
    methods = hashing_methods.select(F.col("id").alias("hashing_method_id"), F.col("name").alias("method"))
    names = modifications.select(F.col("id").alias("modification_id"), F.col("name").alias("modification"))
    variants = modified_images.select(F.col("id").alias("mod_image_id"), "image_id", "modification_id").join(names, "modification_id")
    rows = hashes.select(F.col("id").alias("hash_id"), "mod_image_id", "hashing_method_id").join(methods, "hashing_method_id")
    return rows.join(variants, "mod_image_id").select("hash_id", "hashing_method_id", "method", "image_id", "modification_id", "modification")


def match_star(matches: DataFrame, described: DataFrame) -> DataFrame:
    """Matches with both sides described: *_1 and *_2 columns. A match with a side that has no row is left out.

    A hash that holds a large share of the matches is spread over many tasks on either side.
    """
    out = matches
    for side in ("1", "2"):
        key = f"hash{side}_id"
        facts = described.select(F.col("hash_id").alias(key), *(F.col(c).alias(f"{c}_{side}") for c in described.columns if c != "hash_id"))
        out = salted_join(out, facts, key, heavy_keys(matches, key))
    return out


#: Which pairs a ROC is about: those of one modification (by name), those across, or all.
PAIRINGS = ("same_modification", "cross_modification", "all")


def paired(star: DataFrame, pairing: str = "all") -> DataFrame:
    """Matches of one method on both sides, and of the pairing's modifications."""
    rows = star.where(F.col("method_1") == F.col("method_2"))
    if pairing == "same_modification":
        return rows.where(F.col("modification_1") == F.col("modification_2"))
    if pairing == "cross_modification":
        return rows.where(F.col("modification_1") != F.col("modification_2"))
    if pairing == "all":
        return rows
    raise ValueError(f"pairing is one of {PAIRINGS}")

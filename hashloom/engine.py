"""The pipeline as one object: pick a folder, modifications and methods; run; read the results."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom import registry
from hashloom.errors import AlreadyRunning, InvalidName, InvalidSetting, PathNotFound
from hashloom.functions.bits import RENDERINGS
from hashloom.functions.numbering import numbered
from hashloom.functions.paths import plain_text
from hashloom.operators import matching, roc, upserts, views
from hashloom.operators.variants import hash_variants
from hashloom.runtime import durable, hadoop_path, write_bytes
from hashloom.sources.images import decoded, rejects, require_decodable, safe_name, scan, undecodable
from hashloom.sources.warehouse import Warehouse


def default_images() -> str:
    """The images' folder where none is given: HASHLOOM_IMAGES, else images in the working folder."""
    return os.environ.get("HASHLOOM_IMAGES") or os.path.abspath("images")


def default_uploads() -> str:
    """The folder of uploads where none is given."""
    return os.environ.get("HASHLOOM_UPLOADS") or os.path.join(os.path.expanduser("~"), ".local", "share", "hashloom", "images")


def _checked(registry_: list, kind: type) -> list:
    entries = list(registry_)
    for e in entries:
        if not isinstance(e, kind):
            raise InvalidSetting(f"{e!r} is no {kind.__name__}")
    if len({e.name for e in entries}) < len(entries):
        raise InvalidSetting(f"two entries of {kind.__name__} have the same name")
    return entries


class Engine:
    """Runs the pipeline into a store.

    Nothing is selected at first: such a run records its images and makes no hashes or matches.
    Ids of modifications and methods are positions in the registries, the same in every run.
    Images keep their id as long as their path stays the same. ``progress`` is told the name of
    each stage that is done, with the run's number. With ``compat_selection`` a run picks its
    modifications by the positions selected for methods, as the literal reading has it. ``within``
    keeps only matches below that relative distance: all pairs of a method grow with its square, so
    a large store sets it and takes its ROC from roc_of_hashes, which counts all pairs without
    writing them. A ``strict`` run ends at a file that is no image and at unequal hash lengths.
    """

    def __init__(self, *, spark: SparkSession, store: str, images_path: str | None = None, modifications: list | None = None, methods: list | None = None, rendering: str = "bits", within: float | None = None, strict: bool = False, compat_selection: bool = False, now: Callable[[], int] = lambda: int(time.time() * 1000), progress: Callable[[str, int], None] = lambda stage, run_id: None):
        if not isinstance(store, str) or not store.strip():
            raise InvalidSetting("store has to name a folder")
        if rendering not in RENDERINGS:
            raise InvalidSetting(f"rendering is one of {RENDERINGS}")
        if within is not None and not within > 0:
            raise InvalidSetting("within is a relative distance above 0")
        if not callable(now) or not callable(progress):
            raise InvalidSetting("now and progress are functions")
        self.modifications = _checked(registry.default_modifications() if modifications is None else modifications, registry.Modification)
        self.methods = _checked(registry.default_methods() if methods is None else methods, registry.HashMethod)
        self.spark, self.store, self.path = spark, Warehouse(spark, store), images_path if images_path is not None else default_images()
        self.rendering, self.within, self.strict, self.compat_selection, self.now, self.progress = rendering, within, strict, compat_selection, now, progress
        self.selected_modifications: list[int] = []
        self.selected_methods: list[int] = []
        self.undecodable: DataFrame | None = None
        self.rejected: DataFrame | None = None
        self._running = threading.Lock()
        self.store.create()

    def set_path(self, path: str) -> None:
        self.path = path

    def get_path(self) -> str | None:
        return self.path

    def set_selected_modifications(self, ids: list[int]) -> None:
        self.selected_modifications = list(ids)

    def set_selected_methods(self, ids: list[int]) -> None:
        self.selected_methods = list(ids)

    def running(self) -> bool:
        return self._running.locked()

    def health(self) -> str:
        return "ok"

    def runs(self) -> DataFrame:
        return self.store.read("runs")

    def list_methods(self) -> DataFrame:
        return registry.registry_frame(self.spark, self.methods).select("id", "name")

    def list_modifications(self) -> DataFrame:
        return registry.registry_frame(self.spark, self.modifications).select("id", "name")

    def start_run(self, path: str, methods: list[int], modifications: list[int]) -> int:
        self.set_path(path)
        self.set_selected_methods(methods)
        self.set_selected_modifications(modifications)
        return self.run()

    def submit_images(self, username: str, files: list[tuple[str | None, bytes]], folder: str | None = None) -> dict[str, int]:
        """Writes uploaded files under folder/username and records them under the paths a scan gives them.

        Whatever folders a file's name holds are left out; files without a name are skipped and
        counted. A file that is uploaded again replaces the stored one and keeps its id. A user's
        name that would lead out of the folder is refused; an empty one is "undefined".
        """
        user = safe_name(username) or "undefined"
        if username and user != username.strip():
            raise InvalidName(username)
        fs, target = hadoop_path(self.spark, f"{(folder or default_uploads()).rstrip('/')}/{user}")
        target = fs.makeQualified(target).toString()
        saved, skipped = {}, 0
        for name, data in files:
            base = safe_name(name)
            if not base:
                skipped += 1
                continue
            write_bytes(self.spark, f"{target}/{base}", data)
            saved[plain_text(f"{target}/{base}")] = user
        if saved:
            self._record(self.spark.createDataFrame(list(saved.items()), "path string, user string"))
        return {"saved": len(saved), "skipped": skipped}

    def _record(self, seen: DataFrame) -> None:
        """Images whose path isn't stored get the next ids, in the order of their paths; the others keep theirs."""
        known = self.store.read("images")
        fresh = seen.join(known.select("path"), "path", "left_anti").select("path", "user")
        self.store.append("images", numbered(fresh, ["path"], "id", upserts.next_id(known) if known.take(1) else 0).select("id", "path", "user"))

    def run(self) -> int:
        """One run over the folder; its number. A second run at the same time is refused."""
        if not self._running.acquire(blocking=False):
            raise AlreadyRunning("a run is going on")
        try:
            return self._run()
        finally:
            self._running.release()

    def _run(self) -> int:
        s = self.store
        mods = registry.select(self.modifications, self.selected_methods if self.compat_selection else self.selected_modifications)
        methods = registry.select(self.methods, self.selected_methods)

        if not self.path:
            raise PathNotFound("no folder is set")
        seen = scan(self.spark, self.path)
        self._record(seen)
        self.rejected = rejects(seen)  # of a scan: names that are no file's; they are recorded and not opened
        images = durable(seen.select("path", "user").join(s.read("images").groupBy("path").agg(F.min("id").alias("image_id")), "path"))

        run_id = upserts.next_id(s.read("runs"))
        s.append("runs", self.spark.createDataFrame([(run_id, self.now())], "id bigint, timestamp bigint"))
        s.replace("program", self.spark.createDataFrame([(0, run_id)], "id int, run_id bigint"))
        listed = images.select(F.lit(run_id).alias("run_id"), "image_id")
        s.append("run_images", numbered(listed, ["image_id"], "id", upserts.next_id(s.read("run_images"))))
        for name, chosen in (("modifications", mods), ("hashing_methods", methods)):
            rows = self.spark.createDataFrame([(i, e.name) for i, e in chosen], "id int, name string")
            s.replace(name, durable(upserts.insert_ignore(s.read(name), rows, ["id"])))

        self.progress("images", run_id)
        readable = images.join(self.rejected.select("path"), "path", "left_anti")
        grids = decoded(self.spark, self.path, self._unhashed(readable, mods, methods))
        if mods and methods:
            rows = durable(hash_variants(grids, mods, methods))
            self.undecodable = undecodable(self._unhashed(images, mods, methods), rows.select("image_id").distinct())
        else:
            self.undecodable = undecodable(images, grids)
        if self.strict:
            require_decodable(self.undecodable)
        if mods and methods:
            self._hash(rows)
            self.progress("hashes", run_id)
            self._match(run_id)
            self.progress("matches", run_id)
        return run_id

    def _unhashed(self, images: DataFrame, mods: list, methods: list) -> DataFrame:
        """The images that lack a hash of some selected modification and method: only these are opened."""
        if not mods or not methods:
            return images
        s = self.store
        variants = s.read("modified_images").where(F.col("modification_id").isin([i for i, _ in mods])).select(F.col("id").alias("mod_image_id"), "image_id", "modification_id")
        there = s.read("hashes").where(F.col("hashing_method_id").isin([i for i, _ in methods])).select("mod_image_id", "hashing_method_id").join(variants, "mod_image_id")
        whole = there.groupBy("image_id").agg(F.countDistinct("modification_id", "hashing_method_id").alias("n")).where(F.col("n") == len(mods) * len(methods))
        return images.join(whole.select("image_id"), "image_id", "left_anti")

    def _hash(self, rows: DataFrame) -> None:
        s = self.store
        table, ids = upserts.upsert_returning(s.read("modified_images"), rows, ["image_id", "modification_id"])
        s.replace("modified_images", durable(table))
        ids = s.read("modified_images").join(rows.select("image_id", "modification_id").distinct(), ["image_id", "modification_id"], "left_semi")
        new = rows.join(ids.withColumnRenamed("id", "mod_image_id"), ["image_id", "modification_id"])
        key = ["mod_image_id", "hashing_method_id"]
        new = new.join(s.read("hashes").select(*key), key, "left_anti")
        s.append("hashes", numbered(new.select(*key, "hash", "words", "nbits"), key, "id", upserts.next_id(s.read("hashes"))))

    def _match(self, run_id: int) -> None:
        s = self.store
        active = views.active_run_hashes(*(s.read(t) for t in ("program", "run_images", "images", "modified_images", "hashes"))).select("hash_id").distinct()
        chosen = s.read("hashes").join(active.withColumnRenamed("hash_id", "id"), "id", "left_semi").where(F.col("hashing_method_id").isin(self.selected_methods))
        matching.require_enough(chosen)
        if self.strict:
            matching.require_equal_lengths(chosen)
        pairs = durable(matching.unique_pairs(chosen, self.rendering, self.within))  # numbering reads them twice
        s.append("matches", numbered(pairs.drop("hashing_method_id"), ["hash1_id", "hash2_id"], "id", upserts.next_id(s.read("matches"))).withColumn("run_id", F.lit(run_id)))

    def roc(self, pairing: str = "all", run_id: int | None = None, modifications: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
        """ROC of the stored matches, of one run or of all; only of the named modifications and methods, if named."""
        s = self.store
        described = views.described_hashes(*(s.read(t) for t in ("hashes", "hashing_methods", "modified_images", "modifications")))
        matches = s.read("matches") if run_id is None else s.read("matches").where(F.col("run_id") == run_id)
        rows = views.paired(views.match_star(matches, described), pairing)
        if modifications is not None:
            rows = rows.where(F.col("modification_1").isin(modifications) & F.col("modification_2").isin(modifications))
        if methods is not None:
            rows = rows.where(F.col("method_1").isin(methods))
        counts = roc.counted(rows, ["method_1"], F.col("image_id_1") == F.col("image_id_2"))
        return roc.rates(roc.merged(roc.confusion(counts, ["method_1"], roc.thresholds(self.spark))))

    def roc_of_hashes(self) -> DataFrame:
        """ROC by method over all unique pairs of the stored hashes, counted in their tiles: no match is written or read."""
        s = self.store
        variants = s.read("modified_images").select(F.col("id").alias("mod_image_id"), "image_id")
        counts = matching.pair_histogram(s.read("hashes").join(variants, "mod_image_id"), "image_id")
        counts = counts.select("hashing_method_id", "hamming_distance", F.col("nbits").alias("hash_len"), "same", F.col("pairs").alias("n"))
        return roc.rates(roc.confusion(counts, ["hashing_method_id"], roc.thresholds(self.spark)))

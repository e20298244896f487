"""The image store as folders of Parquet snapshots.

Each table has folders of rows and numbered pointer files, CURRENT-<n>, each a list of the folders
that make up the table; the highest number counts. A write makes a new folder, writes the next
pointer under another name and renames it into place as the last step, so readers never see half a
table and a write that is cut off at any point changes nothing. Of the older pointers one is kept.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.errors import NoRun, StoreError
from hashloom.operators.views import active_run_hashes, active_run_modified_images
from hashloom.runtime import hadoop_path, read_text, write_text
from hashloom.schema import SCHEMAS

POINTER = "CURRENT-"
KEPT = 2


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return hadoop_path(self.spark, "/".join((self.root, *parts)))[1]

    def _fs(self):
        return hadoop_path(self.spark, self.root)[0]

    def _names(self, table: str) -> list[str]:
        fs, path = self._fs(), self._path(table)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _latest(self, table: str) -> int | None:
        return max((int(n[len(POINTER) :]) for n in self._names(table) if n.startswith(POINTER) and n[len(POINTER) :].isdecimal()), default=None)

    def create(self) -> None:
        """Makes the tables that aren't there. A folder with rows but without a pointer isn't taken for an empty table."""
        for name in SCHEMAS:
            if self._latest(name) is None:
                if any(n.startswith("part-") for n in self._names(name)):
                    raise StoreError(f"{name}: there are rows but no pointer names them")
                self._point(name, [], 0)

    def _point(self, name: str, folders: list[str], number: int) -> None:
        """The pointer of that number; refused if it is there, since another writer was faster."""
        fs, new = self._fs(), self._path(name, f"new-{uuid.uuid4().hex}")
        target = self._path(name, f"{POINTER}{number:010d}")
        write_text(self.spark, new.toString(), json.dumps(folders))
        try:
            moved = not fs.exists(target) and fs.rename(new, target)
        except Py4JJavaError as e:
            raise StoreError(f"{name}: the pointer can't be moved") from e
        if not moved:
            fs.delete(new, False)
            raise StoreError(f"{name}: pointer {number} was written by another")
        for old in self._names(name):
            if old.startswith(POINTER) and old[len(POINTER) :].isdecimal() and int(old[len(POINTER) :]) <= number - KEPT:
                fs.delete(self._path(name, old), False)

    def _state(self, name: str) -> tuple[int, list[str]]:
        if name not in SCHEMAS:
            raise StoreError(f"no table {name}")
        number = self._latest(name)
        if number is None:
            raise StoreError(f"{name}: not created")
        return number, json.loads(read_text(self.spark, self._path(name, f"{POINTER}{number:010d}").toString()))

    def read(self, name: str) -> DataFrame:
        folders = self._state(name)[1]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{name}/{f}" for f in folders))

    def _write(self, name: str, rows: DataFrame) -> str:
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        folder = f"part-{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)).write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def append(self, name: str, rows: DataFrame) -> None:
        number, before = self._state(name)
        self._point(name, [*before, self._write(name, rows)], number + 1)

    def replace(self, name: str, rows: DataFrame) -> None:
        number, _ = self._state(name)
        self._point(name, [self._write(name, rows)], number + 1)

    def vacuum(self) -> int:
        """Removes the folders that no kept pointer names; how many. Not while a run is going on: its new folder has no pointer yet."""
        removed = 0
        for name in SCHEMAS:
            names = self._names(name)
            named = {f for n in names if n.startswith(POINTER) for f in json.loads(read_text(self.spark, self._path(name, n).toString()))}
            for old in names:
                if old.startswith(("part-", "new-")) and old not in named:
                    removed += bool(self._fs().delete(self._path(name, old), True))
        return removed

    def active_run(self) -> int:
        row = self.read("program").first()
        if row is None:
            raise NoRun("no run has been made")
        return row["run_id"]

    def views(self) -> None:
        """Temporary views of all tables under their names, and of what the active run holds."""
        tables = {name: self.read(name) for name in SCHEMAS}
        for name, rows in tables.items():
            rows.createOrReplaceTempView(name)
        base = [tables[t] for t in ("program", "run_images", "images", "modified_images")]
        active_run_modified_images(*base).createOrReplaceTempView("active_run_modified_images")
        active_run_hashes(*base, tables["hashes"]).createOrReplaceTempView("active_run_hashes")

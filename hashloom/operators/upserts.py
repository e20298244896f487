"""Inserts that ignore or return what is there, as functions from old and new rows to the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.numbering import numbered


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those of new whose key isn't in it; of new rows with equal keys one stays, the least."""
    rest = [c for c in old.columns if c not in key]
    fresh = new.select(*old.columns).join(old.select(*key), key, "left_anti")
    if rest:
        fresh = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_first")).select(*key, *(F.col(f"_first.{c}").alias(c) for c in rest))
    else:
        fresh = fresh.distinct()
    return old.unionByName(fresh.select(*old.columns))


def next_id(table: DataFrame, column: str = "id") -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def append(old: DataFrame, new: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """old and all of new, numbered on from the largest id in the given order."""
    ids = numbered(new, order, id_column, next_id(old, id_column))
    return old.unionByName(ids.select(*(F.col(f.name).cast(f.dataType) for f in old.schema.fields)))


def upsert_returning(old: DataFrame, new: DataFrame, key: list[str], id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table, returned): keys of new that aren't there get the next ids; returned has each key of new with its id."""
    keys = new.select(*key).distinct()
    fresh = numbered(keys.join(old.select(*key), key, "left_anti"), key, id_column, next_id(old, id_column))
    table = old.select(id_column, *key).unionByName(fresh.select(id_column, *key))
    return table, table.join(keys, key, "left_semi").select(id_column, *key)


def replace_single(new: DataFrame) -> DataFrame:
    """The one row of a table that holds one: the last by run_id."""
    return new.orderBy(F.col("run_id").desc()).limit(1)

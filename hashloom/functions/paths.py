"""Path functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def plain(path: Column) -> Column:
    """A local file's URI as its path, so that one file has one spelling; other file systems keep theirs."""
    return F.regexp_replace(path, "^file:/+", "/")


def plain_text(path: str) -> str:
    """plain() for one path."""
    return re.sub("^file:/+", "/", path)


def user_of(path: Column, root: str | None = None) -> Column:
    """The name of the folder a file is in; "undefined" if it is in none, or if the root is the file itself."""
    parts = F.split(path, "/")
    user = F.when(F.size(parts) > 1, F.element_at(F.slice(parts, F.size(parts) - 1, 1), 1))
    if root is not None:
        user = F.when(plain(path) == plain_text(root), F.lit(None)).otherwise(user)
    return F.when(path.isNull(), F.lit(None)).otherwise(F.coalesce(F.when(user != "", user), F.lit("undefined")))

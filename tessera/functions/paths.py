"""Parts of paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "([^/\\\\]*)$", 1))


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), "\\.([^.]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")

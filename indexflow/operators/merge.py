"""Keyed upserts and deletes as rewrites: no lakehouse is assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, upserts: DataFrame, deletes: DataFrame | None, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``upserts`` in place of those with the same key, and without the keys of ``deletes``."""
    gone = upserts.select(*keys) if deletes is None else upserts.select(*keys).unionByName(deletes.select(*keys))
    return old.join(gone, keys, "left_anti").unionByName(upserts, allowMissingColumns=True)


def last_writer(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

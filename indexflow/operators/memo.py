"""Results of functions kept by a fingerprint of their input, so that each input is computed once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexflow.fingerprint import fingerprint, row_fingerprint
from indexflow.types import FieldType


def memoize(df: DataFrame, print_: Column, compute: Callable[[DataFrame], DataFrame], cache: DataFrame | None, out: str, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``df`` with column ``out`` and the cache (print, result) with what was new. ``compute`` adds column result to rows with new prints."""
    marked = df.withColumn("__print", print_)
    fresh = marked.dropDuplicates(["__print"])
    if cache is not None:
        fresh = fresh.join(cache.select(F.col("print").alias("__print")), "__print", "left_anti")
    made = save(compute(fresh).select(F.col("__print").alias("print"), "result"))
    known = made if cache is None else cache.unionByName(made)
    return marked.join(known.select(F.col("print").alias("__print"), F.col("result").alias(out)), "__print", "left").drop("__print"), known


class Memo:
    """A flow's caches, a table for each function and version: results by the source row that used them and a fingerprint of the input.

    A source row finds what it used before; equal inputs of rows evaluated together are computed once. What a row no longer
    uses goes when it is evaluated again. ``load`` gives a cache's rows for some source rows, if there are any.
    """

    def __init__(self, load: Callable[[str], DataFrame | None], save: Callable[[DataFrame, str], DataFrame]):
        self.load, self.save = load, save
        self.used: dict[str, DataFrame] = {}

    def apply(self, df: DataFrame, out: str, fn: Any, t: FieldType, args: dict[str, tuple[Column, FieldType]], made: Column) -> DataFrame:
        name = fingerprint([fn.identity, t.describe()]).replace("/", "_").replace("+", "-").rstrip("=")
        print_ = row_fingerprint(*(c.alias(f"a{i}") for i, (c, _) in enumerate(args.values())))
        cache, own = self.load(name), ["__src", "__key", "print"]
        if not any(f.dataType.simpleString() == "void" for f in df.schema):
            # what comes before the function is evaluated once, though its rows are asked several times
            df = self.save(df, f"{name}-rows")
        calls = df.select("__src", "__key", print_.alias("print"))
        # results of an earlier call in this run count too: the same function may be used twice
        sources = [x for x in (cache, self.used.get(name)) if x is not None]
        found = None
        for x in sources:
            found = x if found is None else found.unionByName(x)
        known = None if found is None else found.join(calls.distinct(), own, "left_semi").dropDuplicates(["print"]).select("print", "result")
        got, every = memoize(df, print_, lambda rows: rows.withColumn("result", made), known, out, lambda rows: self.save(rows, name))
        # failures aren't kept: they are tried again
        fresh = self.save(calls.distinct().join(every.where("result.error is null"), "print").select(*own, "result"), f"{name}-used")
        self.used[name] = fresh if name not in self.used else self.used[name].unionByName(fresh).dropDuplicates(own)
        return got

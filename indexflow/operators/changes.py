"""Change detection between a listing and what is tracked, as joins and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much a version knows, in rising order.
UNKNOWN_LOGIC, DIFFERENT_LOGIC, CURRENT_LOGIC, NON_EXISTENCE = range(4)
#: Rows with fingerprints that a task compares.
ROWS_A_TASK = 200_000
DELETE, NO_CHANGE, PROCESS = "DELETE", "NO_CHANGE", "PROCESS"


def should_skip(had_ordinal: Column, had_kind: Column, ordinal: Column, kind: Column) -> Column:
    """Whether the version at hand is as new: both ordinals are known, and its own is larger, or equal with a kind no lower."""
    return F.coalesce((had_ordinal > ordinal) | ((had_ordinal == ordinal) & (had_kind >= kind)), F.lit(False))


def logic_kind(tracked: Column, current: str | Column) -> Column:
    current = current if isinstance(current, Column) else F.lit(current)
    return F.when(tracked.isNull(), UNKNOWN_LOGIC).when(tracked == current, CURRENT_LOGIC).otherwise(DIFFERENT_LOGIC)


def detect_changes(listing: DataFrame, tracking: DataFrame, key: str | list[str], logic: str) -> DataFrame:
    """Every key of either side with its class: DELETE where it isn't listed any more, NO_CHANGE where its version is as new, else PROCESS.

    ``listing`` has the key and ordinal; ``tracking`` the key, ordinal, logic and whatever else, which is kept under had_ names.
    """
    keys = [key] if isinstance(key, str) else key
    had = tracking.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"had_{c}") for c in tracking.columns if c not in keys), F.lit(True).alias("had"))
    both = listing.withColumn("listed", F.lit(True)).join(had, keys, "full_outer")
    skip = should_skip(F.col("had_ordinal"), logic_kind(F.col("had_logic"), logic), F.col("ordinal"), F.lit(CURRENT_LOGIC))
    return both.withColumn("class", F.when(F.col("listed").isNull(), DELETE).when(F.col("had") & skip, NO_CHANGE).otherwise(PROCESS)).withColumn("had", F.coalesce("had", F.lit(False))).drop("listed")


def outcome(had: Column, produced: Column, had_ordinal: Column, ordinal: Column) -> Column:
    """What processing a source row was: insertion, deletion, reprocess at the same ordinal, else update."""
    return F.when(produced, F.when(~had, "insertion").when(had_ordinal == ordinal, "reprocess").otherwise("update")).when(had, "deletion")


def count_classes(classes: DataFrame) -> DataFrame:
    """Numbers of rows of each class in one row."""
    return classes.agg(*(F.count_if(F.col("class") == c).alias(f"n_{c.lower()}") for c in (DELETE, NO_CHANGE, PROCESS)))


def changed_targets(new: DataFrame, tracked: DataFrame, keys: list[str], print_col: str = "print", rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows to write, whose fingerprint isn't tracked under their key, and tracked keys to delete.

    Fingerprints take far more memory than Spark expects, so the tracked ones are shuffled, never broadcast, and, if their number of
    ``rows`` is given, in partitions that don't grow with it. Keys are made distinct when only those to delete are left.
    """
    own = [*keys, print_col]
    parts = max(1, rows // ROWS_A_TASK, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda df: df.repartition(parts, *own) if rows > ROWS_A_TASK else df
    held = dealt(tracked.select(*own)).hint("merge")
    return dealt(new).join(held, own, "left_anti"), tracked.select(*keys).join(new.select(*keys), keys, "left_anti").distinct()

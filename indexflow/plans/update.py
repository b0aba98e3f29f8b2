"""One update of a flow: what changed is read, evaluated and merged; everything is published at once.

Listings meet the tracked versions in a full outer join. Only rows whose version is newer are read, only those whose
content or logic differs are evaluated; of several versions of a key the newest counts, and of equal ones the smallest content.
What they produce is compared with the tracked target keys by fingerprint,
so unchanged rows aren't written and keys that nothing produces any more are deleted. Rows that fail are
counted and left as they were. All tables are kept in buckets of their key's hash, and only buckets with
changed keys are read and written. Until the next manifest is there nothing has happened,
so a run can be repeated after any failure.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexflow.fingerprint import row_fingerprint
from indexflow.operators.changes import DELETE, NO_CHANGE, PROCESS, detect_changes, outcome
from indexflow.operators.memo import Memo
from indexflow.operators.merge import last_writer
from indexflow.plans.builder import ERR, KEY, PLACE, SRC, Export, FlowBuilder, source_key
from indexflow.plans.state import FlowState, few, no_rows, unless_few

TRACKING = "__src string, __skey string, ordinal long, logic string, __content string, run long, at_micros long"
#: So many failed rows are broadcast, so that the many that didn't fail needn't be shuffled.
FEW_FAILED = 10_000
OWNERS = "__tkey string, __print string, __src string, __skey string"


@dataclass
class SourceStats:
    no_change: int = 0
    insertions: int = 0
    deletions: int = 0
    updates: int = 0
    reprocesses: int = 0
    errors: int = 0

    @property
    def changed(self) -> bool:
        return any((self.insertions, self.deletions, self.updates, self.reprocesses))

    def __str__(self) -> str:
        shown = [f"{n} {label}" for n, label in ((self.no_change, "without change"), (self.insertions, "added"), (self.deletions, "removed"), (self.updates, "updated"), (self.reprocesses, "reprocessed"), (self.errors, "failed")) if n]
        return ", ".join(shown) or "no input"


@dataclass
class UpdateStats:
    sources: dict[str, SourceStats] = field(default_factory=dict)
    errors: list[tuple[str, str, str]] = field(default_factory=list)

    def __str__(self) -> str:
        return "\n".join(f"{name}: {s}" for name, s in self.sources.items())


def target_name(export_name: str) -> str:
    return f"target.{export_name}"


def run_update(spark: SparkSession, define: Callable[[FlowBuilder], None], state: FlowState, name: str = "flow", only: set[str] | None = None, keep_errors: int = 100) -> UpdateStats:
    """Bring all targets up to date with the sources, or with those named in ``only``."""
    base = FlowBuilder(spark, name)
    define(base)
    logic = base.logic_fingerprint
    manifest = state.load()
    run = max(manifest.run + 1, int(time.time() * 1000))
    empty = lambda schema: no_rows(spark, T.StructType.fromDDL(schema))
    tracking = state.table(manifest, "tracking")
    tracking = empty(TRACKING) if tracking is None else tracking

    stats = UpdateStats()
    changes, todo, contents, tracked = {}, {}, {}, {}

    def read_source(source: str) -> tuple[int, DataFrame, DataFrame]:
        spec, t, _ = base.sources[source]
        keys = base.source_keys(source)
        listing = spec.listing(spark).withColumn("__skey", source_key(keys))
        latest = listing.groupBy("__skey").agg(F.max("__ordinal").alias("ordinal"))
        had = tracking.where(F.col("__src") == source)
        before = had.count() if "tracking" in manifest.schemas else 0
        seen = detect_changes(latest, had.drop("__src", "run", "at_micros"), "__skey", logic)
        seen = state.stage(seen.where(F.col("class") != NO_CHANGE), "changes")
        wanted = unless_few(seen.where(F.col("class") == PROCESS), seen._indexflow_rows)
        if few(seen._indexflow_rows) or not hasattr(spec, "scan"):
            keys_of = unless_few(listing.join(wanted, "__skey", "left_semi"), seen._indexflow_rows)
            keys_of._indexflow_rows = seen._indexflow_rows
            rows = spec.read(spark, keys_of)
        else:
            rows = spec.scan(spark)
        rows = rows.withColumn("__skey", source_key(keys)).join(wanted.select("__skey", "had___content", "had_logic"), "__skey")
        rows = rows.withColumn("__content", row_fingerprint(*(F.col(f"`{n}`") for n, _ in t.fields)))
        rows = last_writer(rows, ["__skey"], [F.col("__ordinal").desc_nulls_last(), "__content"])
        rows = rows.withColumn("__same", F.coalesce((F.col("had___content") == F.col("__content")) & (F.col("had_logic") == F.lit(logic)), F.lit(False)))
        return before, seen, state.stage(rows, "rows")

    listed = [source for source in base.sources if only is None or source in only]
    for source, (before, seen, rows) in zip(listed, together(*(partial(read_source, source) for source in listed)), strict=True):
        tracked[source], changes[source], contents[source] = before, seen, rows.select("__skey", "__content", "__same")
        todo[source] = rows.where("not __same").select(*(f"`{n}`" for n, _ in base.sources[source][1].fields))

    pending = _union([rows.where("not __same").select("__skey") for rows in contents.values()]) if contents else empty("__skey string")

    def cached(n: str) -> DataFrame | None:
        stored = f"memo.{n}"
        if stored not in manifest.schemas:
            return None
        return state.table(manifest, stored, state.numbers(manifest, stored, pending, "__skey")).withColumnRenamed("__skey", "__key")

    memo = Memo(cached, lambda df, n: state.stage(df, f"memo-{n}"))
    for source, (spec, _, _) in base.sources.items():
        if source not in todo:
            todo[source] = spec.read(spark).limit(0).drop("__ordinal")
    builder = FlowBuilder(spark, name, rows=todo, memo=memo)
    define(builder)

    produced, failed = {}, empty("__src string, __skey string, error string")

    def produce(e: Export) -> DataFrame:
        key = [n for n, _ in e.key]
        rows = e.collector.rows.withColumnRenamed(KEY, "__skey")
        values = [F.col(f"`{n}`") for n, _ in (e.key + e.values)]
        rows = rows.withColumn("__tkey", F.to_json(F.struct(*(F.col(f"`{k}`") for k in key)), {"ignoreNullFields": "false"})).withColumn("__print", row_fingerprint(*values) if e.stable else F.lit(None).cast("string"))
        return state.stage(rows, "produced")

    for e, rows in zip(builder.exports.values(), together(*(partial(produce, e) for e in builder.exports.values())), strict=True):
        produced[e.name] = rows
        bad = rows.where(F.col(ERR).isNotNull()).select("__src", "__skey", F.col(ERR).alias("error"))
        twice = rows.where(F.col(ERR).isNull()).groupBy("__src", "__skey", "__tkey").agg(F.count("*").alias("n")).where("n > 1").select("__src", "__skey", F.concat(F.lit(f"{e.name}: key "), "__tkey", F.lit(" is produced twice")).alias("error"))
        failed = failed.unionByName(bad).unionByName(twice)
    failed = state.stage(failed.groupBy("__src", "__skey").agg(F.min("error").alias("error")), "failed")
    few_failed = failed._indexflow_rows <= FEW_FAILED
    if few_failed and failed._indexflow_rows:
        failed = F.broadcast(failed)

    def classify(source: str) -> DataFrame:
        # listed but gone when read: a deletion
        state_of = changes[source].join(contents[source], "__skey", "left").withColumn("class", F.when((F.col("class") == PROCESS) & F.col("__content").isNull(), F.when(F.col("had"), DELETE).otherwise("VANISHED")).when((F.col("class") == PROCESS) & F.col("__same"), "BUMP").otherwise(F.col("class")))
        return state.stage(state_of.join(failed.where(F.col("__src") == source).select("__skey", "error"), "__skey", "left"), "classes")

    done, bumped, gone = [], [], []
    for source, state_of in zip(changes, together(*(partial(classify, source) for source in changes)), strict=True):
        here = F.lit(source).alias("__src")
        ok = state_of.where("class = 'PROCESS' and error is null")
        version = lambda rows, here=here: rows.select(here, "__skey", "ordinal", F.lit(logic).alias("logic"), "__content", F.lit(run).alias("run"), F.lit(run * 1000).alias("at_micros"))
        kind = outcome(F.col("had"), F.lit(True), F.col("had_ordinal"), F.col("ordinal"))
        n = state_of.agg(
            F.count_if(F.col("class") == "BUMP").alias("no_change"),
            F.count_if("had").alias("had"),
            *(F.count_if((F.col("class") == PROCESS) & F.col("error").isNull() & (kind == k)).alias(name) for k, name in (("insertion", "insertions"), ("update", "updates"), ("reprocess", "reprocesses"))),
            F.count_if(F.col("class") == DELETE).alias("deletions"),
            F.count_if((F.col("class") == PROCESS) & F.col("error").isNotNull()).alias("errors"),
        ).first()
        # kinds without rows are left out of the plans that follow
        if n["insertions"] + n["updates"] + n["reprocesses"]:
            done.append(version(ok))
        if n["no_change"]:
            bumped.append(version(state_of.where("class = 'BUMP'")))
        if n["deletions"]:
            gone.append(state_of.where(F.col("class") == DELETE).select(here, "__skey"))
        left = tracked[source] - n["had"]  # tracked rows that aren't among the changes
        stats.sources[source] = SourceStats(**{f: n[f] + (left if f == "no_change" else 0) for f in ("no_change", "insertions", "deletions", "updates", "reprocesses", "errors")})
    stats.errors = [(r["__src"], r["__skey"], r["error"]) for r in failed.orderBy("__src", "__skey").limit(keep_errors).collect()]

    union = lambda frames, schema: _union(frames) if frames else empty(schema)
    own = ["__src", "__skey"]
    processed, bumps = union(done, TRACKING), union(bumped, TRACKING)
    most = sum(seen._indexflow_rows for seen in changes.values())
    touched = state.stage(processed.select(*own).unionByName(union(gone, "__src string, __skey string")), "touched")

    def save_export(e: Export) -> None:
        target, by_source, by_target = target_name(e.name), f"keys.{e.name}", f"owners.{e.name}"
        good = produced[e.name].where(F.col(ERR).isNull()).join(failed, own, "left_anti")
        fresh = good.select("__tkey", "__print", *own)
        # with few failed rows it costs less to leave them out again than to write the others
        fresh = unless_few(fresh, produced[e.name]._indexflow_rows) if few_failed else state.stage(fresh, "fresh")
        n_fresh = getattr(fresh, "_indexflow_rows", produced[e.name]._indexflow_rows)
        rows = last_writer(good, ["__tkey"], [*own, PLACE])
        rows = rows.select("__tkey", "__print", *(f"`{n}`" for n, _ in (e.key + e.values)))
        if not {target, by_source, by_target} & {*manifest.schemas}:
            together(*(partial(state.replace, manifest, n, df, by) for n, df, by in ((target, rows.drop("__print"), "__tkey"), (by_target, fresh, "__tkey"), (by_source, fresh, "__skey"))))
            return
        skeys = state.numbers(manifest, by_source, touched, "__skey", touched._indexflow_rows)
        before = state.table(manifest, by_source, skeys)
        lost = empty("__tkey string") if before is None else before.join(touched, own, "left_semi").select("__tkey").distinct()
        lost = state.stage(lost, "lost")
        tkeys = state.numbers(manifest, by_target, lost.unionByName(fresh.select("__tkey")), "__tkey", lost._indexflow_rows + n_fresh)
        owners = state.table(manifest, by_target, tkeys)
        owners = empty(OWNERS) if owners is None else owners
        if few(n_fresh):
            # of many keys the owners aren't told apart: that takes one more shuffle of all
            owners = owners.join(fresh.select("__tkey"), "__tkey", "left_semi")
        same = unless_few(owners.select("__tkey", "__print").distinct(), n_fresh)
        old = state.table(manifest, target, set())

        def save_owners() -> DataFrame:
            """Those of the lost keys that no source row produces now."""
            state.rewrite(manifest, by_target, touched, own, fresh, "__tkey", tkeys)
            left = state.table(manifest, by_target, state.numbers(manifest, by_target, lost, "__tkey", lost._indexflow_rows)).select("__tkey")
            if few(lost._indexflow_rows):
                # else Spark broadcasts the keys of all owners where their files are small
                left = left.join(lost, "__tkey", "left_semi").distinct()
            return state.stage(lost.join(left, "__tkey", "left_anti"), "dead")

        def save_target() -> None:
            # a target of another form is written anew
            if old is None or [f.simpleString() for f in old.schema] != [f.simpleString() for f in rows.drop("__print").schema]:
                state.replace(manifest, target, rows.drop("__print"), "__tkey")
                save_owners()
                return
            changed, dead = together(lambda: state.stage(rows.join(same, ["__tkey", "__print"], "left_anti").drop("__print"), "upserts"), save_owners)
            n = changed._indexflow_rows + dead._indexflow_rows
            gone = unless_few(changed.select("__tkey").unionByName(dead), n)
            state.rewrite(manifest, target, gone, ["__tkey"], changed, "__tkey", state.numbers(manifest, target, gone, "__tkey", n))

        together(save_target, partial(state.rewrite, manifest, by_source, touched, own, fresh, "__skey", skeys))

    def save_memo(n: str, df: DataFrame) -> None:
        used = df.withColumnRenamed("__key", "__skey").join(unless_few(processed.select(*own), most), own, "left_semi")
        state.rewrite(manifest, f"memo.{n}", touched, own, used, "__skey")

    save_tracking = partial(state.rewrite, manifest, "tracking", unless_few(touched.unionByName(bumps.select(*own)), most), own, processed.unionByName(bumps), "__skey")
    together(save_tracking, *(partial(save_export, e) for e in builder.exports.values()), *(partial(save_memo, n, df) for n, df in memo.used.items()))
    for n in [n for n in manifest.names() if n.split(".", 1)[0] in ("target", "keys", "owners") and n.split(".", 1)[1] not in builder.exports]:
        manifest.remove(n)
    manifest.run = run
    state.publish(manifest)
    return stats


def together(*calls: Callable[[], Any]) -> list[Any]:
    """The results of calls that run at once, as their Spark jobs are independent; the first failure is raised."""
    with ThreadPoolExecutor(8) as pool:
        return [done.result() for done in [pool.submit(c) for c in calls]]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def row_status(listing: DataFrame, tracking: DataFrame, logic: str) -> DataFrame:
    """Per source row: its current ordinal, and when, at which ordinal and whether by the current logic it was processed."""
    return listing.join(tracking.select("__skey", F.col("ordinal").alias("processed_ordinal"), "at_micros", (F.col("logic") == logic).alias("logic_current")), "__skey", "left")


def nth_of_equal(partition: list[str], order: list[str]):
    """The number of a row among equal ones."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))

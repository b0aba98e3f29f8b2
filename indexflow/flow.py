"""Flows by name: their definition, setup, updates, live updates, evaluation and status."""

from __future__ import annotations

import concurrent.futures
import json
import os
import re
import threading
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from indexflow.operators import graph
from indexflow.plans.builder import ERR, KEY, SRC, FlowBuilder, FlowError, source_key
from indexflow.plans.state import BUCKETS, FlowState
from indexflow.plans.update import UpdateStats, row_status, run_update, target_name
from indexflow.setup import Change, Step, commit_setup, plan_setup, stage_setup
from indexflow.sources.base import open_root


@dataclass
class Settings:
    """Where state is kept, a namespace for flows that share it, and the buckets of tables that new flows make."""

    state_dir: str
    app_namespace: str = ""
    buckets: int = BUCKETS

    @staticmethod
    def from_env() -> Settings:
        return Settings(os.environ.get("INDEXFLOW_STATE_DIR", "indexflow-state"), os.environ.get("INDEXFLOW_APP_NAMESPACE", ""))


_FLOWS: dict[str, Flow] = {}
_ENV: dict[str, Any] = {}
_AUTH: dict[str, Any] = {}


def init(spark: SparkSession, settings: Settings | None = None) -> None:
    _ENV.update(spark=spark, settings=settings or Settings.from_env())


def session() -> SparkSession:
    if "spark" not in _ENV:
        init(SparkSession.builder.getOrCreate())
    return _ENV["spark"]


def settings() -> Settings:
    session()
    return _ENV["settings"]


def app_namespace(trailing_delimiter: str = "") -> str:
    name = settings().app_namespace
    return name + trailing_delimiter if name else ""


def safe_identifier(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "__", name)


def target_default_name(flow: str, target: str, delimiter: str = "__") -> str:
    return safe_identifier(f"{app_namespace(delimiter)}{flow}{delimiter}{target}")


@dataclass(frozen=True)
class AuthRef:
    """Names an entry; the secret itself is in no spec, fingerprint or stored state."""

    key: str


def add_auth_entry(key: str, value: Any) -> AuthRef:
    if key in _AUTH:
        raise ValueError(f"auth entry {key!r} exists already")
    _AUTH[key] = value
    return AuthRef(key)


def add_transient_auth_entry(value: Any) -> AuthRef:
    return add_auth_entry(f"__transient_{len(_AUTH)}", value)


def ref_auth_entry(key: str) -> AuthRef:
    return AuthRef(key)


def auth_entry(ref: AuthRef) -> Any:
    return _AUTH[ref.key]


@dataclass
class EvaluateAndDumpOptions:
    output_dir: str
    use_cache: bool = True


class Flow:
    """A named flow. Its definition runs on first use."""

    def __init__(self, name: str, define: Callable[[FlowBuilder, Any], None]):
        self.name, self.define_with_scope = name, define
        self._lock, self._waiting = threading.Lock(), None
        self._wanted: set[str] | None = None
        self._pool = concurrent.futures.ThreadPoolExecutor(1, thread_name_prefix=f"update-{name}")

    @property
    def full_name(self) -> str:
        return f"{app_namespace('.')}{self.name}"

    def define(self, builder: FlowBuilder) -> None:
        self.define_with_scope(builder, builder.scope)

    def builder(self, **options: Any) -> FlowBuilder:
        made = FlowBuilder(session(), self.name, **options)
        self.define(made)
        return made

    @property
    def state(self) -> FlowState:
        return FlowState(session(), f"{settings().state_dir}/{app_namespace('__')}{self.name}", settings().buckets)

    # setup

    def setup_steps(self) -> dict[str, Step]:
        return plan_setup(self.builder(), self.state.load().setup)

    def setup(self, report_to_stdout: bool = False) -> dict[str, Step]:
        """Make the targets as the flow wants them: the change is stored as begun, made, then stored as done."""
        builder, state = self.builder(), self.state
        manifest = state.load()
        steps = plan_setup(builder, manifest.setup)
        if bad := [n for n, s in steps.items() if s.change is Change.INVALID]:
            raise FlowError(f"targets that the user set up don't fit: {bad}")
        if report_to_stdout:
            print(describe_steps(steps))
        if any(s.change is not Change.NO_CHANGE for s in steps.values()):
            manifest.setup = stage_setup(manifest.setup, builder, steps)
            state.publish(manifest)
            for n, s in steps.items():
                if s.recreate or s.change is Change.DELETE:
                    manifest.remove(target_name(n))
            manifest.setup = commit_setup(manifest.setup)
            state.publish(manifest)
        return steps

    def drop(self, report_to_stdout: bool = False) -> None:
        if report_to_stdout:
            print(f"drop {self.full_name}")
        self.state.drop()

    # updates

    def update(self) -> UpdateStats:
        """Update all targets. Calls during an update share the one that follows it."""
        return self.update_async().result()

    def update_async(self, only: set[str] | None = None) -> concurrent.futures.Future:
        """Update from the sources in ``only``, or from all. A run that has not begun takes on the sources of further calls."""
        with self._lock:
            if self._waiting is not None:
                self._wanted = None if only is None or self._wanted is None else self._wanted | only
            else:
                self._wanted = only
                self._waiting = self._pool.submit(self._update)
            return self._waiting

    def _update(self) -> UpdateStats:
        with self._lock:
            only, self._waiting = self._wanted, None
        return run_update(session(), self.define, self.state, self.name, only)

    # results

    def table(self, export: str) -> DataFrame:
        """An export's rows in its target's shape."""
        state = self.state
        e = self.builder().exports[export]
        rows = state.table(state.load(), target_name(export))
        if rows is None:
            raise FlowError(f"{export!r} was never updated")
        return e.target.shape(rows.drop("__tkey"), e)

    def graph_nodes(self, label: str) -> DataFrame:
        """Nodes of a label: exported ones and those that relationships end in."""
        builder, state = self.builder(), self.state
        manifest = state.load()
        rels, own, types = [], None, []
        for e in builder.exports.values():
            m = getattr(e.target, "mapping", None)
            rows = state.table(manifest, target_name(e.name))
            if isinstance(m, graph.Nodes) and m.label == label:
                own = (e, rows)
            elif isinstance(m, graph.Relationships):
                for end in (m.source, m.target):
                    if end.label == label:
                        rels.append(graph.end_rows(rows, end, ["__tkey"]))
                        types.append((end, dict(e.key + e.values)))
        if own:
            keys, values = [n for n, _ in own[0].key], [n for n, _ in own[0].values]
        else:
            declared = next((d for d in builder.declared if isinstance(d, graph.DeclaredNode) and d.label == label), None)
            if declared is None:
                raise FlowError(f"label {label!r} is neither exported nor declared")
            made = graph.declared_label(declared, types)
            keys, values = [n for n, _ in made.key], [n for n, _ in made.values]
        return graph.nodes(keys, own[1].drop("__tkey") if own else None, rels, values)

    def graph_relationships(self, rel_type: str) -> DataFrame:
        """Relationships of a type: key, the keys of both ends as source_ and target_ fields, and their own fields."""
        builder, state = self.builder(), self.state
        for e in builder.exports.values():
            m = getattr(e.target, "mapping", None)
            if isinstance(m, graph.Relationships) and m.rel_type == rel_type:
                ends = {f.source for end in (m.source, m.target) for f in end.fields}
                rows = state.table(state.load(), target_name(e.name))
                return rows.select(*(f"`{n}`" for n, _ in e.key), *(F.col(f"`{f.source}`").alias(f"{side}_{f.name}") for side, end in (("source", m.source), ("target", m.target)) for f in end.fields), *(f"`{n}`" for n, _ in e.values if n not in ends))
        raise FlowError(f"there is no relationship {rel_type!r}")

    # inspection

    def spec(self) -> list[dict[str, Any]]:
        from indexflow.codec import plain

        return plain(self.builder().spec)

    def schema(self) -> dict[str, Any]:
        b = self.builder()
        return {"sources": {n: t.describe() for n, (_, t, _) in b.sources.items()}, "exports": {e.name: {"key": [n for n, _ in e.key], "row": e.collector.type.describe()} for e in b.exports.values()}}

    def source_keys(self, source: str) -> DataFrame:
        b = self.builder()
        spec = b.sources[source][0]
        return spec.listing(session()).select(source_key(b.source_keys(source)).alias("__skey"), F.col("__ordinal").alias("ordinal"))

    def row_status(self, source: str) -> DataFrame:
        state, manifest = self.state, self.state.load()
        from indexflow.plans.update import TRACKING

        tracking = state.table(manifest, "tracking")
        tracking = session().createDataFrame([], TRACKING) if tracking is None else tracking.where(F.col("__src") == source)
        return row_status(self.source_keys(source), tracking, self.builder().logic_fingerprint)

    def evaluate(self) -> dict[str, DataFrame]:
        """What every export would get from all sources, without touching targets or caches: source key, error and fields."""
        b = self.builder()
        return {e.name: e.collector.rows.select(F.col(SRC).alias("__src"), F.col(KEY).alias("__skey"), F.col(ERR).alias("error"), *(f"`{n}`" for n, _ in (e.key + e.values))) for e in b.exports.values()}

    def evaluate_row(self, source: str, skey: str) -> dict[str, list[dict]]:
        b = FlowBuilder(session(), self.name)
        self.define(b)
        spec = b.sources[source][0]
        rows = spec.read(session()).where(source_key(b.source_keys(source)) == skey).drop("__ordinal")
        rest = {n: s.read(session()).limit(0).drop("__ordinal") for n, (s, _, _) in b.sources.items() if n != source}
        made = self.builder(rows={source: rows} | rest)
        return {e.name: [r.asDict(True) for r in e.collector.rows.drop("__place", "__op").collect()] for e in made.exports.values()}

    def evaluate_and_dump(self, options: EvaluateAndDumpOptions) -> int:
        """Write what each source row produces as one YAML file under ``output_dir``, in key order, and return the number of files.

        Rows are grouped and written on the executors, through the file system of the folder's URI. Names that
        are cut to the same 128 characters get numbers in order of their keys.
        """
        b = self.builder()
        frames = []
        for e in b.exports.values():
            fields = [n for n, _ in (e.key + e.values)]
            row = F.when(F.col(ERR).isNull(), F.to_json(F.struct(*(F.col(f"`{n}`") for n in fields)), {"ignoreNullFields": "false"}))
            order = F.to_json(F.struct(*(F.col(f"`{n}`") for n, _ in e.key)))
            frames.append(e.collector.rows.select(F.col(SRC).alias("src"), F.col(KEY).alias("skey"), F.lit(e.name).alias("export"), F.struct(order.alias("k"), row.alias("row")).alias("item"), F.col(ERR).alias("error")))
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        grouped = every.groupBy("src", "skey", "export").agg(F.sort_array(F.collect_list("item")).alias("items"), F.min("error").alias("error"))
        grouped = grouped.groupBy("src", "skey").agg(F.sort_array(F.collect_list(F.struct("export", F.col("items.row").alias("rows"), "error"))).alias("exports"))

        def file_names(src: pa.Array, skey: pa.Array) -> pa.Array:
            parts = lambda key: ":".join(urllib.parse.quote(str(v), safe="") for v in json.loads(key).values())
            return pa.array([f"{s}@{parts(k)}"[:128] for s, k in zip(src.to_pylist(), skey.to_pylist(), strict=True)], pa.string())

        named = grouped.withColumn("name", F.arrow_udf(file_names, "string")("src", "skey"))
        named = named.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("src", "skey"))).drop("src")
        root = options.output_dir

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import yaml

            system, folder = open_root(root)
            system.create_dir(folder, recursive=True)
            done = 0
            for batch in batches:
                for r in batch.to_pylist():
                    errors = [x["error"] for x in r["exports"] if x["error"]]
                    data: dict[str, Any] = {"source": r["name"].split("@", 1)[0], "key": json.loads(r["skey"])}
                    data |= {"error": errors[0]} if errors else {"exports": {x["export"]: [json.loads(i) for i in x["rows"]] for x in r["exports"]}}
                    name = r["name"] + (f".{r['nth'] - 1}" if r["nth"] > 1 else "")
                    with system.open_output_stream(f"{folder}/{name}.yaml", compression=None) as out:
                        out.write(yaml.safe_dump(data, allow_unicode=True, sort_keys=False).encode())
                    done += 1
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

        return named.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def describe_steps(steps: dict[str, Step]) -> str:
    return "\n".join(f"{n}: {s.change.value}" + "".join(f"\n  - {line}" for line in s.describe()) for n, s in steps.items())


def add_flow_def(name: str, define: Callable[[FlowBuilder, Any], None]) -> Flow:
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"flow name {name!r} may hold letters, digits and _ only")
    if name in _FLOWS:
        raise KeyError(f"flow {name!r} exists already")
    _FLOWS[name] = Flow(name, define)
    return _FLOWS[name]


def flow_def(name: str | None = None) -> Callable[[Callable[[FlowBuilder, Any], None]], Flow]:
    return lambda f: add_flow_def(name or f.__name__, f)


def remove_flow(name: str) -> None:
    _FLOWS.pop(name)


def flow_names() -> list[str]:
    return list(_FLOWS)


def flows() -> dict[str, Flow]:
    return dict(_FLOWS)


def flow_by_name(name: str) -> Flow:
    return _FLOWS[name]


def setup_all_flows(report_to_stdout: bool = False) -> None:
    for f in flows().values():
        f.setup(report_to_stdout)


def drop_all_flows(report_to_stdout: bool = False) -> None:
    for f in flows().values():
        f.drop(report_to_stdout)

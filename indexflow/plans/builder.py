"""Flows as DataFrames: nested scopes are exploded with their parents' columns kept, collectors are unions.

Every scope has one DataFrame. Its fields are columns named by depth, so a loop over a nested table sees
the fields of all scopes around it without a join. Hidden columns carry the source row that everything
derives from, the place in nested tables, and the first error of a row.
"""

from __future__ import annotations

import dataclasses
import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexflow.codec import to_row
from indexflow.fingerprint import fingerprint, row_fingerprint
from indexflow.functions.udf import UserFunction, match_arguments
from indexflow.types import BASIC, FieldType, basic, field_type, key_type, merge_rows, require_key, spark_field

SRC, KEY, PLACE, ERR = "__src", "__key", "__place", "__err"
HIDDEN = (SRC, KEY, PLACE, ERR)


class GeneratedField(Enum):
    UUID = "Uuid"


class FlowError(ValueError):
    pass


@dataclass
class Slice:
    """A value of a scope: a column and its type."""

    scope: Scope
    column: Column | None
    type: FieldType
    source: str | None = None
    attached: bool = False
    lineage: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Slice:
        if self.type.kind != "Struct":
            raise FlowError(f"{self.type.kind} has no fields")
        return Slice(self.scope, self.column[name], self.type.get(name).null(self.type.nullable or self.type.get(name).nullable))

    def row(self, *, max_inflight_rows: int | None = None, max_inflight_bytes: int | None = None) -> Scope:
        """The scope of this table's rows. Limits in flight are Spark's to keep and are only checked."""
        check_limits(max_inflight_rows, max_inflight_bytes)
        return self.scope.open(self)

    def for_each(self, f: Callable[[Scope], Any], **limits: int) -> None:
        with self.row(**limits) as scope:
            f(scope)

    def transform(self, fn: Any, *args: Any, **kwargs: Any) -> Slice:
        return self.scope.builder.transform(fn, self, *args, **kwargs)

    def call(self, f: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return f(self, *args, **kwargs)


def check_limits(rows: int | None, size: int | None) -> None:
    if any(x is not None and x < 1 for x in (rows, size)):
        raise FlowError("limits in flight must be positive")


class Scope:
    """The root, or one row of a table."""

    def __init__(self, builder: FlowBuilder, name: str, parent: Scope | None, df: DataFrame | None):
        self.builder, self.name, self.parent, self.df = builder, name, parent, df
        self.fields: dict[str, Slice] = {}
        self.depth = 0 if parent is None else parent.depth + 1
        self.dealt = False

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_: Any) -> None:
        return None

    def chain(self) -> list[Scope]:
        return [*(self.parent.chain() if self.parent else []), self]

    def __getitem__(self, name: str) -> Slice:
        if name not in self.fields:
            raise FlowError(f"scope {self.name} has no field {name!r}")
        return self.fields[name]

    def __setitem__(self, name: str, value: Slice) -> None:
        if name in self.fields:
            raise FlowError(f"field {name!r} is already set in scope {self.name}")
        if not isinstance(value, Slice):
            value = self.builder.constant(value)
        if value.attached:
            raise FlowError("a slice can be attached once only")
        if value.scope is not self and value.scope in self.chain():
            value = Slice(self, value.column, value.type, value.source, lineage=value.lineage)
        if value.scope is not self:
            raise FlowError(f"the slice for {name!r} belongs to scope {value.scope.name}")
        value.attached = True
        if value.source is None and self.df is not None:
            self.put(f"{self.depth}__{name}", value.column)
            value = dataclasses.replace(value, column=F.col(f"`{self.depth}__{name}`"))
        self.fields[name] = value
        self.builder.record("field", scope=self.name, name=name, type=value.type.describe())

    def put(self, column: str, value: Column) -> None:
        self.df = self.df.withColumn(column, value)

    def spread(self) -> None:
        """Before Python code runs on rows for the first time, deal them out to all tasks."""
        if not any(s.dealt for s in self.chain()):
            self.df = spread(self.df)
            self.dealt = True

    def open(self, of: Slice) -> Scope:
        t = of.type
        if not t.is_table:
            raise FlowError(f"{t.kind} is not a table")
        name = next((n for n, s in self.fields.items() if s is of or s.column is not None and s.column is of.column or of.source and s.source == of.source), "rows")
        child = Scope(self.builder, f"{name}_{self.depth + 1}", self, None)
        self.builder.record("for_each", scope=self.name, child=child.name)
        if of.source:
            child.df = self.builder.source_rows(of.source, child.depth)
        else:
            d, e = child.depth, f"{child.depth}__"
            # a row in error keeps its place with nulls below, so that the error is seen where rows are collected
            rows = F.when(F.col(ERR).isNull(), of.column).otherwise(F.array(F.lit(None)))
            df = self.df.withColumn(ERR, F.when(F.col(ERR).isNull() & of.column.isNull(), F.lit(f"{name}: the table is null")).otherwise(F.col(ERR)))
            df = df.select("*", F.posexplode(rows).alias(f"__i{d}", f"__e{d}"))
            child.df = df.withColumn(PLACE, F.concat(PLACE, F.array(F.col(f"__i{d}").cast("long")))).withColumns({e + n: F.col(f"__e{d}")[n] for n, _ in t.fields}).drop(f"__i{d}", f"__e{d}")
        for n, ft in t.fields:
            child.fields[n] = Slice(child, F.col(f"`{child.depth}__{n}`"), ft, attached=True)
        return child

    def add_collector(self, name: str | None = None) -> Collector:
        return Collector(self.builder, name or self.builder.auto("_collector"))


@dataclass
class Collector:
    """A bag of flat rows; what several collect() calls add must agree in fields and types."""

    builder: FlowBuilder
    name: str
    parts: list[DataFrame] = field(default_factory=list)
    type: FieldType | None = None
    uuid: str | None = None
    frozen: bool = False

    def collect(self, **fields: Any) -> None:
        if self.frozen:
            raise FlowError(f"{self.name} is exported already")
        made = [n for n, v in fields.items() if v is GeneratedField.UUID]
        if len(made) > 1:
            raise FlowError("a row can have one generated field")
        values = {n: v if isinstance(v, Slice) else self.builder.constant(v) for n, v in fields.items() if n not in made}
        scope = self.builder.common_scope([v.scope for v in values.values()])
        if scope.df is None:
            raise FlowError("there is no row to collect from")
        row = FieldType("Struct", fields=tuple([(n, basic("Uuid")) for n in made] + [(n, v.type) for n, v in values.items()]))
        if self.type is not None and self.uuid != (made[0] if made else None):
            self.uuid = None
        elif self.type is None:
            self.uuid = made[0] if made else None
        self.type = row if self.type is None else merge_rows(self.type, row)
        df = scope.df.select(*HIDDEN, F.lit(len(self.parts)).alias("__op"), *(v.column.alias(n, metadata=spark_field(n, v.type).metadata) for n, v in values.items()))
        if made:
            from pyspark.sql import Window

            print_ = row_fingerprint(*(F.col(f"`{n}`") for n in values)) if values else F.lit("")
            same = Window.partitionBy(SRC, KEY, "__print").orderBy(PLACE)
            df = df.withColumn("__print", print_).withColumn("__nth", F.row_number().over(same))
            h = F.md5(F.concat_ws("\n", SRC, KEY, F.lit(f"{self.name}.{len(self.parts)}"), "__print", F.col("__nth").cast("string")))
            form = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
            df = df.withColumn(made[0], form)
        self.parts.append(df.select(*HIDDEN, "__op", *(n for n, _ in row.fields)))
        self.builder.record("collect", collector=self.name, scope=scope.name, row=row.describe())

    @property
    def rows(self) -> DataFrame:
        """All rows with their hidden columns."""
        if not self.parts:
            raise FlowError(f"nothing is collected in {self.name}")
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    def export(self, name: str, target: Any, *, primary_key_fields: list[str], vector_indexes: tuple[Any, ...] | list[Any] = (), setup_by_user: bool = False) -> None:
        if not primary_key_fields:
            raise FlowError("an export needs primary_key_fields")
        if self.type is None:
            raise FlowError(f"nothing is collected in {self.name}")
        for v in vector_indexes:
            if self.type.get(v.field).kind != "Vector":
                raise FlowError(f"{v.field!r} is no vector")
        key = [(n, self.type.get(n)) for n in primary_key_fields]
        key_type(key)
        if name in self.builder.exports:
            raise FlowError(f"export {name!r} is declared twice")
        values = [(n, t) for n, t in self.type.fields if n not in primary_key_fields]
        made = Export(name, target, self, key, values, tuple(vector_indexes), setup_by_user)
        if hasattr(target, "validate"):
            target.validate(made)
        for other in self.builder.exports.values():
            if target == other.target and getattr(target, "resource", lambda e: None)(made) == getattr(other.target, "resource", lambda e: 0)(other):
                raise FlowError(f"exports {other.name!r} and {name!r} have the same target")
        self.frozen = True
        self.builder.exports[name] = made
        self.builder.record("export", name=name, target=target, kind=type(target).__name__, key=primary_key_fields, indexes=list(vector_indexes))


@dataclass
class Export:
    name: str
    target: Any
    collector: Collector
    key: list[tuple[str, FieldType]]
    values: list[tuple[str, FieldType]]
    vector_indexes: tuple[Any, ...] = ()
    setup_by_user: bool = False

    @property
    def stable(self) -> bool:
        """Whether equal rows keep their key, so that their values may be compared."""
        return self.collector.uuid not in [n for n, _ in self.key]


class FlowBuilder:
    """What a flow's definition gets. ``rows`` replaces what a source would read, as an update does with changed rows."""

    def __init__(self, spark: SparkSession, name: str = "flow", rows: dict[str, DataFrame] | None = None, memo: Any = None):
        self.spark, self.name, self.overrides, self.memo = spark, name, rows or {}, memo
        self.sources: dict[str, tuple[Any, FieldType, Any]] = {}
        self.exports: dict[str, Export] = {}
        self.declared: list[Any] = []
        self.spec: list[dict[str, Any]] = []
        self.counts: dict[str, int] = {}
        self.scope = Scope(self, "root", None, None)

    def record(self, what: str, **details: Any) -> None:
        self.spec.append({"what": what} | details)

    @property
    def logic_fingerprint(self) -> str:
        return fingerprint(self.spec)

    def auto(self, kind: str) -> str:
        self.counts[kind] = self.counts.get(kind, -1) + 1
        return f"{kind}_{self.counts[kind]}"

    def add_source(self, spec: Any, *, name: str | None = None, refresh_interval: Any = None, max_inflight_rows: int | None = None, max_inflight_bytes: int | None = None) -> Slice:
        check_limits(max_inflight_rows, max_inflight_bytes)
        name = name or self.auto(re.sub(r"(?<!^)(?=[A-Z])", "_", type(spec).__name__).lower())
        if name in self.sources:
            raise FlowError(f"source {name!r} is declared twice")
        t = spec.fields(self.spark)
        if t.kind != "KTable":
            raise FlowError("a source is a keyed table")
        self.sources[name] = (spec, t, refresh_interval)
        self.record("source", name=name, kind=type(spec).__name__, spec=spec, type=t.describe())
        return Slice(self.scope, None, t, source=name)

    def source_keys(self, name: str) -> list[str]:
        spec, t, _ = self.sources[name]
        return getattr(spec, "keys", [t.fields[0][0]])

    def source_rows(self, name: str, depth: int) -> DataFrame:
        spec, t, _ = self.sources[name]
        df = self.overrides[name] if name in self.overrides else spec.read(self.spark)
        key = source_key(self.source_keys(name))
        return df.select(F.lit(name).alias(SRC), key.alias(KEY), F.array().cast("array<long>").alias(PLACE), F.lit(None).cast("string").alias(ERR), *(F.col(f"`{n}`").cast(loose(ft.spark)).alias(f"{depth}__{n}") for n, ft in t.fields))

    def add_direct_input(self, name: str, type_: Any) -> Slice:
        t = type_ if isinstance(type_, FieldType) else field_type(type_)
        if self.scope.df is None:
            raise FlowError("direct inputs belong to transform flows")
        out = Slice(self.scope, F.col(f"`0__{name}`"), t, attached=True)
        self.scope.fields[name] = out
        return out

    def constant(self, value: Any) -> Slice:
        if isinstance(value, Slice):
            return value
        if isinstance(value, Enum):
            value = value.value
        t = constant_type(value)
        column = F.lit(None) if value is None else F.lit(value if t.kind in ("Str", "Bool", "Int64", "Float64", "Bytes", "Date") else to_row(value, t)) if t.kind in BASIC and t.kind != "Range" else F.from_json(F.lit(__import__("json").dumps(to_row(value, t))), t.spark)
        return Slice(self.scope, column.cast(t.spark) if value is not None else column, t)

    def common_scope(self, scopes: list[Scope]) -> Scope:
        """The deepest of some scopes, which must lie on one chain."""
        deepest = max(scopes, key=lambda s: s.depth, default=self.scope)
        for s in scopes:
            if s not in deepest.chain():
                raise FlowError(f"scopes {s.name} and {deepest.name} are not inside one another")
        return deepest

    def transform(self, fn: Any, *args: Any, **kwargs: Any) -> Slice:
        if not args:
            raise FlowError("transform() needs an argument at least")
        if isinstance(fn, type):
            fn = fn()
        if isinstance(fn, TransformFlow):
            return fn(*args, **kwargs)
        if isinstance(fn, UserFunction):
            params = dict(fn.signature.parameters)
        else:
            names = fn.parameters or tuple(f"arg{i}" for i in range(len(args)))
            params = {n: inspect.Parameter(n, inspect.Parameter.POSITIONAL_OR_KEYWORD, default=None) for n in names}
        given = {n: self.constant(v) for n, v in match_arguments(fn.name, params, args, kwargs).items() if not (v is None and not isinstance(fn, UserFunction))}
        scope = self.common_scope([s.scope for s in given.values()])
        if scope.df is None:
            raise FlowError(f"{fn.name} is used outside any row")
        if any(s.source for s in given.values()):
            raise FlowError("a source is used through row()")
        columns = {n: (s.column, s.type) for n, s in given.items()}
        at = f"{scope.depth}__{self.auto(re.sub(r'(?<!^)(?=[A-Z])', '_', fn.name).lower())}"
        if isinstance(fn, UserFunction) or getattr(fn, "in_python", False):
            scope.spread()
        if isinstance(fn, UserFunction):
            t, made = fn.column(columns)
            raw = f"{at}__raw"
            if fn.cache and self.memo is not None:
                scope.df = self.memo.apply(scope.df, raw, fn, t, columns, made)
            else:
                scope.put(raw, made)
            value, error = F.col(f"`{raw}`.value"), F.col(f"`{raw}`.error")
        else:
            t, value, error = fn.column(columns)
        if error is not None:
            scope.put(ERR, F.coalesce(F.col(ERR), error))
        if fn.relationship:
            kind, arg = fn.relationship
            t = dataclasses.replace(t, attrs=((kind.value, next((n for n, s in scope.fields.items() if s is given.get(arg)), arg)),))
        self.record("transform", scope=scope.name, op=fn.name, version=getattr(fn, "behavior_version", None), spec=getattr(fn, "spec", None) or repr(fn) if not isinstance(fn, UserFunction) else fn.spec, args=sorted(given), type=t.describe())
        scope.put(at, value)
        return Slice(scope, F.col(f"`{at}`"), t)

    def declare(self, spec: Any) -> None:
        self.declared.append(spec)
        self.record("declare", spec=spec, kind=type(spec).__name__)


def spread(df: DataFrame) -> DataFrame:
    """Rows over as many partitions as tasks run at once, where the plan says that the input is small; a large one is left as it is."""
    most, session = df.sparkSession.sparkContext.defaultParallelism, df.sparkSession._jsparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(most) if size <= most * session.sessionState().conf().filesMaxPartitionBytes() else df


def loose(t: T.DataType) -> T.DataType:
    """The same type with nulls allowed everywhere, which any column of it can be cast to."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(loose(t.elementType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, loose(f.dataType), True) for f in t])
    return t


def source_key(keys: list[str]) -> Column:
    """A source row's key as text: canonical JSON of its key fields."""
    return F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys)), {"ignoreNullFields": "false"})


def constant_type(value: Any) -> FieldType:
    if value is None:
        return basic("Str", True)
    if isinstance(value, (list, tuple)):
        return FieldType("Vector", elem=constant_type(value[0]) if value else basic("Str"))
    return field_type(type(value))


class TransformFlow:
    """A part of a flow by itself: usable in flows, and on plain values through eval()."""

    def __init__(self, f: Callable[..., Slice]):
        self.f, self.name = f, f.__name__
        import typing

        self.hints = {}
        for n, h in typing.get_type_hints(f, include_extras=True).items():
            if n != "return":
                inner = [a for a in typing.get_args(h) if not isinstance(a, str)]
                self.hints[n] = inner[0] if typing.get_origin(h) is DataSlice else h

    def __call__(self, *args: Any, **kwargs: Any) -> Slice:
        return self.f(*args, **kwargs)

    def over(self, df: DataFrame, types: dict[str, FieldType] | None = None) -> tuple[FieldType, DataFrame]:
        """Its result, in column ``result`` with an ``error``, for every row of arguments."""
        builder = FlowBuilder(df.sparkSession, self.name)
        builder.scope.df = df.select(F.lit("").alias(SRC), F.lit("").alias(KEY), F.array().cast("array<long>").alias(PLACE), F.lit(None).cast("string").alias(ERR), *(F.col(f"`{n}`").alias(f"0__{n}") for n in df.columns))
        types = types or {n: field_type(h) for n, h in self.hints.items()}
        out = self.f(**{n: builder.add_direct_input(n, types[n]) for n in df.columns})
        return out.type, out.scope.df.select(out.column.alias("result"), F.col(ERR).alias("error"))

    def eval(self, spark: SparkSession, *args: Any, **kwargs: Any) -> Any:
        """The result for some values; a failing function raises."""
        from indexflow.codec import from_row

        given = dict(zip(self.hints, args, strict=False)) | kwargs
        types = {n: field_type(self.hints[n]) for n in given}
        df = spark.createDataFrame([tuple(to_row(v, types[n]) for n, v in given.items())], T.StructType([spark_field(n, types[n].null()) for n in given]))
        t, made = self.over(df, types)
        row = made.first()
        if row["error"]:
            raise RuntimeError(row["error"])
        value = row["result"]
        return from_row(value.asDict(True) if hasattr(value, "asDict") else [v.asDict(True) if hasattr(v, "asDict") else v for v in value] if isinstance(value, list) else value, t)

    async def eval_async(self, spark: SparkSession, *args: Any, **kwargs: Any) -> Any:
        import asyncio

        return await asyncio.to_thread(self.eval, spark, *args, **kwargs)


class DataSlice:
    """For annotations: ``DataSlice[str]`` is a slice of that type."""

    def __class_getitem__(cls, of: Any) -> Any:
        return of


def transform_flow() -> Callable[[Callable[..., Slice]], TransformFlow]:
    return TransformFlow


def require_keys(fields: list[tuple[str, FieldType]]) -> None:
    for n, t in fields:
        require_key(t, n)

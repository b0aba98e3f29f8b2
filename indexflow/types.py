"""Field types: Python annotations, their Spark types, and the rules for keys and merging."""

from __future__ import annotations

import dataclasses
import datetime
import inspect
import types
import typing
import uuid
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import types as T


class Marker(str):
    """Tells apart annotations that share a Python type."""


Range = typing.Annotated[tuple[int, int], Marker("Range")]
Float32 = typing.Annotated[float, Marker("Float32")]
LocalDateTime = typing.Annotated[datetime.datetime, Marker("LocalDateTime")]
Json = typing.Annotated[Any, Marker("Json")]


class Vector:
    """``Vector[float]``, or ``Vector[float, 3]`` with a fixed dimension."""

    def __class_getitem__(cls, of: Any) -> Any:
        elem, dim = of if isinstance(of, tuple) else (of, None)
        return typing.Annotated[list[elem], Marker("Vector"), dim]


BASIC: dict[str, T.DataType] = {
    "Bytes": T.BinaryType(),
    "Str": T.StringType(),
    "Bool": T.BooleanType(),
    "Int64": T.LongType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Range": T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]),
    "Uuid": T.StringType(),
    "Date": T.DateType(),
    "Time": T.LongType(),  # microseconds since midnight: Parquet has no writer for Spark's time type
    "LocalDateTime": T.TimestampNTZType(),
    "OffsetDateTime": T.TimestampType(),
    "TimeDelta": T.DayTimeIntervalType(),
    "Json": T.StringType(),  # canonical text, which can be hashed and joined on
}
KEY_KINDS = {"Bytes", "Str", "Bool", "Int64", "Range", "Uuid", "Date"}
WIDENED = {("Float32", "Float64"), ("LocalDateTime", "OffsetDateTime")}
PLAIN = {bytes: "Bytes", str: "Str", bool: "Bool", int: "Int64", float: "Float64", uuid.UUID: "Uuid", datetime.date: "Date", datetime.time: "Time", datetime.datetime: "OffsetDateTime", datetime.timedelta: "TimeDelta", np.int64: "Int64", np.float32: "Float32", np.float64: "Float64", Any: "Json"}


@dataclass(frozen=True)
class FieldType:
    """kind: a basic kind, Vector, Union, Struct, KTable or LTable. A KTable's first field is its key."""

    kind: str
    nullable: bool = False
    elem: FieldType | None = None
    dim: int | None = None
    options: tuple[FieldType, ...] = ()
    fields: tuple[tuple[str, FieldType], ...] = ()
    attrs: tuple[tuple[str, str], ...] = field(default=(), compare=False)
    python: Any = field(default=None, compare=False, repr=False)
    doc: str | None = field(default=None, compare=False)

    @property
    def is_table(self) -> bool:
        return self.kind in ("KTable", "LTable")

    @property
    def row(self) -> FieldType:
        """The struct of a table's rows."""
        return dataclasses.replace(self, kind="Struct", nullable=False)

    def null(self, nullable: bool = True) -> FieldType:
        return dataclasses.replace(self, nullable=nullable)

    @property
    def spark(self) -> T.DataType:
        if self.kind in BASIC:
            return BASIC[self.kind]
        if self.kind == "Vector":
            return T.ArrayType(self.elem.spark, False)
        if self.kind == "Union":
            return T.StructType([T.StructField("tag", T.IntegerType(), False)] + [T.StructField(f"v{i}", o.spark) for i, o in enumerate(self.options)])
        row = T.StructType([spark_field(n, t) for n, t in self.fields])
        return row if self.kind == "Struct" else T.ArrayType(row, False)

    def get(self, name: str) -> FieldType:
        for n, t in self.fields:
            if n == name:
                return t
        raise KeyError(f"there is no field {name!r} in {[n for n, _ in self.fields]}")

    def describe(self) -> dict:
        """The type as plain data, for fingerprints and the service."""
        out: dict[str, Any] = {"kind": self.kind, "nullable": self.nullable}
        if self.elem:
            out |= {"element": self.elem.describe(), "dimension": self.dim}
        if self.options:
            out["options"] = [o.describe() for o in self.options]
        if self.fields:
            out["fields"] = [{"name": n} | t.describe() for n, t in self.fields]
        return out | ({"attrs": dict(self.attrs)} if self.attrs else {})


def basic(kind: str, nullable: bool = False) -> FieldType:
    if kind not in BASIC:
        raise TypeError(f"{kind} is not a basic type")
    return FieldType(kind, nullable)


def struct(**fields: FieldType) -> FieldType:
    return FieldType("Struct", fields=tuple(fields.items()))


def table(kind: str, **fields: FieldType) -> FieldType:
    out = FieldType(kind, fields=tuple(fields.items()))
    if kind == "KTable":
        require_key(out.fields[0][1], out.fields[0][0])
    return out


def spark_field(name: str, t: FieldType) -> T.StructField:
    """A column; what Spark's type doesn't say is in its metadata."""
    meta = dict(t.attrs)
    if t.kind in ("Uuid", "Time", "Json", "Union", "KTable", "LTable"):
        meta["logical"] = t.kind
    if t.dim is not None:
        meta["dim"] = t.dim
    return T.StructField(name, t.spark, t.nullable, meta or None)


def from_spark(t: T.DataType, nullable: bool = False, meta: dict | None = None) -> FieldType:
    """The field type of a Spark column; what has no counterpart is an error."""
    meta = meta or {}
    logical = meta.get("logical")
    if logical in BASIC:
        return FieldType(logical, nullable)
    if isinstance(t, T.StructType):
        if t.fieldNames() == ["start", "end"] and all(isinstance(f.dataType, T.LongType) for f in t):
            return FieldType("Range", nullable)
        return FieldType("Struct", nullable, fields=tuple((f.name, from_spark(f.dataType, f.nullable, f.metadata)) for f in t))
    if isinstance(t, T.ArrayType):
        elem = from_spark(t.elementType)
        if elem.kind == "Struct":
            return FieldType(logical or "LTable", nullable, fields=elem.fields)
        return FieldType("Vector", nullable, elem=elem, dim=meta.get("dim"))
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return FieldType("Int64", nullable)
    for kind, own in BASIC.items():
        if own == t and kind not in ("Uuid", "Time", "Json"):
            return FieldType(kind, nullable)
    raise TypeError(f"{t.simpleString()} has no counterpart")


def is_struct(t: Any) -> bool:
    return isinstance(t, type) and (dataclasses.is_dataclass(t) or issubclass(t, tuple) and hasattr(t, "_fields"))


def field_type(annotation: Any) -> FieldType:
    """The type that a Python annotation stands for."""
    origin, args, marks = typing.get_origin(annotation), typing.get_args(annotation), ()
    if origin is typing.Annotated:
        annotation, marks = args[0], args[1:]
        kind = next((m for m in marks if isinstance(m, Marker)), None)
        if kind == "Vector":
            return vector_of(typing.get_args(annotation)[0], marks[1])
        if kind:
            return FieldType(str(kind))
        return field_type(annotation)
    if annotation in PLAIN if not isinstance(annotation, (list, dict)) else False:
        return FieldType(PLAIN[annotation])
    if origin in (typing.Union, types.UnionType):
        options = [a for a in args if a is not type(None)]
        if len(options) < len(args):
            inner = field_type(options[0]) if len(options) == 1 else field_type(typing.Union[tuple(options)])
            return inner.null()
        return FieldType("Union", options=tuple(field_type(a) for a in options))
    if origin is tuple and args == (int, int):
        return FieldType("Range")
    if origin is list:
        if is_struct(args[0]):
            return dataclasses.replace(field_type(args[0]), kind="LTable")
        return vector_of(args[0], None)
    if origin is np.ndarray:
        return vector_of(typing.get_args(args[1])[0], None)
    if origin is dict:
        if not is_struct(args[1]):
            raise TypeError(f"{annotation}: a keyed table's values are structs")
        key = field_type(args[0])
        require_key(key, "key")
        return dataclasses.replace(field_type(args[1]), kind="KTable", fields=(("key", key), *field_type(args[1]).fields))
    if is_struct(annotation):
        hints = typing.get_type_hints(annotation, include_extras=True)
        names = [f.name for f in dataclasses.fields(annotation)] if dataclasses.is_dataclass(annotation) else annotation._fields
        doc = inspect.getdoc(annotation) if annotation.__doc__ and not annotation.__doc__.startswith(f"{annotation.__name__}(") else None
        return FieldType("Struct", fields=tuple((n, field_type(hints[n])) for n in names), python=annotation, doc=doc)
    raise TypeError(f"{annotation!r} is not a supported type")


def vector_of(elem: Any, dim: int | None) -> FieldType:
    inner = field_type(elem)
    if inner.kind not in BASIC and inner.kind not in ("Union", "Vector"):
        raise TypeError(f"a vector can't hold {inner.kind}")
    return FieldType("Vector", elem=inner, dim=dim)


def require_key(t: FieldType, name: str) -> None:
    """Raise unless ``t`` can be a key: not null, and of a key kind or a struct of those."""
    if t.nullable or (any(require_key(f, f"{name}.{n}") for n, f in t.fields) if t.kind == "Struct" else t.kind not in KEY_KINDS):
        raise TypeError(f"{name}: {'a nullable ' if t.nullable else ''}{t.kind} can't be a key")


def same_type(a: FieldType, b: FieldType) -> bool:
    """Equal but for nullability."""
    return dataclasses.replace(a, nullable=False) == dataclasses.replace(b, nullable=False)


def accepts(want: FieldType, got: FieldType) -> bool:
    """Whether an argument of type ``got`` may be passed: the same type, or one of two widenings."""
    return same_type(want, got) or (got.kind, want.kind) in WIDENED


def merge_rows(a: FieldType, b: FieldType) -> FieldType:
    """The row type of two collected rows: the same names in the same order, the same types; nullable if either is."""
    if [n for n, _ in a.fields] != [n for n, _ in b.fields]:
        raise TypeError(f"rows to collect differ in fields: {[n for n, _ in a.fields]} and {[n for n, _ in b.fields]}")
    out = []
    for (name, x), (_, y) in zip(a.fields, b.fields, strict=True):
        if not same_type(x, y):
            raise TypeError(f"field {name!r} has two types: {x.kind} and {y.kind}")
        out.append((name, dataclasses.replace(x, nullable=x.nullable or y.nullable, attrs=tuple(v for v in x.attrs if v in y.attrs))))
    return dataclasses.replace(a, fields=tuple(out))


def key_type(fields: list[tuple[str, FieldType]]) -> FieldType:
    """The key of some fields: the bare type of one, a struct of several, in the order given."""
    for name, t in fields:
        require_key(t, name)
    return fields[0][1] if len(fields) == 1 else FieldType("Struct", fields=tuple(fields))

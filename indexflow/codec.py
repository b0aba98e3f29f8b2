"""Values between Python objects, Spark rows and JSON, and keys as text parts."""

from __future__ import annotations

import base64
import dataclasses
import datetime
import json
import uuid
from typing import Any

from indexflow.duration import format_duration, parse_duration
from indexflow.types import FieldType

UTC = datetime.timezone.utc
MIDNIGHT = datetime.datetime(2000, 1, 1)


def to_json(value: Any, t: FieldType) -> Any:
    """A value as plain JSON data."""
    if value is None:
        if not t.nullable:
            raise ValueError(f"a {t.kind} must not be null")
        return None
    match t.kind:
        case "Bytes":
            return base64.b64encode(value).decode()
        case "Range":
            return list(value)
        case "Uuid":
            return str(value).lower()
        case "Date" | "Time":
            return value.isoformat()
        case "LocalDateTime":
            return value.strftime("%Y-%m-%dT%H:%M:%S.%f")
        case "OffsetDateTime":
            return (value if value.tzinfo else value.replace(tzinfo=UTC)).isoformat()
        case "TimeDelta":
            return format_duration(value)
        case "Vector":
            if t.dim is not None and len(value) != t.dim:
                raise ValueError(f"a vector of {t.dim} has {len(value)} components")
            return [to_json(v, t.elem) for v in value]
        case "Union":
            for tag, option in enumerate(t.options):
                if fits(value, option):
                    return [tag, to_json(value, option)]
            raise ValueError(f"{value!r} is of none of the union's types")
        case "Struct":
            return {n: to_json(member(value, n), f) for n, f in t.fields}
        case "LTable":
            return [to_json(v, t.row) for v in value]
        case "KTable":
            key = t.fields[0][1]
            rest = dataclasses.replace(t.row, fields=t.fields[1:])
            return [{t.fields[0][0]: to_json(k, key)} | to_json(v, rest) for k, v in value.items()]
    return float(value) if t.kind.startswith("Float") else value


def fits(value: Any, t: FieldType) -> bool:
    kinds = {"Bytes": bytes, "Str": str, "Bool": bool, "Float32": float, "Float64": float, "Range": tuple, "Uuid": uuid.UUID, "Time": datetime.time, "TimeDelta": datetime.timedelta, "Vector": list}
    if t.kind == "Int64":
        return isinstance(value, int) and not isinstance(value, bool)
    if t.kind == "Date":
        return isinstance(value, datetime.date) and not isinstance(value, datetime.datetime)
    if t.kind in ("LocalDateTime", "OffsetDateTime"):
        return isinstance(value, datetime.datetime)
    if t.kind == "Vector":
        return isinstance(value, (list, tuple)) and all(fits(v, t.elem) for v in value)
    if t.kind == "Struct":
        return t.python is None or isinstance(value, t.python)
    return t.kind == "Json" or isinstance(value, kinds[t.kind])


def member(value: Any, name: str) -> Any:
    return value.get(name) if isinstance(value, dict) else getattr(value, name)


def from_json(data: Any, t: FieldType) -> Any:
    """The Python value of plain JSON data; a null or missing value is an error unless the type is nullable."""
    if data is None:
        if not t.nullable:
            raise ValueError(f"a {t.kind} must not be null")
        return None
    match t.kind:
        case "Bytes":
            return base64.b64decode(data, validate=True)
        case "Range":
            start, end = data
            return int(start), int(end)
        case "Uuid":
            return uuid.UUID(data)
        case "Date":
            return datetime.date.fromisoformat(data)
        case "Time":
            return datetime.time.fromisoformat(data)
        case "LocalDateTime":
            return datetime.datetime.fromisoformat(data)
        case "OffsetDateTime":
            at = datetime.datetime.fromisoformat(data)
            return at if at.tzinfo else at.replace(tzinfo=UTC)
        case "TimeDelta":
            return parse_duration(data)
        case "Vector":
            if t.dim is not None and len(data) != t.dim:
                raise ValueError(f"a vector of {t.dim} has {len(data)} components")
            return [from_json(v, t.elem) for v in data]
        case "Union":
            tag, inner = data
            return from_json(inner, t.options[tag])
        case "Struct":
            return build({n: data.get(n) for n, _ in t.fields if n in data}, t, from_json)
        case "LTable":
            return [from_json(v, t.row) for v in data]
        case "KTable":
            name, key = t.fields[0]
            rest = dataclasses.replace(t.row, fields=t.fields[1:])
            return {from_json(v[name], key): from_json(v, rest) for v in data}
        case "Int64" if isinstance(data, bool) or not isinstance(data, int):
            raise ValueError(f"{data!r} is no integer")
        case "Str" if not isinstance(data, str):
            raise ValueError(f"{data!r} is no text")
        case "Bool" if not isinstance(data, bool):
            raise ValueError(f"{data!r} is no truth value")
    return float(data) if t.kind.startswith("Float") else data


def build(values: dict[str, Any], t: FieldType, decode: Any) -> Any:
    """A struct's Python object by field name: further values are ignored, missing ones take the default."""
    made = {n: decode(values[n], f) for n, f in t.fields if n in values}
    cls = t.python if isinstance(t.python, type) else None
    missing = [n for n, f in t.fields if n not in made]
    if cls is None:
        for n in missing:
            if not t.get(n).nullable:
                raise ValueError(f"field {n!r} is missing")
        return made | dict.fromkeys(missing)
    try:
        return cls(**made)
    except TypeError as bad:
        raise ValueError(f"{cls.__name__}: {bad}") from bad


def to_row(value: Any, t: FieldType) -> Any:
    """A Python value as Spark holds it."""
    if value is None:
        return None
    match t.kind:
        case "Range":
            return {"start": int(value[0]), "end": int(value[1])}
        case "Uuid":
            return str(value).lower()
        case "Time":
            return (datetime.datetime.combine(MIDNIGHT, value) - MIDNIGHT) // datetime.timedelta(microseconds=1)
        case "OffsetDateTime":
            return value if value.tzinfo else value.replace(tzinfo=UTC)
        case "Json":
            return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        case "Vector":
            if t.dim is not None and len(value) != t.dim:
                raise ValueError(f"a vector of {t.dim} has {len(value)} components")
            return [to_row(v, t.elem) for v in (value.tolist() if hasattr(value, "tolist") else value)]
        case "Union":
            tag = next((i for i, o in enumerate(t.options) if fits(value, o)), None)
            if tag is None:
                raise ValueError(f"{value!r} is of none of the union's types")
            return {"tag": tag} | {f"v{i}": to_row(value, o) if i == tag else None for i, o in enumerate(t.options)}
        case "Struct":
            return {n: to_row(member(value, n), f) for n, f in t.fields}
        case "LTable":
            return [to_row(v, t.row) for v in value]
        case "KTable":
            (name, key), rest = t.fields[0], dataclasses.replace(t.row, fields=t.fields[1:])
            return [{name: to_row(k, key)} | to_row(v, rest) for k, v in value.items()]
        case "Float32" | "Float64":
            return float(value)
        case "Int64":
            return int(value)
    return value


def from_row(value: Any, t: FieldType) -> Any:
    """The Python value of what Spark holds."""
    if value is None:
        return None
    match t.kind:
        case "Range":
            return value["start"], value["end"]
        case "Uuid":
            return uuid.UUID(value)
        case "Time":
            return (MIDNIGHT + datetime.timedelta(microseconds=value)).time()
        case "Json":
            return json.loads(value)
        case "Vector":
            return [from_row(v, t.elem) for v in value]
        case "Union":
            return from_row(value[f"v{value['tag']}"], t.options[value["tag"]])
        case "Struct":
            return build(dict(value), t, from_row)
        case "LTable":
            return [from_row(v, t.row) for v in value]
        case "KTable":
            (name, key), rest = t.fields[0], dataclasses.replace(t.row, fields=t.fields[1:])
            return {from_row(v[name], key): from_row(v, rest) for v in value}
    return value


def key_parts(key: Any, t: FieldType) -> list[str]:
    """A key as text parts: a range has two, a struct those of its fields, bytes are base64."""
    match t.kind:
        case "Range":
            return [str(key[0]), str(key[1])]
        case "Struct":
            return [p for n, f in t.fields for p in key_parts(member(key, n), f)]
        case "Bytes":
            return [base64.b64encode(key).decode()]
        case "Bool":
            return ["true" if key else "false"]
        case "Date":
            return [key.isoformat()]
    return [str(key)]


def key_from_parts(parts: list[str], t: FieldType) -> Any:
    """The key of text parts; too few or too many are an error."""
    left = list(parts)

    def take(t: FieldType) -> Any:
        if t.kind == "Struct":
            return build({n: take(f) for n, f in t.fields}, t, lambda v, _: v)
        try:
            text = left.pop(0)
            if t.kind == "Range":
                return int(text), int(left.pop(0))
        except IndexError:
            raise ValueError("a part of the key is missing") from None
        if t.kind == "Int64":
            return int(text)
        if t.kind == "Bool":
            return {"true": True, "false": False}[text]
        return from_json(text, t)

    out = take(t)
    if left:
        raise ValueError(f"the key has further parts: {left}")
    return out


def plain(value: Any) -> Any:
    """Settings objects as plain data: enums by value, durations as seconds and nanoseconds, fields that are None or don't count for equality left out."""
    if isinstance(value, datetime.timedelta):
        whole = value // datetime.timedelta(seconds=1)
        return {"secs": whole, "nanos": (value - datetime.timedelta(seconds=whole)).microseconds * 1000}
    if hasattr(value, "value") and hasattr(type(value), "__members__"):
        return value.value
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(v) for f in dataclasses.fields(value) if f.compare and (v := getattr(value, f.name)) is not None}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def json_schema(t: FieldType, *, strict: bool = True, describe: bool = True) -> dict:
    """The JSON schema of a type: with ``strict`` every field is required and nothing else allowed."""
    base: dict[str, Any]
    formats = {"Uuid": "uuid", "Date": "date", "Time": "time", "LocalDateTime": "date-time", "OffsetDateTime": "date-time", "TimeDelta": "duration"}
    match t.kind:
        case "Str" | "Bytes":
            base = {"type": "string"} | ({"contentEncoding": "base64"} if t.kind == "Bytes" else {})
        case "Bool":
            base = {"type": "boolean"}
        case "Int64":
            base = {"type": "integer"}
        case "Float32" | "Float64":
            base = {"type": "number"}
        case "Range":
            base = {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 2}
        case "Json":
            base = {}
        case "Vector":
            base = {"type": "array", "items": json_schema(t.elem, strict=strict, describe=describe)} | ({"minItems": t.dim, "maxItems": t.dim} if t.dim is not None else {})
        case "Union":
            base = {"oneOf": [json_schema(o, strict=strict, describe=describe) for o in t.options]}
        case "Struct":
            fields = {n: json_schema(f, strict=strict, describe=describe) for n, f in t.fields}
            base = {"type": "object", "properties": fields, "required": [n for n, f in t.fields if strict or not f.nullable], "additionalProperties": False}
        case "KTable" | "LTable":
            base = {"type": "array", "items": json_schema(t.row, strict=strict, describe=describe)}
        case _:
            base = {"type": "string", "format": formats[t.kind]}
    if describe and t.doc:
        base["description"] = t.doc
    if t.nullable and "type" in base:
        base["type"] = [base["type"], "null"]
    elif t.nullable and "oneOf" in base:
        base["oneOf"].append({"type": "null"})
    return base



"""Targets of exports. Each keeps a keyed table; collections and graphs are shapes of such tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexflow.operators.graph import Nodes, Relationships
from indexflow.operators.vector import METRICS
from indexflow.types import FieldType


@dataclass(frozen=True)
class VectorIndex:
    field: str
    metric: str = "cosine"

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"{self.metric!r} is none of {METRICS}")


def fixed_vector(t: FieldType) -> bool:
    return t.kind == "Vector" and t.dim is not None and t.elem.kind in ("Float32", "Float64", "Int64")


@dataclass(frozen=True)
class Table:
    """A relational table: keyed rows with a column for each field."""

    table_name: str | None = None
    database: str | None = None

    def resource(self, export: Any) -> tuple:
        return "table", self.database, self.table_name or export.name

    def validate(self, export: Any) -> None:
        for v in export.vector_indexes:
            if not fixed_vector(dict(export.values).get(v.field) or dict(export.key)[v.field]):
                raise ValueError(f"{v.field!r} has no fixed dimension, so it can't be indexed")

    def index_names(self, export: Any) -> list[str]:
        ops = {"cosine": "vector_cosine_ops", "l2": "vector_l2_ops", "ip": "vector_ip_ops"}
        return [f"{self.table_name or export.name}__{v.field}__{ops[v.metric]}" for v in export.vector_indexes]

    def shape(self, rows: DataFrame, export: Any) -> DataFrame:
        return rows


@dataclass(frozen=True)
class VectorCollection:
    """A vector store's collection: points with one key, named vectors of floats, and all else as a JSON payload."""

    collection_name: str
    connection: str | None = None

    def resource(self, export: Any) -> tuple:
        return "collection", self.connection, self.collection_name

    def validate(self, export: Any) -> None:
        if len(export.key) != 1 or export.key[0][1].kind not in ("Str", "Int64", "Uuid"):
            raise ValueError("a collection has one key field, of kind Str, Int64 or Uuid")
        seen = set()
        for v in export.vector_indexes:
            if v.field in seen:
                raise ValueError(f"{v.field!r} has two metrics")
            seen.add(v.field)
            if not fixed_vector(dict(export.values)[v.field]):
                raise ValueError(f"{v.field!r} is no vector of a fixed dimension")

    def metrics(self, export: Any) -> dict[str, str]:
        given = {v.field: v.metric for v in export.vector_indexes}
        return {n: given.get(n, "cosine") for n, t in export.values if fixed_vector(t)}

    def shape(self, rows: DataFrame, export: Any) -> DataFrame:
        vectors = [n for n, t in export.values if fixed_vector(t)]
        rest = [n for n, t in export.values if not fixed_vector(t)]
        payload = F.to_json(F.struct(*(F.col(f"`{n}`") for n in rest)), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
        return rows.select(F.col(f"`{export.key[0][0]}`").alias("id"), *(F.col(f"`{n}`").cast("array<float>").alias(n) for n in vectors), payload.alias("payload"))


@dataclass(frozen=True)
class Graph:
    """Nodes or relationships of a property graph."""

    mapping: Nodes | Relationships
    connection: str | None = None

    def resource(self, export: Any) -> tuple:
        name = self.mapping.label if isinstance(self.mapping, Nodes) else self.mapping.rel_type
        return "graph", self.connection, type(self.mapping).__name__, name

    def shape(self, rows: DataFrame, export: Any) -> DataFrame:
        return rows

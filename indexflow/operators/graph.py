"""Property graphs as tables: nodes of a label by key, relationships with the keys of their ends.

The state is declared, not mutated: a node is there while a row exports it (it stands by itself) or
while a relationship ends in it, so removing rows collects orphans without a separate pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexflow.types import FieldType, require_key, same_type


@dataclass(frozen=True)
class TargetFieldMapping:
    source: str
    target: str | None = None

    @property
    def name(self) -> str:
        return self.target or self.source


@dataclass(frozen=True)
class NodeFromFields:
    label: str
    fields: tuple[TargetFieldMapping, ...]


@dataclass(frozen=True)
class Nodes:
    label: str


@dataclass(frozen=True)
class Relationships:
    rel_type: str
    source: NodeFromFields
    target: NodeFromFields


@dataclass(frozen=True)
class DeclaredNode:
    label: str
    primary_key_fields: tuple[str, ...]
    vector_indexes: tuple = field(default=())


@dataclass(frozen=True)
class Label:
    """A node label's schema: its key and other fields."""

    name: str
    key: tuple[tuple[str, FieldType], ...]
    values: tuple[tuple[str, FieldType], ...]


def check_end(end: NodeFromFields, fields: dict[str, FieldType], labels: dict[str, Label], keys: list[str]) -> None:
    """Raise unless an end's mapping fits its label: all key fields, all or none of the others, known fields, equal types."""
    if end.label not in labels:
        raise ValueError(f"label {end.label!r} is neither exported nor declared")
    label = labels[end.label]
    mapped: dict[str, FieldType] = {}
    for m in end.fields:
        if m.source in keys:
            raise ValueError(f"{m.source!r} is part of the relationship's key and can't be an end's field")
        if m.source not in fields:
            raise ValueError(f"there is no field {m.source!r}")
        mapped[m.name] = fields[m.source]
    missing = [n for n, _ in label.key if n not in mapped]
    if missing:
        raise ValueError(f"{end.label}: key fields {missing} aren't mapped")
    values = [n for n, _ in label.values]
    given = [n for n in mapped if n not in [k for k, _ in label.key]]
    if unknown := [n for n in given if n not in values]:
        raise ValueError(f"{end.label} has no fields {unknown}")
    if given and set(given) != set(values):
        raise ValueError(f"{end.label}: map all fields but the key or none of them")
    for n, t in (*label.key, *label.values):
        if n in mapped and not same_type(mapped[n], t):
            raise ValueError(f"{end.label}.{n} is {t.kind}, not {mapped[n].kind}")


def declared_label(node: DeclaredNode, ends: list[tuple[NodeFromFields, dict[str, FieldType]]]) -> Label:
    """The schema of a label that only relationships mention, taken from the ends that mention it."""
    fields: dict[str, FieldType] = {}
    for end, types in ends:
        for m in end.fields if end.label == node.label else ():
            if m.name in fields and not same_type(fields[m.name], types[m.source]):
                raise ValueError(f"{node.label}.{m.name} has two types")
            fields.setdefault(m.name, types[m.source])
    for k in node.primary_key_fields:
        if k not in fields:
            raise ValueError(f"no relationship maps {node.label}.{k}")
        require_key(fields[k], k)
    return Label(node.label, tuple((k, fields[k]) for k in node.primary_key_fields), tuple((n, t) for n, t in fields.items() if n not in node.primary_key_fields))


def end_rows(rows: DataFrame, end: NodeFromFields, order: list[str]) -> DataFrame:
    """The nodes that one end of relationship rows mentions, with what ranks them."""
    return rows.select(*(F.col(f"`{m.source}`").alias(m.name) for m in end.fields), F.struct(*order).alias("__order"))


def nodes(label_keys: list[str], exported: DataFrame | None, mentioned: list[DataFrame], values: list[str]) -> DataFrame:
    """Nodes of a label by key with self_contained, whether a row exports the node.

    An exported node's own fields win; among mentions, the fields of the first in order that has any.
    """
    parts = []
    rank = lambda df, own: df.select(*label_keys, F.struct(*(F.col(v) if v in df.columns else F.lit(None).alias(v) for v in values)).alias("__v") if values else F.lit(None).alias("__v"), F.lit(own).alias("__own"), F.col("__order") if "__order" in df.columns else F.lit(None).alias("__order"))
    if exported is not None:
        parts.append(rank(exported, True).withColumn("__order", F.lit("").cast("string")))
    parts += [rank(m, False).withColumn("__order", F.to_json("__order")) for m in mentioned]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    with_values = F.to_json("__v") != "{}" if values else F.lit(False)
    best = F.min_by("__v", F.struct(F.when(F.col("__own"), 0).when(with_values, 1).otherwise(2), "__order"))
    out = every.groupBy(*label_keys).agg(F.max("__own").alias("self_contained"), *([best.alias("__v")] if values else []))
    return out.select(*label_keys, *(F.col(f"__v.{v}").alias(v) for v in values), "self_contained")


def collect_orphans(tagged: DataFrame, key: str, ends: DataFrame) -> DataFrame:
    """Nodes that stand by themselves or in which a relationship ends (``ends`` has that key)."""
    used = ends.select(key).distinct().withColumn("__used", F.lit(True))
    return tagged.join(used, key, "left").where("self_contained or __used").drop("__used")

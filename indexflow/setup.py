"""Setup of targets: desired against existing state, described and applied in two phases."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any


class Change(Enum):
    NO_CHANGE = "no change"
    CREATE = "create"
    UPDATE = "update"
    DELETE = "delete"
    INVALID = "invalid"


class Compatibility(Enum):
    COMPATIBLE = "compatible"
    PARTIAL = "partial"
    NOT_COMPATIBLE = "not compatible"


@dataclass
class TableState:
    """A target's columns and indexes, as plain types by name."""

    key: dict[str, str]
    values: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)


@dataclass
class Combined:
    """What is known to exist, and what changes were begun. Until they are committed any version may be there."""

    current: TableState | None = None
    staging: list[TableState | None] = field(default_factory=list)

    def possible(self) -> list[TableState]:
        return [s for s in (self.current, *self.staging) if s is not None]

    def always_exists(self) -> bool:
        return self.current is not None and all(s is not None for s in self.staging)


def compatibility(desired: TableState, existing: TableState) -> Compatibility:
    """Whether rows in an existing table stay valid: other keys lose all, a column dropped or retyped loses part."""
    if list(desired.key.items()) != list(existing.key.items()):
        return Compatibility.NOT_COMPATIBLE
    lossy = any(desired.values.get(n) != t for n, t in existing.values.items())
    return Compatibility.PARTIAL if lossy else Compatibility.COMPATIBLE


@dataclass
class Step:
    """What makes one target as desired."""

    change: Change
    recreate: bool = False
    create: TableState | None = None
    drop_columns: list[str] = field(default_factory=list)
    add_columns: dict[str, str] = field(default_factory=dict)
    drop_indexes: list[str] = field(default_factory=list)
    add_indexes: dict[str, str] = field(default_factory=dict)

    def describe(self) -> list[str]:
        if self.change is Change.DELETE:
            return ["drop the table"]
        out = ["drop the table and its data"] if self.recreate else []
        if self.create:
            out.append(f"create the table with key ({', '.join(f'{n} {t}' for n, t in self.create.key.items())}) and columns ({', '.join(f'{n} {t}' for n, t in self.create.values.items())})")
        out += [f"drop column {n}" for n in self.drop_columns] + [f"add column {n} {t}" for n, t in self.add_columns.items()]
        return out + [f"drop index {n}" for n in self.drop_indexes] + [f"create index {n} {d}" for n, d in self.add_indexes.items()]


def diff(desired: TableState | None, existing: Combined) -> Step:
    """The step from any version that may exist to the desired one. An update of an index is dropping and creating it."""
    versions = existing.possible()
    if desired is None:
        return Step(Change.DELETE if versions else Change.NO_CHANGE)
    had = {n: {v.indexes.get(n) for v in versions} for v in versions for n in v.indexes}
    if not versions:
        return Step(Change.CREATE, create=desired, add_indexes=dict(desired.indexes))
    if any(list(v.key.items()) != list(desired.key.items()) for v in versions) or not existing.always_exists():
        return Step(Change.UPDATE, recreate=True, create=desired, drop_indexes=sorted(had), add_indexes=dict(desired.indexes))
    types = {n: {v.values.get(n) for v in versions} for v in versions for n in v.values}
    drop = sorted(n for n, kinds in types.items() if n not in desired.values or kinds - {None, desired.values[n]})
    add = {n: t for n, t in desired.values.items() if types.get(n) != {t}}
    lost = sorted(n for n, kinds in had.items() if kinds != {desired.indexes.get(n)})
    made = {n: d for n, d in desired.indexes.items() if had.get(n) != {d}}
    step = Step(Change.UPDATE, drop_columns=drop, add_columns=add, drop_indexes=lost, add_indexes=made)
    return step if any((drop, add, lost, made)) else Step(Change.NO_CHANGE)


def desired_state(export: Any) -> TableState:
    names = export.target.index_names(export) if hasattr(export.target, "index_names") else [v.field for v in export.vector_indexes]
    kind = lambda t: t.spark.simpleString()
    return TableState({n: kind(t) for n, t in export.key}, {n: kind(t) for n, t in export.values}, {n: f"{v.field} {v.metric}" for n, v in zip(names, export.vector_indexes, strict=True)})


def load_combined(data: dict[str, Any] | None) -> Combined:
    make = lambda d: None if d is None else TableState(**d)
    return Combined() if not data else Combined(make(data.get("current")), [make(s) for s in data.get("staging", [])])


def plan_setup(builder: Any, known: dict[str, Any]) -> dict[str, Step]:
    """The step for every target that is wanted or known; those set up by the user are only checked."""
    out = {}
    for e in builder.exports.values():
        have = load_combined(known.get(e.name))
        want = desired_state(e)
        if e.setup_by_user:
            fits = all(compatibility(want, v) is not Compatibility.NOT_COMPATIBLE for v in have.possible())
            out[e.name] = Step(Change.NO_CHANGE if fits else Change.INVALID)
        else:
            out[e.name] = diff(want, have)
    return out | {n: diff(None, load_combined(c)) for n, c in known.items() if n not in builder.exports and not n.startswith("__")}


def stage_setup(known: dict[str, Any], builder: Any, steps: dict[str, Step]) -> dict[str, Any]:
    """The known state with the desired one begun: what is written before anything is changed."""
    out = {n: dict(c) for n, c in known.items()}
    for n, step in steps.items():
        if step.change not in (Change.NO_CHANGE, Change.INVALID):
            want = None if step.change is Change.DELETE else asdict(desired_state(builder.exports[n]))
            entry = out.setdefault(n, {"current": None, "staging": []})
            entry["staging"] = [*entry["staging"], want]
    return out


def commit_setup(known: dict[str, Any]) -> dict[str, Any]:
    """The known state once all changes are made: the last one begun is the current one."""
    out = {}
    for n, c in known.items():
        current = c["staging"][-1] if c.get("staging") else c.get("current")
        if current is not None:
            out[n] = {"current": current, "staging": []}
    return out


def next_ids(desired: TableState, known: Combined, target_id: int, schema_version: int, newest: int) -> tuple[int, int]:
    """Ids after a setup: the target keeps its id unless no version is compatible; the schema's version rises unless all are fully."""
    kinds = [compatibility(desired, v) for v in known.possible()]
    if not kinds or Compatibility.NOT_COMPATIBLE in kinds:
        return newest + 1, 1
    return target_id, schema_version + (Compatibility.PARTIAL in kinds)

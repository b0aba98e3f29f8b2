"""User functions: plain ones, and executors with a spec, as Arrow UDFs that report errors row by row."""

from __future__ import annotations

import asyncio
import inspect
import threading
import typing
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from indexflow.codec import from_row, to_row
from indexflow.fingerprint import fingerprint
from indexflow.types import FieldType, accepts, field_type

#: One call at a time for functions that use a GPU, in each worker.
GPU = threading.Lock()
#: Calls of a function that waits for a service that a worker has under way at once, and values of one request.
CONCURRENT, REQUEST = 16, 64
#: Rows, and bytes of arguments, that a function gets as Python objects at once.
PART_ROWS, PART_BYTES = 1024, 4 << 20
_EXECUTORS: dict[str, Any] = {}


def in_turn() -> Any:
    """The lock of this process's GPU calls."""
    return GPU


def ready_executor(token: str, prepare: Callable[[], Callable[..., Any]]) -> Callable[..., Any]:
    """The prepared executor of this process."""
    if token not in _EXECUTORS:
        _EXECUTORS[token] = prepare()
    return _EXECUTORS[token]


class ArgRelationship(Enum):
    EMBEDDING_ORIGIN_TEXT = "embedding_origin_text"
    CHUNKS_BASE_TEXT = "chunk_base_text"
    RECTS_BASE_IMAGE = "rects_base_image"


def camel(name: str) -> str:
    return "".join(w.capitalize() for w in name.split("_"))


def match_arguments(name: str, params: dict[str, inspect.Parameter], args: tuple, kwargs: dict[str, Any]) -> dict[str, Any]:
    """Arguments by parameter name, *args as name.0, name.1 ...; what is missing, unknown or given twice is an error."""
    kinds = inspect.Parameter
    slots = [p for p in params.values() if p.kind in (kinds.POSITIONAL_ONLY, kinds.POSITIONAL_OR_KEYWORD)]
    rest = next((p.name for p in params.values() if p.kind is kinds.VAR_POSITIONAL), None)
    extra = any(p.kind is kinds.VAR_KEYWORD for p in params.values())
    out: dict[str, Any] = {}
    for i, value in enumerate(args):
        if i < len(slots):
            out[slots[i].name] = value
        elif rest:
            out[f"{rest}.{i - len(slots)}"] = value
        else:
            raise TypeError(f"{name} takes {len(slots)} positional arguments, not {len(args)}")
    for key, value in kwargs.items():
        if key in out:
            raise TypeError(f"{name} got argument {key!r} twice")
        if key not in params and not extra or key in params and params[key].kind in (kinds.VAR_POSITIONAL, kinds.VAR_KEYWORD, kinds.POSITIONAL_ONLY):
            raise TypeError(f"{name} has no argument {key!r}")
        out[key] = value
    for p in params.values():
        if p.kind not in (kinds.VAR_POSITIONAL, kinds.VAR_KEYWORD) and p.default is kinds.empty and p.name not in out:
            raise TypeError(f"{name} lacks argument {p.name!r}")
    return out


@dataclass
class UserFunction:
    """A function that a flow can call on slices."""

    name: str
    call: Callable[..., Any]
    signature: inspect.Signature
    hints: dict[str, Any]
    returns: Any
    cache: bool = False
    behavior_version: int | None = None
    gpu: bool = False
    relationship: tuple[ArgRelationship, str] | None = None
    prepare: Callable[[], Callable[..., Any]] | None = None
    spec: Any = None
    #: Calls wait for a service: a worker makes several at once.
    waits: bool = False
    #: The executor takes lists of its one argument and gives lists of results.
    many: bool = False
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if self.cache and self.behavior_version is None:
            raise ValueError(f"{self.name}: a cached function needs a behavior_version")

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        return self.call(*args, **kwargs)

    @property
    def identity(self) -> dict[str, Any]:
        """What says that results of two runs are the same function's."""
        return {"op": self.name, "spec": self.spec, "version": self.behavior_version}

    def result(self, types: dict[str, FieldType]) -> FieldType:
        """The type of the result; arguments' types must be those of the annotations, a null argument making it nullable."""
        loose = False
        for name, got in types.items():
            base = name.split(".")[0]
            if base not in self.hints:
                continue
            want = field_type(self.hints[base])
            if not accepts(want, got):
                raise TypeError(f"{self.name}: argument {name!r} must be {want.kind}, not {got.kind}")
            loose |= got.nullable and not want.nullable
        out = self.returns(types) if callable(self.returns) and getattr(self.returns, "dynamic", False) else field_type(self.returns)
        return out.null() if loose else out

    def column(self, args: dict[str, tuple[Column, FieldType]]) -> tuple[FieldType, Column]:
        """The result type and a column struct<value, error>. An argument that is null without being allowed makes a null result."""
        types = {n: t for n, (_, t) in args.items()}
        out = self.result(types)
        names = list(args)
        required = [n for n in names if n.split(".")[0] in self.hints and not field_type(self.hints[n.split(".")[0]]).nullable]
        inner = T.StructType([T.StructField("value", out.spark), T.StructField("error", T.StringType())])
        arrow = to_arrow_type(inner)
        call, prepare, token, gpu = self.call, self.prepare, self.token, self.gpu
        python = {n: field_type(self.hints[n.split(".")[0]]) if n.split(".")[0] in self.hints else t for n, t in types.items()}

        waits, many = self.waits, self.many

        def failed(bad: Exception) -> dict[str, Any]:
            return {"value": None, "error": f"{type(bad).__name__}: {bad}"[:2000]}

        def kept(got: Any) -> dict[str, Any]:
            if got is None and not out.nullable:
                raise ValueError("the result must not be null")
            return {"value": to_row(got, out), "error": None}

        def one(run: Callable[..., Any], values: dict[str, Any]) -> Any:
            """A row's result, or what to await for it. A row's failure is kept with the row."""
            try:
                if any(values[n] is None for n in required):
                    return {"value": None, "error": None}
                decoded = {n: from_row(v, python[n]) for n, v in values.items()}
                spread = [v for n, v in decoded.items() if "." in n]
                named = {n: v for n, v in decoded.items() if "." not in n}
                got = run(*named.values(), *spread) if spread else run(**named)
                return awaited(got) if inspect.isawaitable(got) else kept(got)
            except Exception as bad:
                return failed(bad)

        async def awaited(got: Any) -> dict[str, Any]:
            try:
                return kept(await got)
            except Exception as bad:
                return failed(bad)

        def requests(run: Callable[[list], list], rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
            """Results of rows asked for together; where a request fails its rows are asked for one by one."""
            (name,), made = names, [{"value": None, "error": None} for _ in rows]
            asked = [i for i, r in enumerate(rows) if r[name] is not None or name not in required]

            def ask(part: list[int]) -> None:
                try:
                    got = run([from_row(rows[i][name], python[name]) for i in part])
                    if len(got) != len(part):
                        raise ValueError(f"{len(part)} values got {len(got)} results")
                    made_now = [kept(g) for g in got]
                except Exception as bad:
                    if len(part) == 1:
                        made[part[0]] = failed(bad)
                    else:
                        for i in part:
                            ask([i])
                    return
                for i, m in zip(part, made_now, strict=True):
                    made[i] = m

            with ThreadPoolExecutor(CONCURRENT if waits else 1) as pool:
                list(pool.map(ask, [asked[i : i + REQUEST] for i in range(0, len(asked), REQUEST)]))
            return made

        def results(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
            run = call if prepare is None else ready_executor(token, prepare)
            if many:
                return requests(run, rows)
            if waits:
                with ThreadPoolExecutor(CONCURRENT) as pool:
                    made = list(pool.map(lambda r: one(run, r), rows))
            else:
                made = [one(run, r) for r in rows]
            return asyncio.run(_gather(made)) if any(inspect.isawaitable(m) for m in made) else made

        def part(*columns: pa.Array) -> pa.Array:
            rows = [dict(zip(names, r, strict=True)) for r in zip(*(c.to_pylist() for c in columns), strict=True)]
            if gpu:
                with in_turn():
                    return pa.array(results(rows), arrow)
            return pa.array(results(rows), arrow)

        def batch(*columns: pa.Array) -> pa.Array:
            """Part by part, so that a worker holds no more than a part as Python objects beside the Arrow data."""
            n, size = len(columns[0]), sum(c.nbytes for c in columns)
            step = max(PART_ROWS, n * PART_BYTES // max(size, 1)) if waits or many else max(1, min(PART_ROWS, n * PART_BYTES // max(size, 1)))
            made = [part(*(c.slice(i, step) for c in columns)) for i in range(0, max(n, 1), step)]
            return made[0] if len(made) == 1 else pa.concat_arrays(made)

        return out, F.arrow_udf(batch, inner)(*(c for c, _ in args.values()))


async def _wait(got: Any) -> Any:
    return await got


async def _gather(made: list[Any]) -> list[Any]:
    """Results in order, no more than CONCURRENT of those to await under way at once."""
    room = asyncio.Semaphore(CONCURRENT)

    async def take(m: Any) -> Any:
        if not inspect.isawaitable(m):
            return m
        async with room:
            return await m

    return list(await asyncio.gather(*map(take, made)))


def _hints(f: Callable[..., Any], skip: tuple[str, ...] = ()) -> tuple[inspect.Signature, dict[str, Any], Any]:
    hints = typing.get_type_hints(f, include_extras=True)
    signature = inspect.signature(f)
    signature = signature.replace(parameters=[p for n, p in signature.parameters.items() if n not in skip])
    return signature, {n: t for n, t in hints.items() if n != "return" and n not in skip and t is not Any}, hints.get("return", Any)


def function(*, gpu: bool = False, cache: bool = False, behavior_version: int | None = None, arg_relationship: tuple[ArgRelationship, str] | None = None) -> Callable[[Callable[..., Any]], UserFunction]:
    """Make a typed Python function, sync or async, usable in flows under its CamelCase name."""

    def make(f: Callable[..., Any]) -> UserFunction:
        signature, hints, returns = _hints(f)
        return UserFunction(camel(f.__name__), f, signature, hints, returns, cache, behavior_version, gpu, arg_relationship)

    return make


def executor_class(*, gpu: bool = False, cache: bool = False, behavior_version: int | None = None, arg_relationship: tuple[ArgRelationship, str] | None = None) -> Callable[[type], Callable[..., UserFunction]]:
    """Make a class with a ``spec`` usable in flows: analyze() may give the result type, prepare() runs once a worker, __call__ once a row."""

    def make(cls: type) -> Callable[..., UserFunction]:
        spec_type = typing.get_type_hints(cls)["spec"]
        signature, hints, returns = _hints(cls.__call__, ("self",))

        def build(spec: Any = None, **options: Any) -> UserFunction:
            own = spec if spec is not None else spec_type(**options)

            def ready() -> Any:
                made = cls()
                made.spec = own
                if hasattr(made, "prepare"):
                    got = made.prepare()
                    if inspect.isawaitable(got):
                        asyncio.run(_wait(got))
                return made

            def dynamic(types: dict[str, FieldType]) -> FieldType:
                made = cls()
                made.spec = own
                got = made.analyze(**types)
                return got if isinstance(got, FieldType) else field_type(got)

            dynamic.dynamic = True
            return UserFunction(spec_type.__name__, lambda *a, **k: ready()(*a, **k), signature, hints, dynamic if hasattr(cls, "analyze") else returns, cache, behavior_version, gpu, arg_relationship, ready, own, fingerprint([cls.__module__, cls.__qualname__, own]))

        return build

    return make

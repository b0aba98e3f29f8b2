"""The built-in functions. Each checks its arguments' types and gives a column of values and maybe one of errors."""

from __future__ import annotations

import base64
import hashlib
import inspect
import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from indexflow.codec import from_json, json_schema
from indexflow.functions.chunker import CustomLanguage, separators, split_column
from indexflow.functions.udf import ArgRelationship, UserFunction
from indexflow.types import FieldType, accepts, basic, field_type, same_type, struct, table

Args = dict[str, tuple[Column, FieldType]]


def expect(op: str, args: Args, name: str, kind: str, *, optional: bool = False) -> Column | None:
    """The column of an argument of exactly that kind."""
    if name not in args:
        if optional:
            return None
        raise TypeError(f"{op} lacks argument {name!r}")
    column, got = args[name]
    if not same_type(basic(kind), got):
        raise TypeError(f"{op}: argument {name!r} must be {kind}, not {got.kind}")
    return column


@dataclass(frozen=True)
class SplitRecursively:
    """Chunks of a text, keyed by their range."""

    custom_languages: tuple[CustomLanguage, ...] = ()
    name = "SplitRecursively"
    in_python = True
    parameters = ("text", "chunk_size", "min_chunk_size", "chunk_overlap", "language")
    relationship = (ArgRelationship.CHUNKS_BASE_TEXT, "text")

    def column(self, args: Args) -> tuple[FieldType, Column, Column | None]:
        separators(None, self.custom_languages)
        text, size = expect(self.name, args, "text", "Str"), expect(self.name, args, "chunk_size", "Int64")
        least, overlap, language = (expect(self.name, args, n, k, optional=True) for n, k in (("min_chunk_size", "Int64"), ("chunk_overlap", "Int64"), ("language", "Str")))
        at = struct(offset=basic("Int64"), line=basic("Int64"), column=basic("Int64"))
        out = table("KTable", location=basic("Range"), text=basic("Str"), start=at, end=at)
        return out.null(args["text"][1].nullable), split_column(text, size, least, overlap, language, self.custom_languages), None


@dataclass(frozen=True)
class ParseJson:
    """The value that a text in JSON stands for, as canonical text with sorted keys; other languages count as JSON. Malformed text is an error of its row."""

    name = "ParseJson"
    parameters = ("text", "language")
    relationship = None

    def column(self, args: Args) -> tuple[FieldType, Column, Column | None]:
        text = expect(self.name, args, "text", "Str")
        expect(self.name, args, "language", "Str", optional=True)
        # Spark's parser stops behind the first value: a mark that the text can't hold shows that nothing came between
        mark = F.xxhash64(text).cast("string")
        parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
        whole = F.try_variant_get(parsed, "$[1]", "string").eqNullSafe(mark)
        value = F.when(whole, F.try_variant_get(parsed, "$[0]", "variant").cast("string"))
        bad = F.when(text.isNotNull() & ~whole, F.lit("ParseJson: malformed text"))
        return basic("Json", args["text"][1].nullable), value, bad


#: Fixed default dimensions of embedding models.
MODEL_DIMENSIONS = {
    "openai": {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536},
    "voyage": {"voyage-3-large": 1024, "voyage-3.5": 1024, "voyage-3.5-lite": 1024, "voyage-code-3": 1024, "voyage-finance-2": 1024, "voyage-law-2": 1024, "voyage-code-2": 1536, "voyage-3": 1024, "voyage-3-lite": 512, "voyage-multilingual-2": 1024, "voyage-large-2-instruct": 1024, "voyage-large-2": 1536, "voyage-2": 1024},
    "gemini": {"gemini-embedding-001": 3072, "text-embedding-004": 768, "embedding-001": 768},
}
EMBEDDERS = {"openai", "ollama", "gemini", "voyage", "vertexai"}
GENERATORS = {"openai", "ollama", "gemini", "vertexai", "anthropic", "litellm", "openrouter", "vllm"}


def hash_embedding(text: str, dim: int) -> list[float]:
    """A unit vector that depends on the words alone: the stand-in where no model can be reached."""
    v = np.zeros(dim)
    for word in text.split():
        h = hashlib.blake2b(word.lower().encode(), digest_size=8).digest()
        v[int.from_bytes(h[:6], "little") % dim] += 1 if h[7] & 1 else -1
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).tolist()


def stand_in(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """A client that gives hash embeddings, for trials and tests."""
    return lambda texts: [hash_embedding(t, dim) for t in texts]


def retried(call: Callable[[], Any], *, tries: int = 10, first: float = 1.0, most: float = 60.0, retry: Callable[[Exception], bool] = lambda _: True) -> Any:
    """Call again after failures, each time after a longer pause."""
    pause = first
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except Exception as bad:
            if not left or not retry(bad):
                raise
            time.sleep(pause * random.uniform(0.9, 1.1))
            pause = min(most, pause * random.uniform(1.6, 2.0))


def EmbedText(api_type: str, model: str, *, output_dimension: int | None = None, task_type: str | None = None, address: str | None = None, client: Callable[[list[str]], list[list[float]]] | None = None) -> UserFunction:  # noqa: N802
    """Text to a vector by a service. ``client`` makes a request for several texts; ``stand_in(dim)`` is one that asks no service."""
    kind = api_type.lower()
    if kind not in EMBEDDERS:
        raise ValueError(f"{api_type} has no embeddings")
    dim = output_dimension or MODEL_DIMENSIONS.get(kind, {}).get(model)
    if not dim:
        raise ValueError(f"the dimension of {model!r} isn't known; give output_dimension")
    return _embedder("EmbedText", {"api_type": kind, "model": model, "dim": dim, "task": task_type, "address": address}, dim, client)


def SentenceTransformerEmbed(model: str, args: dict[str, Any] | None = None, *, output_dimension: int = 384) -> UserFunction:  # noqa: N802
    """Text to a vector by a local model, loaded once a worker; where the library isn't installed rows fail."""

    def load() -> Callable[[list[str]], list[list[float]]]:
        from sentence_transformers import SentenceTransformer

        own = SentenceTransformer(model, **(args or {}))
        return lambda texts: own.encode(texts).tolist()

    return _embedder("SentenceTransformerEmbed", {"model": model, "args": args, "dim": output_dimension}, output_dimension, None, load)


def _embedder(name: str, spec: dict[str, Any], dim: int, client: Any, load: Callable[[], Any] | None = None) -> UserFunction:
    from indexflow.types import Float32, Vector

    def ready() -> Callable[[list[str]], list[list[float]]]:
        ask = load() if load else client
        if ask is None:
            raise RuntimeError(f"{name}: no client is set")
        return lambda texts: retried(lambda: ask(texts))

    def embed(text: str) -> Vector[Float32, dim]:
        return ready()([text])[0]

    if load is None and client is None:
        raise ValueError(f"{name} needs a client; stand_in(dim) is one for trials")
    return UserFunction(name, embed, inspect.signature(embed), {"text": str}, Vector[Float32, dim], True, 1, load is not None, (ArgRelationship.EMBEDDING_ORIGIN_TEXT, "text"), ready, spec, waits=load is None, many=True)


@dataclass(frozen=True)
class LlmSpec:
    api_type: str
    model: str
    address: str | None = None
    client: Callable[[dict], str] | None = field(default=None, compare=False)


def ExtractByLlm(llm_spec: LlmSpec, output_type: Any, instruction: str | None = None) -> UserFunction:  # noqa: N802
    """Structured data from a text, an image or both. The request's schema wraps what is no object in {"value": ...}."""
    if llm_spec.api_type.lower() not in GENERATORS:
        raise ValueError(f"{llm_spec.api_type} doesn't generate text")
    want = field_type(output_type)
    schema = json_schema(want)
    wrapped = schema.get("type") != "object"
    if wrapped:
        schema = {"type": "object", "properties": {"value": schema}, "required": ["value"], "additionalProperties": False}
    ask = llm_spec.client

    def extract(text: str | None = None, image: bytes | None = None) -> Any:
        if text is None and image is None:
            raise ValueError("either a text or an image must be given")
        if ask is None:
            raise RuntimeError(f"no client for {llm_spec.api_type} is set")
        request = {"model": llm_spec.model, "system": instruction, "text": text, "schema": schema}
        if image is not None:
            request |= {"image": base64.b64encode(image).decode(), "mime": image_mime(image)}
        answer = json.loads(retried(lambda: ask(request)))
        return from_json(answer["value"] if wrapped else answer, want)

    return UserFunction("ExtractByLlm", extract, inspect.signature(extract), {"text": str | None, "image": bytes | None}, output_type, True, 1, spec={"api_type": llm_spec.api_type, "model": llm_spec.model, "address": llm_spec.address, "instruction": instruction, "schema": schema}, waits=True)


#: Fixed leading bytes of image formats.
IMAGE_MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"))


def image_mime(data: bytes) -> str:
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    for magic, mime in IMAGE_MAGIC:
        if data.startswith(magic):
            return mime
    raise ValueError("the image's format isn't known")


@dataclass(frozen=True)
class ColumnFunction:
    """Any Spark expression as a function: ``call`` takes columns, ``returns`` is an annotation or a field type.

    A flow's logic knows it by its name, type and ``behavior_version``, which should rise when the expression changes.
    """

    call: Callable[..., Column]
    returns: Any
    name: str = "ColumnFunction"
    parameters: tuple[str, ...] | None = None
    takes: tuple[FieldType, ...] | None = None
    behavior_version: int | None = None
    relationship = None

    @property
    def spec(self) -> dict[str, Any]:
        out = self.returns if isinstance(self.returns, FieldType) else field_type(self.returns)
        return {"name": self.name, "returns": out.describe()}

    def column(self, args: Args) -> tuple[FieldType, Column, Column | None]:
        for want, (n, (_, got)) in zip(self.takes or (), args.items(), strict=False):
            if not accepts(want, got):
                raise TypeError(f"{self.name}: argument {n!r} must be {want.kind}, not {got.kind}")
        out = self.returns if isinstance(self.returns, FieldType) else field_type(self.returns)
        return out, self.call(*(c for c, _ in args.values())), None

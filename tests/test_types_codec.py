import dataclasses
import datetime
import uuid
from typing import Any, NamedTuple

import numpy as np
import pytest
from numpy.typing import NDArray
from pyspark.sql import types as T

from indexflow import codec
from indexflow.duration import format_duration, parse_duration
from indexflow.fingerprint import fingerprint
from indexflow.types import Float32, Json, LocalDateTime, Range, Vector, accepts, basic, field_type, from_spark, key_type, merge_rows, require_key, struct


@dataclasses.dataclass
class Tag:
    """A tag."""

    name: str


@dataclasses.dataclass
class Order:
    order_id: str
    name: str
    price: float
    extra_field: str = "default_extra"


@dataclasses.dataclass
class Customer:
    name: str
    order: Order
    tags: list[Tag] | None = None


class OrderTuple(NamedTuple):
    order_id: str
    price: float


KEY_VALUES = [(bytes, b"key1"), (int, 1), (bool, True), (Range, (1, 10)), (datetime.date, datetime.date(2023, 1, 1)), (uuid.UUID, uuid.UUID(int=7)), (str, "K1")]
VALUES = KEY_VALUES + [
    (Range, (50, 50)), (float, 1.5), (Float32, 0.5), (datetime.time, datetime.time(10, 30, 50, 123456)), (LocalDateTime, datetime.datetime(2025, 1, 2, 3, 4, 5, 123456)),
    (datetime.datetime, datetime.datetime(2025, 1, 2, 3, 4, 5, tzinfo=datetime.timezone(datetime.timedelta(hours=5)))), (datetime.timedelta, datetime.timedelta(days=-5, hours=-2)),
    (datetime.timedelta, datetime.timedelta(0)), (Json, {"b": [1, None], "a": "x"}), (Vector[int, 5], [1, 2, 3, 4, 5]), (Vector[Float32], []), (list[str], ["a"]), (int | None, None),
    (str | int, 5), (str | int, "five"), (Order, Order("O123", "mixed nuts", 25.0)), (OrderTuple, OrderTuple("O1", 2.0)), (Customer, Customer("c", Order("a", "b", 1.0), [Tag("t")])),
    (Customer, Customer("c", Order("a", "b", 1.0))), (dict[str, Order], {"K1": Order("O1", "item1", 10.0)}), (list[Order], [Order("a", "b", 1.0)]),
]


@pytest.mark.parametrize(("annotation", "value"), VALUES)
def test_values_round_trip_through_json_and_rows(annotation, value):
    t = field_type(annotation)
    assert codec.from_json(codec.to_json(value, t), t) == value
    assert codec.from_row(codec.to_row(value, t), t) == value


@pytest.mark.parametrize(("annotation", "value"), KEY_VALUES)
def test_keys_round_trip_through_parts(annotation, value):
    t = field_type(annotation)
    require_key(t, "k")
    assert codec.key_from_parts(codec.key_parts(value, t), t) == value


def test_composite_keys_keep_their_order_and_parts():
    t = key_type([("b", basic("Int64")), ("r", basic("Range"))])
    assert [n for n, _ in t.fields] == ["b", "r"]
    assert codec.key_parts({"b": 3, "r": (1, 2)}, t) == ["3", "1", "2"]
    assert codec.key_from_parts(["3", "1", "2"], t) == {"b": 3, "r": (1, 2)}
    with pytest.raises(ValueError):
        codec.key_from_parts(["3", "1"], t)
    with pytest.raises(ValueError):
        codec.key_from_parts(["3", "1", "2", "4"], t)


def test_structs_ignore_further_fields_and_fill_defaults():
    t = field_type(Order)
    assert codec.from_json({"order_id": "1", "name": "n", "price": 2, "more": 0}, t) == Order("1", "n", 2.0)
    with pytest.raises(ValueError):
        codec.from_json({"order_id": "1"}, t)
    with pytest.raises(ValueError):
        codec.from_json({"order_id": None, "name": "n", "price": 2}, t)


def test_vectors_of_the_wrong_length_and_nulls_are_errors():
    with pytest.raises(ValueError):
        codec.from_json([1.0], field_type(Vector[Float32, 3]))
    with pytest.raises(ValueError):
        codec.to_json(None, basic("Str"))


def test_naive_times_count_as_utc():
    t = basic("OffsetDateTime")
    assert codec.from_json("2025-01-02T03:04:05", t) == datetime.datetime(2025, 1, 2, 3, 4, 5, tzinfo=datetime.timezone.utc)


def test_annotations():
    assert field_type(NDArray[np.float32]).elem.kind == "Float32"
    assert field_type(Any).kind == "Json"
    assert field_type(dict[str, Tag]).spark == T.ArrayType(T.StructType([T.StructField("key", T.StringType(), False), T.StructField("name", T.StringType(), False)]), False)
    assert field_type(Tag).doc == "A tag."
    for bad in (dict[float, Tag], dict[str, int], object):
        with pytest.raises(TypeError):
            field_type(bad)


def test_key_kinds_merging_and_widening():
    for kind in ("Float64", "Time", "Json", "TimeDelta", "OffsetDateTime"):
        with pytest.raises(TypeError):
            require_key(basic(kind), "k")
    with pytest.raises(TypeError):
        require_key(basic("Str", True), "k")
    a, b = struct(x=basic("Int64"), y=basic("Str")), struct(x=basic("Int64", True), y=basic("Str"))
    assert merge_rows(a, b).get("x").nullable
    for other in (struct(y=basic("Str"), x=basic("Int64")), struct(x=basic("Str"), y=basic("Str"))):
        with pytest.raises(TypeError):
            merge_rows(a, other)
    assert accepts(basic("Float64"), basic("Float32")) and accepts(basic("OffsetDateTime"), basic("LocalDateTime"))
    assert not accepts(basic("Str"), basic("Int64")) and not accepts(basic("Float32"), basic("Float64"))
    assert from_spark(T.IntegerType()).kind == "Int64"
    with pytest.raises(TypeError):
        from_spark(T.MapType(T.StringType(), T.StringType()))


def test_json_schema_is_strict_and_nullable():
    s = codec.json_schema(field_type(Customer))
    assert s["required"] == ["name", "order", "tags"] and s["additionalProperties"] is False
    assert s["properties"]["tags"]["type"] == ["array", "null"]
    assert codec.json_schema(field_type(Customer), strict=False)["required"] == ["name", "order"]


VALID = {
    "P1D": 86400, "-P1D": -86400, "P0D": 0, "PT0S": 0, "PT0H0M0S": 0, "PT1.5S": 1.5, "PT441010.456123S": 441010.456123, "PT0.000001S": 1e-6, "P1.5D": 129600, "P1.25Y": 39420000, "P2.75M": 7128000, "P0.5W": 302400,
    "-P1.5D": -129600, "-P0.25Y": -7884000, "P1.5DT2.5H3.5M4.5S": 138814.5, "PT1.5S2.5S": 4, "PT1.1H2.2M3.3S": 4095.3, "1 day": 86400, "2 DAYS": 172800, "4 HoUrS": 14400, "10 milliseconds": 0.01,
    "12 microseconds": 12e-6, "1 day 2 hours 3 minutes 4 seconds": 93784, "7 minutes 6 hours 5 days": 454020, " 1 day ": 86400, "-1 day 2 hours": -79200, "1 day -2 hours": 79200,
}


@pytest.mark.parametrize("text", VALID)
def test_durations(text):
    assert parse_duration(text).total_seconds() == pytest.approx(VALID[text], abs=1e-7)
    assert parse_duration(format_duration(parse_duration(text))) == parse_duration(text)


@pytest.mark.parametrize("text", ["", "   ", "P", "PT", "PD", "PTM", "P1H", "P1S", "P1X", "p1h", "PT1h", "P1D2", "PT1..5S", "P1..5D", "P1DT2H T3M", "P1T2H", "P-1D", "P1H2D", "1 day 2", "one day", "1.5 hours", "1 year", "1day"])
def test_what_is_no_duration(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_fingerprints_and_settings_objects():
    assert len(fingerprint({"a": 1})) == 24 and fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1})
    assert codec.plain(datetime.timedelta(seconds=1, microseconds=5)) == {"secs": 1, "nanos": 5000}
    assert codec.plain(Customer("c", Order("a", "b", 1.0))) == {"name": "c", "order": {"order_id": "a", "name": "b", "price": 1.0, "extra_field": "default_extra"}}

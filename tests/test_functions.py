"""Canonical JSON, timestamps, values."""

import json
from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomlog.functions.canonical_json import canonical, content_hash, event_hash, loaded_text, verify_hash
from fathomlog.functions.timestamps import iso_of, iso_text, parse_iso
from fathomlog.functions.values import MISSING, at_path, clean_error, composite_key, deep_merge, truncate_ip


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (0.0, "0"), (-0.0, "0"), (2.0, "2"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (123.456, "123.456"),
        (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (2**60 + 1, "1152921504606846977"), (-1.5, "-1.5"), (0.1, "0.1"),
        (True, "true"), (None, "null"), ("é\"\n\x01", '"é\\"\\n\\u0001"'), ([1, "a"], '[1,"a"]'), ({"b": 1, "a": {}}, '{"a":{},"b":1}'),
        ({"\U0001f600": 1, "דּ": 2}, '{"\U0001f600":1,"דּ":2}'),  # by UTF-16 units, not code points
    ],
)
def test_canonical(value, text):
    assert canonical(value) == text


@pytest.mark.parametrize("value", [float("nan"), float("inf"), {1: 2}, object()])
def test_canonical_refuses(value):
    with pytest.raises((ValueError, TypeError)):
        canonical(value)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(-1e15, 1e15) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), x), max_leaves=8))
def test_canonical_reads_back(value):
    assert json.loads(canonical(value)) == value
    assert canonical(json.loads(canonical(value))) == canonical(value)


def record():
    out = {"event_id": "e", "aggregate_id": "a", "aggregate_type": "x", "entry_type": "n", "data": {"k": 1.0}, "metadata": {"provenance": [{"database_id": "d"}]}, "sequence_number": 1}
    return out | {"event_hash": event_hash(out)}


def test_event_hash_covers_its_fields_only():
    r = record()
    assert verify_hash(r) == []
    assert verify_hash(r | {"aggregate_type": "y", "extra": 1}) == []
    assert event_hash({k: v for k, v in r.items() if k != "causal"}) == event_hash(r | {"causal": None})
    assert [f["hop"] for f in verify_hash(r | {"data": {"k": 2}})] == [None]


def test_arrival_hashes_are_checked_hop_by_hop():
    r = record()
    received = dict(r, sequence_number=9, metadata={"provenance": [*r["metadata"]["provenance"], {"database_id": "e", "arrival_hash": r["event_hash"], "origin_sequence_number": 1}]})
    received["event_hash"] = event_hash(received)
    assert verify_hash(received) == []
    received["metadata"]["provenance"][1]["arrival_hash"] = "no"
    assert [f["hop"] for f in verify_hash(received)] == [None, 1]


def test_content_hash_ignores_order():
    assert content_hash({"a": 1, "b": [1.0]}) == content_hash({"b": [1], "a": 1.0})


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)),
        ("2024-01-02T03:04:05.123456+02:00", datetime(2024, 1, 2, 1, 4, 5, 123456, tzinfo=UTC)),
        ("2024-02-30T00:00:00Z", None), ("2024-01-02T03:04:05", None), ("2024-01-02", None), ("2024-01-02T24:00:00Z", None),
    ],
)
def test_parse_iso(text, moment):
    assert parse_iso(text) == moment


def test_iso_text_has_three_or_six_digits(spark):
    moments = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120000), datetime(2024, 1, 2, 3, 4, 5, 123456)]
    texts = ["2024-01-02T03:04:05.000Z", "2024-01-02T03:04:05.120Z", "2024-01-02T03:04:05.123456Z"]
    assert [iso_of(m.replace(tzinfo=UTC)) for m in moments] == texts
    rows = spark.range(1).select(*(iso_text(F.lit(t).cast("timestamp")).alias(str(i)) for i, t in enumerate(texts))).first()
    assert list(rows) == texts


@pytest.mark.parametrize(
    ("prior", "delta", "out"),
    [
        ({"a": {"x": 1}}, {"a": {"y": 2}}, {"a": {"x": 1, "y": 2}}), ({"a": {"x": 1}}, {"a": {}}, {"a": {"x": 1}}), ({"a": 1}, {"a": {}}, {"a": {}}),
        ({"a": 1}, {"a": {"b": None}}, {"a": {"b": None}}), ({"a": {"x": 1}}, {"a": None}, {"a": None}), ({"a": [1]}, {"a": [2]}, {"a": [2]}), ({}, {}, {}),
    ],
)
def test_deep_merge(prior, delta, out):
    assert deep_merge(prior, delta) == out


def test_paths():
    assert at_path({"a": {"b": None}}, "a.b") is None
    assert at_path({"a": {"b": 1}}, "a.c") is MISSING
    assert at_path({"a": 1}, "a.b") is MISSING


def test_columns(spark):
    df = spark.createDataFrame([("10.1.2.3", "x"), ("fe80:1:2:3::4", "y"), ("odd", "z"), (None, "n")], "ip string, k string")
    assert [r[0] for r in df.select(truncate_ip(F.col("ip"))).collect()] == ["10.1.2.0", "fe80:1:2::", None, None]
    message = spark.range(1).select(clean_error(F.lit("bad /home/me/app.x at file:///a/b.x\n  at main (x)\n#0 run")))
    assert message.first()[0] == "bad <path> at <path>"
    assert df.where("ip is not null").select(composite_key(F.col("k"), F.lit(1))).first()[0] == "x|1"
    with pytest.raises(Exception, match="row key"):
        df.select(composite_key(F.col("ip"), F.col("k"))).collect()


def test_loaded_text_is_the_canonical_text():
    """By the encoder where that prints the same; fractions and keys beyond U+FFFF go the long way."""
    texts = ['{"b":[1,-2,true,null],"a":{"\\u00e9":"x:1.5","c":""}}', '{"a":1.0,"b":[2e30,-0.0,1e-7]}', '"[1.5"', "7", "-2.50", '{"\\ud800\\udc00":1,"\\uffff":2}', '{"k":123456789012345678901234567890}']
    for text in texts:
        value = json.loads(text)
        assert loaded_text(value) == canonical(value)
    with pytest.raises(ValueError):
        loaded_text(json.loads('{"a":NaN}'))

"""Canonical JSON text (RFC 8785) and hashes of it.

Values are what ``json.loads`` gives. Object keys are ordered by UTF-16 code units,
numbers follow ECMAScript, and integers keep all their digits.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: float) -> str:
    """A double as ECMAScript prints it."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError(f"JSON has no number {x}")
    if x == 0:
        return "0"
    mantissa, n = _shortest(x)
    sign = "-" if x < 0 else ""
    if len(mantissa) <= n <= 21:
        return sign + mantissa + "0" * (n - len(mantissa))
    if 0 < n <= 21:
        return sign + mantissa[:n] + "." + mantissa[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + mantissa
    tail = f"e{n - 1:+d}"
    return sign + mantissa[0] + ("." + mantissa[1:] if len(mantissa) > 1 else "") + tail


def _shortest(x: float) -> tuple[str, int]:
    """(digits, n) of the shortest decimal that reads back as ``abs(x)``: 0.digits * 10**n."""
    text = repr(abs(x))
    digits, _, power = text.partition("e")
    whole, _, part = digits.partition(".")
    joined = whole + part
    n = len(whole) + int(power or 0)
    stripped = joined.lstrip("0")
    n -= len(joined) - len(stripped)
    return stripped.rstrip("0"), n


def canonical(value: Any) -> str:
    """The canonical text of a JSON value."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("object keys are strings")
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(canonical(k) + ":" + canonical(value[k]) for k in keys) + "}"
    raise TypeError(f"{type(value).__name__} is not JSON")


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))
#: A fraction, an exponent or no number at all where a value can begin; within a text it means nothing.
_MAYBE_FRACTION = re.compile(r"(?:^|[\[:,])-?(?:\d+[.e]|[IN])")


def loaded_text(value: Any) -> str:
    """``canonical`` of what ``json.loads`` gave, at the JSON encoder's speed.

    The encoder prints fractions otherwise, and orders keys by code points, which differs from code units beyond U+FFFF: values that may hold either go the long way.
    """
    text = _ENCODER.encode(value)
    return canonical(value) if _MAYBE_FRACTION.search(text) or not (text.isascii() or max(text) <= "\uffff") else text


def content_hash(value: Any) -> str:
    """SHA-256 of the canonical text, in lowercase hexadecimal digits."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def canonicalize(text: Column) -> Column:
    """Column of JSON texts, in canonical form; null for null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else loaded_text(json.loads(t)))

    return run(text)


def canonical_sha256(text: Column) -> Column:
    return F.sha2(canonicalize(text), 256)


#: The record fields that an event's hash covers.
HASHED_FIELDS = (
    "aggregate_id causal client_timestamp data entry_type entry_type_version event_id event_type "
    "flow_token initiator lib_format_version metadata previous_event_hash sequence_number"
).split()


def event_hash(record: dict, fields: Iterable[str] = HASHED_FIELDS) -> str:
    """Hash of an event record: missing fields count as null, all others are left out."""
    return content_hash({f: record.get(f) for f in fields})


def record_text(log_columns: Iterable[str]) -> Column:
    """An event's record as JSON text, from the columns of a log; ``data`` and ``metadata`` are JSON texts, missing columns count as null."""
    held = set(log_columns)
    parsed = lambda f: F.parse_json(f) if f in ("data", "metadata") else F.col(f)
    fields = [(parsed(f) if f in held else F.lit(None).cast("string")).alias(f) for f in HASHED_FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def event_hashes(log_columns: Iterable[str]) -> Column:
    """Hashes of the events of a log, in columns."""
    return canonical_sha256(record_text(log_columns))


def hash_findings(records: Column) -> Column:
    """Per record (JSON text): array of (hop, stated, found) of what its hashes don't confirm; hop is null for its own."""

    @F.pandas_udf("array<struct<hop:int,stated:string,found:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else verify_hash(json.loads(t)))

    return run(records)


def verify_hash(record: dict) -> list[dict]:
    """What an event's own hash and its hops' arrival hashes don't confirm, latest hop first.

    A hop's arrival hash covers the record as it came in: its provenance up to the hop
    before, under the position it had there.
    """
    out = []
    hashed = lambda r: hashlib.sha256(loaded_text({f: r.get(f) for f in HASHED_FIELDS}).encode()).hexdigest()
    if record.get("event_hash") != (found := hashed(record)):
        out.append({"hop": None, "stated": record.get("event_hash"), "found": found})
    hops = ((record.get("metadata") or {}).get("provenance")) or []
    for k in range(len(hops) - 1, 0, -1):
        before = dict(record, metadata=dict(record["metadata"], provenance=hops[:k]), sequence_number=hops[k].get("origin_sequence_number"))
        if hops[k].get("arrival_hash") != (found := hashed(before)):
            out.append({"hop": k, "stated": hops[k].get("arrival_hash"), "found": found})
    return out

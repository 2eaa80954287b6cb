"""Values inside payloads: dotted paths, merging, text cleaning and address truncation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = object()


def at_path(value: Any, path: str) -> Any:
    """What a dotted path leads to, or MISSING; only objects have fields."""
    for name in path.split("."):
        if not isinstance(value, dict) or name not in value:
            return MISSING
        value = value[name]
    return value


def deep_merge(prior: dict, delta: dict) -> dict:
    """``delta`` over ``prior``, field by field: objects merge, anything else (null included) replaces."""
    out = dict(prior)
    for name, value in delta.items():
        held = out.get(name)
        out[name] = deep_merge(held, value) if isinstance(held, dict) and isinstance(value, dict) else value
    return out


def shallow_merge(prior: dict, delta: dict) -> dict:
    return prior | delta


def truncate_ip(ip: Column) -> Column:
    """IPv4 without its last number, IPv6 with its first three groups; other texts become null."""
    v4 = F.regexp_replace(ip, r"\.\d+$", ".0")
    v6 = F.concat(F.concat_ws(":", F.slice(F.split(ip, ":"), 1, 3)), F.lit("::"))
    return F.when(ip.rlike(r"^\d+\.\d+\.\d+\.\d+$"), v4).when(ip.contains(":"), v6)


def clean_error(message: Column) -> Column:
    """An error message without stack lines, file URIs and absolute paths."""
    lines = F.filter(F.split(message, "\n"), lambda x: ~x.rlike(r"^(\s+at\s|#\d+\s)"))
    text = F.array_join(lines, "\n")
    text = F.regexp_replace(text, r"(file|package)://?[^\s)]+", "<path>")
    return F.regexp_replace(text, r"(?<![\w<])/(?:[\w.\-]+/)+[\w.\-]+", "<path>")


def composite_key(*parts: Column) -> Column:
    """Parts as text, joined by a bar; an error if one is null, since such a row has no key."""
    texts = [F.coalesce(p.cast("string"), F.raise_error(F.lit("a part of the row key is missing")).cast("string")) for p in parts]
    return F.concat_ws("|", *texts)

"""Front-matter of Markdown documents: YAML where it parses, else `key: value` lines. An Arrow UDF, as Spark has no YAML."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

try:
    import yaml
except ImportError:  # lines only
    yaml = None

FIELDS = pa.struct([("name", pa.string()), ("description", pa.string()), ("category", pa.string()), ("tags", pa.list_(pa.string()))])


def _split(tags: str) -> list[str]:
    """Tags of one string: brackets and quotes around it, commas between."""
    return [t for x in tags.strip("[]\" ").split(",") if (t := x.strip().strip("'\""))]


def _of_lines(head: str) -> dict:
    """`key: value` lines; later ones hold."""
    found = {}
    for line in head.strip().split("\n"):
        key, colon, value = line.partition(":")
        if colon and key.strip() in ("name", "description", "category", "tags"):
            found[key.strip()] = value.strip()
    return found


def fields(head: str | None) -> dict:
    """Name, description, category, tags of a front-matter; those that it doesn't give are null, tags empty."""
    if not head or not head.strip():
        return {"name": None, "description": None, "category": None, "tags": []}
    found = None
    if yaml:
        try:
            found = yaml.safe_load(head)
        except (yaml.YAMLError, ValueError, RecursionError):
            pass
    if not isinstance(found, dict):
        found = _of_lines(head)
    tags = found.get("tags")
    tags = [str(t).strip() for t in tags if t is not None] if isinstance(tags, list) else _split(tags) if isinstance(tags, str) else []
    return {k: None if found.get(k) is None else str(found[k]) for k in ("name", "description", "category")} | {"tags": [t for t in tags if t]}


def _parsed(heads: pa.Array) -> pa.Array:
    return pa.array([fields(x) for x in heads.to_pylist()], FIELDS)


def parsed(head: Column) -> Column:
    """struct<name, description, category, tags> of a front-matter."""
    return arrow_udf(_parsed, "struct<name: string, description: string, category: string, tags: array<string>>")(head)


def recipes(text: str) -> list[tuple[str, str, list[str], list[str]]]:
    """(recipe, description, must, should) of a YAML file of recipes by name; a file without any has none."""
    found = (yaml.safe_load(text) if yaml else None) or {}
    listed = lambda x: [str(y) for y in x] if isinstance(x, list) else []
    return [(str(k), str(v.get("description") or ""), listed(v.get("must")), listed(v.get("should"))) for k, v in found.items() if isinstance(v, dict)]

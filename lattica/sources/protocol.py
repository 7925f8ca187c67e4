"""Protocols: a YAML document whose digest is frozen beside it, and the small tables that plans read from it."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def load(path: str | Path, frozen: bool = False) -> dict[str, Any]:
    """The document; frozen: its digest must equal that in <path>.sha256."""
    raw = Path(path).read_bytes()
    if frozen:
        side = Path(f"{path}.sha256")
        if not side.exists() or side.read_text().split()[0] != digest(raw):
            raise ValueError(f"{path} differs from its frozen digest")
    doc = yaml.safe_load(raw)
    if not isinstance(doc, dict):
        raise ValueError(f"{path} isn't a mapping")
    return doc


def freeze(path: str | Path) -> None:
    Path(f"{path}.sha256").write_text(digest(Path(path).read_bytes()) + "\n")


def config_hash(config: Any) -> str:
    """Twelve digits of the canonical JSON's hash."""
    return digest(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode())[:12]


def leaves(doc: Any, prefix: str = "") -> dict[str, Any]:
    """Dotted path -> value of each leaf."""
    if isinstance(doc, dict):
        return {k: v for key, value in doc.items() for k, v in leaves(value, f"{prefix}{key}.").items()}
    return {prefix[:-1]: doc}


def contrasts(spark: SparkSession, doc: dict[str, Any]) -> DataFrame:
    """contrast, first, second, family from `contrasts` (id, a, b) and `families` (name -> ids); unlisted ones are exploratory.
    A contrast in two families is an error."""
    family: dict[str, str] = {}
    for name, ids in (doc.get("families") or {}).items():
        for i in ids:
            if family.setdefault(i, name) != name:
                raise ValueError(f"{i} is in two families")
    rows = [(c["id"], c["a"], c["b"], family.get(c["id"])) for c in doc.get("contrasts") or []]
    return spark.createDataFrame(rows, "contrast string, first string, second string, family string")


def grids(doc: dict[str, Any]) -> dict[str, dict[str, list]]:
    """model -> option -> values; an option without values is an error."""
    out = {}
    for model, options in (doc.get("grids") or {}).items():
        if bad := [o for o, v in options.items() if not isinstance(v, list) or not v]:
            raise ValueError(f"{model}: options without values {bad}")
        out[model] = options
    return out

"""Rules as data: terms with weights from YAML, JSON or tables; a file that is missing has no rules."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from quillstream.operators.rules import Rule


def config(path: str) -> dict[str, Any]:
    """The mapping that a YAML or JSON file holds; {} if there is no such file or it is empty."""
    at = Path(path)
    if not at.is_file():
        return {}
    text = at.read_text(encoding="utf-8")
    if at.suffix == ".json":
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading rules from YAML needs the package yaml; JSON needs none") from e
    return yaml.safe_load(text) or {}


def bucket_rules(entries: dict[str, Any], words: str = "kw") -> list[Rule]:
    """Rules of {bucket: {kw: {term: weight}}}; a list of terms instead weighs one each."""
    out: list[Rule] = []
    for bucket, entry in entries.items():
        terms = (entry or {}).get(words) or {}
        pairs = terms.items() if isinstance(terms, dict) else ((t, 1.0) for t in terms)
        out += [(str(bucket), str(t), float(w)) for t, w in pairs]
    return out


def table_rules(table: DataFrame) -> list[Rule]:
    """Rules of a table of bucket, term and weight, which is configuration and so small."""
    return [(r["bucket"], r["term"], float(r["weight"])) for r in table.select("bucket", "term", "weight").collect()]

"""Settings of a session, read from its configuration, and guards of what callers ask for."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

PREFIX = "spark.quillstream."


@dataclass(frozen=True)
class Settings:
    """Each field is set by PREFIX and its name."""

    fetch_minutes: int = 15
    max_age_days: int = 35
    keep_days: int = 400
    archive_after_days: int = 3
    retry_hours: int = 6
    checkpoint_dir: str = ""

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {}
        for f in fields(cls):
            value = spark.conf.get(PREFIX + f.name, None)
            if value is not None:
                given[f.name] = int(value) if isinstance(f.default, int) else value
        return cls(**given)


#: The longest range in days, and the most rows, ids and characters of a note in one request.
LONGEST_RANGE, MOST_ROWS, MOST_IDS, LONGEST_NOTE = 93, 500, 1000, 5000


def day_range(first: str, last: str) -> tuple[date, date]:
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    if b < a or (b - a).days > LONGEST_RANGE:
        raise ValueError(f"a range has up to {LONGEST_RANGE} days, from its first to its last")
    return a, b


def rows_asked(n: int) -> int:
    return max(1, min(int(n), MOST_ROWS))


def ids_asked(ids: list[str]) -> list[str]:
    if len(ids) > MOST_IDS:
        raise ValueError(f"up to {MOST_IDS} ids")
    return list(dict.fromkeys(ids))


def note_given(text: str) -> str:
    if len(text) > LONGEST_NOTE:
        raise ValueError(f"a note has up to {LONGEST_NOTE} characters")
    return text


def inside(root: str, name: str) -> str:
    """`name` under `root`; refused if it leads out of it."""
    at = PurePosixPath(name)
    if at.is_absolute() or ".." in at.parts or "\0" in name or "\\" in name:
        raise ValueError("a name inside the folder")
    return str(PurePosixPath(root) / at)

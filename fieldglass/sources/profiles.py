"""Dataset profiles and session manifests: small contracts checked on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

#: Largest manifest that is read.
MANIFEST_BYTES = 1 << 20
VIEWS = ("numeric_pair", "time_value", "timeline_lane")


@dataclass(frozen=True)
class Profile:
    """Columns a kind of dataset must have, its default bindings, and columns worth filtering."""

    name: str
    required: dict[str, str]
    bindings: dict[str, str] = field(default_factory=dict)
    filter_hints: tuple[str, ...] = ()

    def validate(self, schema: Sequence[tuple[str, str]]) -> None:
        """All missing and all mismatched columns are named at once."""
        known = dict(schema)
        gone = [c for c in self.required if c not in known]
        wrong = [f"{c} is {known[c]}, not {k}" for c, k in self.required.items() if c in known and known[c] != k]
        if gone or wrong:
            raise ValueError(f"profile {self.name!r}: missing columns {gone}, mismatched columns {wrong}")

    def hints(self, schema: Sequence[tuple[str, str]], kinds: Sequence[str] = ("Integer", "Float", "String")) -> list[str]:
        """The filter hints that exist with a kind that can be filtered."""
        known = dict(schema)
        return [c for c in self.filter_hints if known.get(c) in kinds]


#: The built-in profile of rated games.
GAMES = Profile(
    "games",
    {"created_at": "Integer", "white_rating": "Integer", "black_rating": "Integer", "winner": "String"},
    {"x": "white_rating", "y": "black_rating", "time": "created_at", "category": "winner"},
    ("white_rating", "black_rating", "winner", "category", "time_control", "termination", "event", "weekday", "eco", "opening"),
)


@dataclass(frozen=True)
class Session:
    """What to open and how to view it."""

    source: str
    view: str
    columns: dict[str, str]
    version: int = 2
    display_name: str | None = None
    evidence_key: str | None = None

    def __post_init__(self) -> None:
        need = {"numeric_pair": {"x", "y"}, "time_value": {"time", "value"}, "timeline_lane": {"time", "lane"}}
        if self.view not in VIEWS:
            raise ValueError(f"unknown view {self.view!r}")
        if not need[self.view] <= self.columns.keys():
            raise ValueError(f"view {self.view!r} needs columns {sorted(need[self.view])}")
        if "://" in self.source:
            raise ValueError("a session's source is a file, not a URI")

    def save(self, path: str) -> None:
        """Write beside the target, then rename over it."""
        part = f"{path}.part"
        with open(part, "w", encoding="utf-8") as out:
            json.dump(asdict(self), out, indent=2, sort_keys=True)
        os.replace(part, path)


def load_session(path: str) -> Session:
    """Read a manifest of version 1 (scatter or timeline) or 2; relative sources are taken from its folder."""
    if os.path.getsize(path) > MANIFEST_BYTES:
        raise ValueError("the manifest is larger than 1 MiB")
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if raw.get("version") not in (1, 2):
        raise ValueError(f"unknown manifest version {raw.get('version')!r}")
    if raw["version"] == 1:
        raw["view"] = {"scatter": "numeric_pair", "timeline": "timeline_lane"}.get(raw["view"], raw["view"])
    source = os.path.join(os.path.dirname(os.path.abspath(path)), raw["source"])
    if source.rsplit(".", 1)[-1].lower() not in ("csv", "parquet"):
        raise ValueError("a session's source is a .csv or .parquet file")
    return Session(source, raw["view"], raw["columns"], raw["version"], raw.get("display_name"), raw.get("evidence_key"))


def csv_session(path: str, view: str, columns: dict[str, str], destination: str, **names: str | None) -> Session:
    """A manifest for a CSV file that stays where it is."""
    if not path.lower().endswith(".csv"):
        raise ValueError("a .csv file is needed")
    session = Session(os.path.abspath(path), view, columns, **names)
    session.save(destination)
    return session

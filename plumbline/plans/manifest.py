"""The sidecar file: what is declared about a table goes before what is detected; proposals do nothing."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from plumbline.operators.tables import classify_measures

VERSION = 1
SUFFIX = ".plumbline.json"


@dataclass
class Manifest:
    schema: dict = field(default_factory=dict)
    declared: dict = field(default_factory=dict)
    proposed: dict = field(default_factory=dict)
    skipped: list = field(default_factory=list)
    questions: list = field(default_factory=list)
    detected: dict = field(default_factory=dict)

    def get(self, key: str, default=None):
        """Declared, else detected; empty values say nothing."""
        for block in (self.declared, self.detected):
            if block.get(key) not in (None, "", [], {}):
                return block[key]
        return default

    def drift(self, columns: list[str]) -> dict | None:
        known = self.schema.get("columns")
        if not known:
            return None
        return {"added": sorted(set(columns) - set(known)), "removed": sorted(set(known) - set(columns))}

    def write(self, path: str | Path) -> None:
        body = {"manifest_version": VERSION, "written_at": datetime.now(timezone.utc).isoformat(timespec="seconds")} | self.__dict__
        Path(path).write_text(json.dumps(body, indent=2, ensure_ascii=False, default=str) + "\n")

    @classmethod
    def read(cls, path: str | Path) -> Manifest:
        body = json.loads(Path(path).read_text())
        if body.get("manifest_version") != VERSION:
            raise ValueError(f"manifest version {body.get('manifest_version')!r}; this reads {VERSION}")
        return cls(**{k: body.get(k, v) for k, v in cls().__dict__.items()})


def from_audit(profile, structure, questions) -> Manifest:
    """What an audit found, to be edited by a person. Nothing is declared: a guess isn't an answer."""
    measures = classify_measures({p.name: p.kind for p in profile}, {*structure.grain, *structure.time_parts, *structure.group_columns, structure.time_axis})
    detected = {"time_axis": structure.time_axis, "time_parts": structure.time_parts, "group_columns": structure.group_columns, "grain": structure.grain, "grain_is_unique": structure.grain_unique, "aggregate": measures}
    asked = [{"code": n.code, "column": n.column, "question": n.message} for n in questions]
    return Manifest(schema={"columns": [p.name for p in profile]}, questions=asked, detected=detected)


def sidecar(path: str) -> Path:
    return Path(str(path).rstrip("/") + SUFFIX)


def discover(path: str) -> Manifest | None:
    p = sidecar(path)
    return Manifest.read(p) if p.is_file() else None

"""An interview about a table: metadata go to a provider, proposals come back for a person to accept.

A provider is any object with ask(system, prompt, schema) -> dict; none is built in, and nothing is sent
unless one is given. What it proposes lands in the manifest's `proposed` block, which no check reads.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from plumbline.plans.manifest import Manifest

QUESTIONS = 5
KEYS = {"time_axis": str, "grain": list, "forecast_column": str}

SYSTEM = "You read the profile of a table. Say which column holds the observation date, which columns identify a row and which one marks forecasts, if the profile supports it. Ask at most five questions whose answers change what can be checked, each with the answer you expect and what depends on it. Name only columns of the profile."

_TEXT = {"type": "string"}
SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["declarations", "summary", "questions", "open"],
    "properties": {
        "declarations": {"type": "object", "additionalProperties": False, "required": list(KEYS), "properties": {"time_axis": {"type": ["string", "null"]}, "grain": {"type": ["array", "null"], "items": _TEXT}, "forecast_column": {"type": ["string", "null"]}}},
        "summary": _TEXT,
        "questions": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["column", "ask", "expected", "why"], "properties": {"column": {"type": ["string", "null"]}, "ask": _TEXT, "expected": {"type": ["string", "null"]}, "why": _TEXT}}},
        "open": {"type": "array", "items": _TEXT},
    },
}


class Provider(Protocol):
    def ask(self, system: str, prompt: str, schema: dict) -> dict: ...


@dataclass
class Interview:
    declarations: dict = field(default_factory=dict)
    refused: list[str] = field(default_factory=list)
    summary: str = ""
    questions: list[dict] = field(default_factory=list)
    open: list[str] = field(default_factory=list)


def describe(payload: dict) -> str:
    """What would be sent, in words, for a person to read before it is."""
    shown = [c["name"] for c in payload["columns"] if c.get("top_values")]
    out = [f"{len(json.dumps(payload, default=str))} bytes: names, types, counts and quantiles of {len(payload['columns'])} columns, {len(payload['questions'])} open questions, the inferred structure. No row of the table."]
    out.append(f"Cell values: the frequent values of {', '.join(shown)}; --redact-values leaves them out." if shown else "Cell values: none.")
    return "\n".join(out)


def leaks(payload: dict, cells: list[str]) -> list[str]:
    """Those of the table's values that the payload holds other than as a column's listed frequent values."""
    slim = json.loads(json.dumps(payload, default=str))
    listed = {str(t["value"]) for c in slim["columns"] for t in c.pop("top_values", [])}
    blob = json.dumps(slim, ensure_ascii=False)
    return [v for v in dict.fromkeys(map(str, cells)) if len(v) >= 4 and v not in listed and v in blob]


def checked(declarations: dict | None, columns: list[str]) -> tuple[dict, list[str]]:
    """The declarations of known keys that name known columns, and why the others are refused."""
    kept, refused = {}, []
    for key, value in (declarations or {}).items():
        if value in (None, "", []):
            continue
        named = value if isinstance(value, list) else [value]
        unknown = [str(n) for n in named if n not in columns]
        if key not in KEYS or not isinstance(value, KEYS[key]):
            refused.append(f"{key}: nothing that can be declared")
        elif unknown:
            refused.append(f"{key}: no column {', '.join(unknown)}")
        else:
            kept[key] = value
    return kept, refused


def interview(payload: dict, provider: Provider, context: str = "") -> Interview:
    """Asks once; more questions than agreed are cut off."""
    prompt = (f"The owner says: {context}\n\n" if context else "") + json.dumps(payload, indent=1, default=str)
    said = provider.ask(SYSTEM, prompt, SCHEMA) or {}
    kept, refused = checked(said.get("declarations"), [c["name"] for c in payload["columns"]])
    return Interview(kept, refused, said.get("summary") or "", list(said.get("questions") or [])[:QUESTIONS], list(said.get("open") or []))


def propose(manifest: Manifest, result: Interview) -> Manifest:
    """Writes what came back where it does nothing until a person accepts it."""
    manifest.proposed = dict(result.declarations)
    return manifest

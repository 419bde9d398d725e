"""Command line: profile, audit, init, interview, declare, catalog. Exit 0: fine, 1: what was asked to fail on, 2: usage."""

from __future__ import annotations

import argparse
import csv
import html
import json
import sys
from pathlib import Path

from plumbline.plans import audit as A
from plumbline.plans.charts import chart_for
from plumbline.plans.interview import describe
from plumbline.plans.manifest import Manifest, discover, from_audit, sidecar
from plumbline.session import session
from plumbline.sources.tables import load


def text_report(a: A.Audit) -> str:
    out = [f"{a.provenance.get('path', '')}: {a.provenance.get('rows', 0)} rows, {len(a.profile)} columns"]
    for level in (a, *a.rollups):
        out += [f"[{level.level}] {f.disposition}/{f.confidence} {f.check_id} {f.column or ''}: {f.summary}" for f in level.findings]
    out += [f"{status}: {check}{' - ' + why if why else ''}" for check, status, why in a.coverage]
    out += [f"question {n.code} {n.column or ''}: {n.message}" for n in a.questions()]
    return "\n".join(out + [f"declined {n.code} {n.column or ''}: {n.message}" for n in a.declined()])


def profile_report(a: A.Audit) -> str:
    out = [f"{a.provenance.get('path', '')}: {a.provenance.get('rows', 0)} rows, {len(a.profile)} columns, read {a.provenance.get('read_mode')}"]
    for p in a.profile:
        shown = "" if p.kind == "text" or p.min is None else f", {p.min} to {p.max}"
        out.append(f"{p.name} ({p.type}): {p.distinct} distinct, {p.nulls} null{shown}; {', '.join(p.properties())}")
    return "\n".join(out + [f"{n.severity} {n.code} {n.column or ''}: {n.message}" for n in a.notes])


def html_report(a: A.Audit) -> str:
    """One self-contained page with charts of the evidence and the result embedded as JSON."""
    rows = []
    for x in (a, *a.rollups):
        for f in x.findings:
            cells = "".join(f"<td>{html.escape(v)}" for v in (x.level, f.disposition, f.confidence, f.check_id, f.column or "", f.summary))
            chart = chart_for(f, x.context)
            rows.append(f"<tr>{cells}" + (f'<tr><td colspan="6">{chart}' if chart else ""))
    asked = "".join(f"<li>{html.escape(n.message)}" for n in a.questions()) + "".join(f"<li>declined: {html.escape(n.message)}" for n in a.declined())
    data = json.dumps(a.to_dict(), default=str).replace("</", "<\\/")
    return f'<!DOCTYPE html><meta charset="utf-8"><title>Audit</title><table>{"".join(rows)}</table><ul>{asked}</ul><script type="application/json" id="audit">{data}</script>'


def flagged_csv(a: A.Audit, path: str) -> None:
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["level", "check_id", "column", "disposition", "confidence", "summary", "predicate", "evidence"])
        for x in (a, *a.rollups):
            w.writerows([x.level, g.check_id, g.column, g.disposition, g.confidence, g.summary, g.predicate, json.dumps(g.evidence, default=str)] for g in x.findings)


def payload(a: A.Audit, redact: bool = False) -> dict:
    """Metadata that may leave the machine: no path, no cell values of text, top values only if wanted."""
    d = a.to_dict()
    d["provenance"].pop("path", None)
    d["findings"] = [f for f in d["findings"] if not f["raw_values"]]
    for c in d["columns"]:
        if redact:
            c["top_values"] = []
    d.pop("rollups")
    return d


def declare(args, m: Manifest, columns: list[str]) -> bool:
    """Writes what is declared; False if nothing changes or a column is unknown."""
    before = json.dumps(m.__dict__, sort_keys=True, default=str)
    pairs = [x.rpartition("=")[::2] for x in args.aggregate or []]
    named = [*(args.grain or "").split(","), args.time_axis or "", args.forecast_column or "", *(args.additive or []), *(args.non_additive or []), *(c for c, _ in pairs)]
    if any(c and c not in columns for c in named) or any(not c or how not in ("sum", "mean", "none") for c, how in pairs):
        return False
    if pairs:
        m.declared["aggregate"] = m.declared.get("aggregate", {}) | dict(pairs)
    for k in ("time_axis", "forecast_column"):
        if getattr(args, k):
            m.declared[k] = getattr(args, k)
    if args.grain:
        m.declared["grain"] = args.grain.split(",")
    for k in ("additive", "non_additive"):
        if getattr(args, k):
            m.declared[k] = sorted({*m.declared.get(k, []), *getattr(args, k)})
    m.skipped = sorted({*m.skipped, *(args.skip or [])} - set(args.unskip or []))
    if args.accept_proposed:
        m.declared |= m.proposed
        m.proposed = {}
    return json.dumps(m.__dict__, sort_keys=True, default=str) != before


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("profile", "audit", "init", "interview", "declare"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--json", action="store_true")
        if name == "profile":
            s.add_argument("--fail-on-question", action="store_true")
        if name == "audit":
            s.add_argument("--fail-on-finding", action="store_true")
            s.add_argument("--no-manifest", action="store_true")
            s.add_argument("--manifest")
            s.add_argument("--rollup", action="store_true")
            s.add_argument("--report")
        if name == "init":
            s.add_argument("--force", action="store_true")
            s.add_argument("-o", "--output")
        if name == "interview":
            s.add_argument("--redact-values", action="store_true")
        if name == "declare":
            for k in ("--time-axis", "--grain", "--forecast-column"):
                s.add_argument(k)
            for k in ("--additive", "--non-additive", "--skip", "--unskip"):
                s.add_argument(k, action="append")
            s.add_argument("--aggregate", action="append", metavar="COLUMN=sum|mean|none")
            s.add_argument("--manifest")
            s.add_argument("--accept-proposed", action="store_true")
    sub.add_parser("catalog").add_argument("--json", action="store_true")
    args = p.parse_args(argv)
    if args.command == "catalog":
        rows = [{"id": c.id, "detects": c.detects} for c in A.CATALOG]
        print(json.dumps(rows) if args.json else "\n".join(f"{r['id']}: {r['detects']}" for r in rows))
        return 0
    manifest = getattr(args, "manifest", None)
    try:
        if args.command == "declare":
            # only names of columns are needed
            m = Manifest.read(manifest) if manifest else discover(args.path) or Manifest()
            if not declare(args, m, load(session(), args.path).df.columns):
                print("unknown column or way to aggregate, or nothing to change", file=sys.stderr)
                return 2
            m.write(manifest or sidecar(args.path))
            return 0
        if args.command == "profile":
            a = A.profile_only(session(), args.path)
        else:
            a = A.run(session(), args.path, use_manifest=not getattr(args, "no_manifest", False) and args.command != "init", rollup=getattr(args, "rollup", False), manifest=manifest)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "init":
        target = Path(args.output) if args.output else sidecar(args.path)
        if target.exists() and not args.force:
            print("there is a manifest; --force overwrites it", file=sys.stderr)
            return 2
        from_audit(a.profile, a.structure, a.questions()).write(target)
        return 0
    if args.command == "interview":
        # no provider is built in: this shows what one would be sent
        sent = payload(a, args.redact_values)
        print(json.dumps(sent, default=str) if args.json else describe(sent))
        return 0
    if args.command == "profile" and not args.json:
        print(profile_report(a))
        return int(bool(args.fail_on_question and a.questions()))
    if args.json:
        print(json.dumps(a.to_dict(), default=str))
    else:
        print(text_report(a))
    if getattr(args, "report", None):
        with open(args.report, "w") as f:
            f.write(html_report(a))
        flagged_csv(a, args.report + ".flagged.csv")
    return int(bool(getattr(args, "fail_on_finding", False) and any(f.disposition == A.DEFECT for x in (a, *a.rollups) for f in x.findings) or getattr(args, "fail_on_question", False) and a.questions()))

"""One chart for a finding that a picture can settle, as SVG without scripts or outside files.

Each chart's data come from a query that returns a bounded number of rows: a few dozen points around a
place, 40 bins, the decades that occur, or at most 420 days.
"""

from __future__ import annotations

import html
import math

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators import series as S
from plumbline.operators import tables as T

WIDTH, HEIGHT, EDGE = 640, 200, 36
INK, QUIET, ALERT = "#3b4754", "#9aa7b4", "#c2410c"
TAIL = 16


def _svg(label: str, parts: list[str]) -> str:
    text = html.escape(label, quote=True)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-label="{text}"><title>{text}</title>{"".join(parts)}</svg>'


def _text(x: float, y: float, value: str, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="11" fill="{INK}" text-anchor="{anchor}">{html.escape(value)}</text>'


def _short(v: float) -> str:
    return f"{v:.4g}"


def _scale(low: float, high: float, a: float, b: float):
    span = high - low
    return (lambda v: a + (v - low) / span * (b - a)) if span else (lambda v: (a + b) / 2)


def line(points: list[tuple], marks: dict[int, str] | None = None, band: tuple[int, int, str] | None = None, label: str = "") -> str:
    """(time, value) in order; marks are notes at points, band is a stretch of them with a note."""
    values = [float(v) for _, v in points]
    x, y = _scale(0, len(points) - 1, EDGE, WIDTH - EDGE), _scale(min(values), max(values), HEIGHT - EDGE, EDGE)
    out = []
    if band:
        a, b, note = band
        out.append(f'<rect x="{x(a):.1f}" y="{EDGE / 2}" width="{max(x(b) - x(a), 2):.1f}" height="{HEIGHT - EDGE}" fill="{ALERT}" opacity="0.15"/>' + _text(x(a), EDGE / 2 - 4, note))
    out.append(f'<polyline fill="none" stroke="{INK}" points="{" ".join(f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(values))}"/>')
    for i, note in (marks or {}).items():
        out.append(f'<circle cx="{x(i):.1f}" cy="{y(values[i]):.1f}" r="4" fill="{ALERT}"/>' + _text(x(i), y(values[i]) - 8, note, "middle"))
    out += [_text(4, EDGE - 8, _short(max(values))), _text(4, HEIGHT - EDGE + 14, _short(min(values))), _text(EDGE, HEIGHT - 6, str(points[0][0])[:19]), _text(WIDTH - EDGE, HEIGHT - 6, str(points[-1][0])[:19], "end")]
    return _svg(label, out)


def bars(counts: list[tuple[str, int, bool]], label: str = "", logged: bool = False) -> str:
    """(name, count, marked) in order; heights of logarithms where counts differ by decades."""
    size = (lambda n: math.log10(1 + n)) if logged else float
    top = max(size(n) for _, n, _ in counts) or 1
    step = (WIDTH - 2 * EDGE) / len(counts)
    out = [f'<rect x="{EDGE + i * step:.1f}" y="{HEIGHT - EDGE - size(n) / top * (HEIGHT - 2 * EDGE):.1f}" width="{max(step - 1, 1):.1f}" height="{size(n) / top * (HEIGHT - 2 * EDGE):.1f}" fill="{ALERT if marked else QUIET}"><title>{html.escape(name)}: {n}</title></rect>' for i, (name, n, marked) in enumerate(counts)]
    return _svg(label, [*out, _text(EDGE, HEIGHT - 6, counts[0][0]), _text(WIDTH - EDGE, HEIGHT - 6, counts[-1][0], "end")])


def timeline(cells: list[tuple[str, bool]], label: str = "") -> str:
    """(day, present) in order."""
    step = (WIDTH - 2 * EDGE) / len(cells)
    out = [f'<rect x="{EDGE + i * step:.2f}" y="{HEIGHT / 2 - 20}" width="{max(step * 0.9, 0.5):.2f}" height="40" fill="{QUIET if there else ALERT}"><title>{html.escape(day)}{"" if there else " missing"}</title></rect>' for i, (day, there) in enumerate(cells)]
    return _svg(label, [*out, _text(EDGE, HEIGHT - 6, cells[0][0]), _text(WIDTH - EDGE, HEIGHT - 6, cells[-1][0], "end")])


def _level_shift(f, c) -> str:
    keys, at = c.structure.group_columns, F.lit(f.evidence["t"]).cast(c.df.select(c.structure.time.alias("t")).schema["t"].dataType)
    own = T.locate_series(c.df, c.structure.time, keys, at).first() if keys else None
    df = c.df
    for k in keys if own else []:
        df = df.where(col(k).eqNullSafe(F.lit(own[k])))
    points = [(r["t"], r["v"]) for r in T.series_around(S.long(df, c.structure.time, keys, [f.column]), at).orderBy("rn").collect()]
    here = next((i for i, (t, _) in enumerate(points) if str(t) == f.evidence["t"]), None)
    if here is None:
        return ""
    return line(points, {here: "stays" if f.evidence["persists"] else "reverts"}, label=f"{f.column} around {f.evidence['t']}")


def _flatline(f, c) -> str:
    n = f.evidence["run"]
    points = [(r["t"], r["v"]) for r in T.series_tail(c.long([f.column]), min(n + TAIL, 420)).collect()][::-1]
    return line(points, band=(max(len(points) - n, 0), len(points) - 1, f"{n} equal values"), label=f"{f.column}, the latest values") if len(points) >= 3 else ""


def _residue(f, c) -> str:
    rows = S.decades(S.long(c.df, F.lit(0), [], [f.column])).orderBy("decade").collect()
    return bars([(f"1e{r['decade']}", r["n"], r["decade"] <= f.evidence["decade"]) for r in rows], f"{f.column} by order of magnitude", logged=True) if rows else ""


def _saturation(f, c) -> str:
    rows = {r["bin"]: r["n"] for r in T.value_bins(c.df, f.column).collect()}
    end = 39 if f.evidence["side"] == "maximum" else 0
    return bars([(str(i), rows.get(i, 0), i == end) for i in range(40)], f"{f.column}: distribution between its bounds") if rows else ""


def _gap(f, c) -> str:
    worst, df = f.evidence["largest"][0], c.df
    for k, v in zip(c.structure.group_columns, worst["series"], strict=False):
        df = df.where(col(k).cast("string").eqNullSafe(F.lit(None if v == "None" else v)))
    cells = T.coverage_cells(df, c.structure.time, f.evidence["cadence"], focus=F.to_date(F.lit(worst["from"][:10]))).orderBy("d").collect()
    return timeline([(str(r["d"]), r["present"]) for r in cells], "periods that are there and missing") if len(cells) >= 3 else ""


CHARTS = {"level_shift": _level_shift, "flatline_tail": _flatline, "negligible_residue": _residue, "saturation_at_bound": _saturation, "cadence_gap": _gap}


def chart_for(finding, context) -> str:
    """The finding's chart, or an empty text: a finding stands without one."""
    make = CHARTS.get(finding.check_id)
    if make is None or context is None:
        return ""
    try:
        return make(finding, context)
    except (PySparkException, ValueError, KeyError, TypeError):
        return ""

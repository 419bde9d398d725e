"""Inference of the time axis, the series key and the row key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions.columns import assembled_date, col, month_number
from plumbline.operators.profile import ColumnProfile


@dataclass
class Structure:
    time_axis: str | None = None
    time_parts: list[str] = field(default_factory=list)
    time_candidates: list[str] = field(default_factory=list)
    group_columns: list[str] = field(default_factory=list)
    grain: list[str] = field(default_factory=list)
    grain_unique: bool | None = None
    grain_declared: bool = False
    exhausted: bool = False
    excess_rows: int = 0
    unique_columns: list[str] = field(default_factory=list)
    assumptions: list[str] = field(default_factory=list)
    time: Column | None = None

    @property
    def has_time(self) -> bool:
        return self.time is not None

    def to_dict(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "time"}


def tuple_counts(df: DataFrame, keys: list[list[str]]) -> list[int]:
    """Distinct tuples of each key, nulls counting as values, in one job."""
    row = df.agg(*[F.count_distinct(F.struct(*[col(c) for c in k])) for k in keys]).first()
    return list(row)


def excess(df: DataFrame, key: list[str]) -> DataFrame:
    """(duplicate_keys, excess_rows) of a key."""
    n = df.groupBy(*[col(c) for c in key]).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("excess_rows"))


def _axis(profile: list[ColumnProfile], s: Structure) -> None:
    found = [p.name for p in profile if p.kind == "temporal" and p.name.lower() not in names.LOAD_NAMES]
    s.time_candidates = found
    if len(found) == 1:
        s.time_axis = found[0]
    elif found:
        s.time_axis = next((c for n in names.TIME_NAMES for c in found if c.lower() == n), None)
        if s.time_axis:
            s.assumptions.append(f"{s.time_axis} was taken as the observation date by its name")
    if s.time_axis:
        s.time = col(s.time_axis)


def _composite(profile: list[ColumnProfile], s: Structure) -> None:
    def numeric(wanted: tuple[str, ...], low: int, high: int) -> str | None:
        return next((p.name for p in profile if p.kind == "numeric" and p.name.lower() in wanted and p.integral and p.non_null and low <= p.min and p.max <= high), None)

    year = numeric(names.YEAR_NAMES, 1800, 2200)
    if not year:
        return
    month = numeric(names.MONTH_NAMES, 1, 12)
    label = None
    if not month:
        for p in profile:
            if p.kind == "text" and 0 < p.distinct <= 40:
                seen = " ".join(str(v) for v, _ in p.top).upper()
                if sum(t in seen for t in names.MONTH_TOKENS) >= 2:
                    label = p.name
                    break
    if not month and not label:
        return
    day, dekad = numeric(names.DAY_NAMES, 1, 31), numeric(names.DEKAD_NAMES, 1, 3)
    s.time_parts = [x for x in (year, month or label, day or dekad) if x]
    m = col(month) if month else month_number(col(label), names.MONTH_TOKENS)
    s.time = assembled_date(col(year), m, col(day) if day else None, col(dekad) if dekad and not day else None)
    s.assumptions.append(f"the observation date is assembled from {', '.join(s.time_parts)}")


def _grain(df: DataFrame, profile: list[ColumnProfile], s: Structure) -> None:
    rows = profile[0].rows if profile else 0
    s.unique_columns = [p.name for p in profile if p.distinct == p.non_null == p.rows and p.rows and (p.kind in ("text", "temporal") or p.kind == "numeric" and p.integral and not p.type.startswith(("float", "double")))]
    start = [s.time_axis] if s.time_axis else list(s.time_parts)
    if start:
        taken = set(start)
        ways = sorted((p for p in profile if p.name not in taken and (p.kind in ("text", "boolean") or p.kind == "numeric" and p.integral) and 1 < p.distinct <= names.MAX_GROUP_CARDINALITY and 2 * p.distinct <= rows), key=lambda p: p.distinct)
        tries = [start + [p.name for p in ways[:i]] for i in range(min(len(ways), names.MAX_GROUP_COLUMNS) + 1)]
        counts = tuple_counts(df, tries)
        hit = next((i for i, n in enumerate(counts) if n == rows), None)
        trial = tries[hit if hit is not None else -1]
        s.group_columns = trial[len(start) :]
        if hit is not None:
            s.grain, s.grain_unique = trial, True
            return
        if not s.unique_columns:
            s.grain, s.grain_unique, s.exhausted = trial, False, True
            s.excess_rows = excess(df, trial).first()["excess_rows"]
            return
        s.assumptions.append("series are told apart by columns that, with the date, are no key")
    if s.unique_columns:
        s.grain, s.grain_unique = s.unique_columns[:1], True


def infer(df: DataFrame, profile: list[ColumnProfile], declared: dict | None = None) -> Structure:
    """Declared time axis and grain go before what is found."""
    declared = declared or {}
    s = Structure()
    known = {p.name for p in profile}
    axis = declared.get("time_axis")
    if axis and axis not in known:
        s.assumptions.append(f"declared time axis {axis} isn't a column")
        axis = None
    if axis:
        s.time_axis, s.time = axis, col(axis)
    else:
        _axis(profile, s)
        if not s.has_time and not s.time_candidates:
            _composite(profile, s)
    _grain(df, profile, s)
    grain = list(declared.get("grain") or [])
    if grain and set(grain) <= known:
        s.grain, s.grain_declared, s.exhausted = grain, True, False
        s.group_columns = [c for c in grain if c != s.time_axis and c not in s.time_parts]
        s.excess_rows = excess(df, grain).first()["excess_rows"]
        s.grain_unique = not s.excess_rows
    elif grain:
        s.assumptions.append("the declared grain names unknown columns and is ignored")
    return s

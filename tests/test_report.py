"""Charts, report, command line, manifest and interview."""

import json
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.operators import tables as T
from plumbline.plans import audit as A
from plumbline.plans import charts, cli, interview
from plumbline.plans.manifest import Manifest, sidecar
from plumbline.sources import tables

DAY = date(2024, 1, 1)


def days(n):
    return [DAY + timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def audited(spark):
    """A table with a gap, a unit change, a stuck end and a pile-up."""
    kept = [i for i in range(160) if not 40 <= i < 52]
    rows = [(DAY + timedelta(days=i), 100.0 + i % 5 * 0.01 if i < 90 else 1000 * (100.0 + i % 5 * 0.01), float(i * 7919 % 101) if i < 140 else 3.5, 100.0 if i % 3 else float(i * 31 % 97)) for i in kept]
    df = spark.createDataFrame(rows, "d date, jump double, stuck double, full double")
    return A.audit(tables.Source(df, "x.parquet", "parquet", "strict", ""), as_of=DAY + timedelta(days=160))


def test_every_finding_with_a_chart_gets_one(audited):
    found = {f.check_id for f in audited.findings}
    assert {"cadence_gap", "level_shift", "flatline_tail", "saturation_at_bound"} <= found
    for f in audited.findings:
        svg = charts.chart_for(f, audited.context)
        assert svg.startswith("<svg") == (f.check_id in charts.CHARTS), f.check_id
    page = cli.html_report(audited)
    assert page.count("<svg") >= 4 and "<script>" not in page and "http://" not in page.replace("http://www.w3.org/2000/svg", "")


def test_gap_evidence_and_columns(audited):
    f = next(f for f in audited.findings if f.check_id == "cadence_gap")
    assert f.evidence["gaps"] == 1 and f.evidence["missing"] == 12 and f.evidence["jitter_excluded"] == 0


def test_jitter_is_no_gap(spark):
    dates = [DAY + timedelta(days=7 * i + (1 if i == 9 else 0)) for i in range(30)]
    df = spark.createDataFrame([(d, float(i * 31 % 17)) for i, d in enumerate(dates)], "d date, v double")
    a = A.audit(tables.Source(df, "", "parquet", "strict", ""), as_of=dates[-1])
    assert "cadence_gap" not in {f.check_id for f in a.findings}


def test_stale_tail_names_no_column_and_high_confidence_stays(spark):
    f = [A.Finding("a", "v", A.SUSPECT, A.HIGH, "", {}, ""), A.Finding("b", "v", A.SUSPECT, A.MEDIUM, "", {}, ""), A.Finding("c", "v", A.SUSPECT, A.LOW, "", {}, ""), A.Finding("d", None, A.SUSPECT, A.MEDIUM, "", {}, "")]
    A.corroborate(f)
    assert [(x.confidence, len(x.inputs)) for x in f] == [("high", 0), ("high", 1), ("low", 1), ("medium", 0)]
    df = spark.createDataFrame([(d, float(i * 31 % 17)) for i, d in enumerate(days(30))], "d date, v double")
    a = A.audit(tables.Source(df, "", "parquet", "strict", ""), as_of=DAY + timedelta(days=900))
    assert [x.column for x in a.findings if x.check_id == "stale_tail"] == [None]


def test_shifts_by_size():
    def step(t, s, before, after, column="v", excess=None):
        return {"column": column, "t": t, "step": s, "before": before, "after": after, "excess": excess or abs(s)}

    # the larger half of a spike comes later in time; its way out is left out all the same
    got = A.grade_shifts([step("1", 5.0, 0.0, 0.0), step("2", -6.0, 0.0, 0.0)], set(), ["v"])
    assert [(f.evidence["t"], f.disposition) for f in got] == [("2", "suspect")]
    # two columns at the same time break the file, at different times of a day they don't
    both = A.grade_shifts([step("1 00:00", 5.0, 0.0, 5.0), step("1 00:00", 5.0, 0.0, 5.0, "w")], set(), ["v", "w"])
    assert {f.disposition for f in both} == {"defect"}
    apart = A.grade_shifts([step("1 00:00", 5.0, 0.0, 5.0), step("1 06:00", 5.0, 0.0, 5.0, "w")], set(), ["v", "w"])
    assert {f.disposition for f in apart} == {"suspect"}


def test_saturation_limits(spark):
    rows = [(d, 1e-12 if i % 3 else i / 100, 100.0 + 1e-8 if i % 3 else float(i * 31 % 97)) for i, d in enumerate(days(120))]
    a = A.audit(tables.Source(spark.createDataFrame(rows, "d date, tiny double, near double"), "", "parquet", "strict", ""), as_of=DAY + timedelta(days=120))
    got = {(f.column, f.evidence["side"]): f.disposition for f in a.findings if f.check_id == "saturation_at_bound"}
    assert got == {("near", "maximum"): "defect"}


def test_numeric_keys_are_checked_too(spark):
    rows = [(d, 7, float(i * 31 % 17), 2024) for i, d in enumerate(days(30))]
    a = A.audit(tables.Source(spark.createDataFrame(rows, "d date, station int, v double, year int"), "", "parquet", "strict", ""), as_of=DAY + timedelta(days=30))
    assert {f.column for f in a.findings if f.check_id == "constant_numeric"} == {"station", "year"}


def test_measures():
    k = {"id": "numeric", "qty": "numeric", "price": "numeric", "t": "text", "x": "numeric", "y": "numeric"}
    got = T.classify_measures(k, {"id"}, {"aggregate": {"x": "mean", "y": "none", "price": "median"}, "additive": ["x"], "non_additive": ["qty", "y"]})
    assert got == {"qty": "mean", "price": "mean", "x": "sum"}


@pytest.mark.parametrize("sketch", [20, 2000])
def test_quantiles_are_exact(spark, monkeypatch, sketch):
    monkeypatch.setattr(P, "SKETCH", sketch)
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=9000), "b": rng.integers(0, 4, 5000).astype(float), "c": np.array([2.5])}
    df = spark.createDataFrame([(c, float(v)) for c, x in data.items() for v in x] + [("d", None)], "column string, v double")
    got = {r["column"]: r["quantiles"] for r in P.exact_quantiles(df).collect()}
    assert set(got) == set(data)
    for c, x in data.items():
        assert np.allclose(got[c], np.quantile(x, P.names.QUANTILES), rtol=0, atol=1e-12), c


def test_same_rows_with_many_columns(spark):
    df = spark.range(200).select(*[F.when((F.col("id") + i // 4) % 3 == 0, 1).alias(f"c{i}") for i in range(12)])
    flags = {c: F.col(c).isNull() for c in df.columns}
    counts = {c: df.where(flags[c]).count() for c in df.columns}
    assert sorted(map(sorted, P.same_rows(df, flags, counts))) == [["c0", "c1", "c2", "c3"], ["c10", "c11", "c8", "c9"], ["c4", "c5", "c6", "c7"]]


def test_coverage_cells_around_a_day(spark):
    kept = [d for i, d in enumerate(days(900)) if not 300 <= i < 310 and not 700 <= i < 703]
    df = spark.createDataFrame([(d,) for d in kept], "d date")
    cells = {r["d"]: r["present"] for r in T.coverage_cells(df, F.col("d"), 1, 100, F.lit(days(301)[-1])).collect()}
    assert len(cells) == 100 and sorted(d for d, p in cells.items() if not p) == days(310)[300:]
    # weekly data that slip a day have no hole
    weekly = spark.createDataFrame([(DAY + timedelta(days=7 * i + i % 2),) for i in range(20)], "d date")
    assert T.coverage_cells(weekly, F.col("d"), 7).where("not present").count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    p = str(tmp_path / "x.csv")
    with open(p, "w") as f:
        f.write("d;qty;note\n" + "".join(f"{d};{i % 7}.5;N/A\n" for i, d in enumerate(days(30))))
    assert cli.main(["profile", p]) == 0 and "string_sentinels" in capsys.readouterr().out
    assert cli.main(["profile", p, "--json"]) == 0 and json.loads(capsys.readouterr().out)["coverage"] == {"ran": [], "withheld": [], "blocked": []}
    other = str(tmp_path / "m.json")
    assert cli.main(["init", p, "-o", other]) == 0 and not sidecar(p).exists()
    m = Manifest.read(other)
    assert m.declared == {} and m.detected["aggregate"] == {"qty": "sum"} and m.schema["columns"] == ["d", "qty", "note"]
    assert cli.main(["init", p, "-o", other]) == 2
    assert cli.main(["declare", p, "--manifest", other, "--aggregate", "qty=mean", "--skip", "high_null"]) == 0
    assert Manifest.read(other).declared == {"aggregate": {"qty": "mean"}} and Manifest.read(other).skipped == ["high_null"]
    assert cli.main(["declare", p, "--manifest", other, "--aggregate", "gone=mean"]) == 2
    assert cli.main(["declare", p, "--manifest", other, "--aggregate", "qty=median"]) == 2
    m = Manifest.read(other)
    m.schema["columns"].append("gone")
    m.write(other)
    capsys.readouterr()
    assert cli.main(["audit", p, "--manifest", other, "--json"]) == 0
    assert "schema_drift" in {f["check_id"] for f in json.loads(capsys.readouterr().out)["findings"]}
    assert cli.main(["audit", p, "--manifest", other, "--fail-on-finding", "--report", str(tmp_path / "r.html")]) == 1
    assert (tmp_path / "r.html").exists() and (tmp_path / "r.html.flagged.csv").exists()
    capsys.readouterr()
    assert cli.main(["interview", p, "--redact-values"]) == 0 and "Cell values: none" in capsys.readouterr().out
    assert cli.main(["audit", str(tmp_path / "x.xlsx")]) == 2


def test_interview(audited):
    sent = cli.payload(audited)

    class Fake:
        def ask(self, system, prompt, schema):
            assert "owner" in prompt and set(schema["required"]) <= set(schema["properties"])
            return {"declarations": {"time_axis": "d", "grain": ["d", "nowhere"], "forecast_column": None, "shell": "x"}, "summary": "s", "questions": [{"ask": str(i)} for i in range(9)], "open": ["o"]}

    got = interview.interview(sent, Fake(), "sales")
    assert got.declarations == {"time_axis": "d"} and len(got.refused) == 2 and len(got.questions) == 5
    m = interview.propose(Manifest(), got)
    assert m.proposed == {"time_axis": "d"} and m.get("time_axis") is None
    assert interview.leaks(sent, ["secret-cell"]) == []
    assert interview.leaks(sent | {"note": "has secret-cell in it"}, ["secret-cell"]) == ["secret-cell"]
    assert "No row of the table" in interview.describe(sent)


def test_declined_questions(spark):
    df = spark.createDataFrame([(d, float(i % 7), None if i % 2 else 1.0) for i, d in enumerate(days(30))], "d date, v double, w double")
    a = A.audit(tables.Source(df, "", "parquet", "strict", ""), Manifest(skipped=["high_null"]), as_of=DAY + timedelta(days=30))
    assert [n.code for n in a.declined()] == ["high_null"] and "high_null" not in {n.code for n in a.questions()}
    assert a.to_dict()["declined_questions"] and "declined high_null" in cli.text_report(a)

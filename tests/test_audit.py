"""Whole audits of small files: what fires, what stays silent, what is withheld or blocked."""

from datetime import date, timedelta

import pytest

from plumbline.plans import audit as A
from plumbline.plans.manifest import Manifest, sidecar
from plumbline.sources import rawscan, tables

DAY = date(2024, 1, 1)


def days(n):
    return [DAY + timedelta(days=i) for i in range(n)]


def run(spark, rows, schema, manifest=None, as_of=None, rollup=False, order=None):
    df = spark.createDataFrame(rows, schema)
    as_of = as_of or DAY + timedelta(days=len(rows))
    return A.audit(tables.Source(df, "", "parquet", "strict", "", order=order), manifest, rollup, as_of)


def ids(a):
    return {(f.check_id, f.disposition) for f in a.findings}


def test_coverage_is_total(spark):
    a = run(spark, [(d, float(i % 7)) for i, d in enumerate(days(40))], "d date, v double")
    assert [c[0] for c in a.coverage] == [c.id for c in A.CATALOG]
    assert {c[1] for c in a.coverage} <= {"ran", "withheld", "blocked"}


def test_constant_and_negative_zero(spark):
    a = run(spark, [(d, -0.0) for d in days(20)], "d date, v double")
    f = next(f for f in a.findings if f.check_id == "constant_numeric")
    assert f.evidence["all_zero"]


def test_mojibake_only_pairs(spark):
    a = run(spark, [(d, "SÃO PAULO") for d in days(19)], "d date, name string")
    assert not [f for f in a.findings if f.check_id == "mojibake"]
    a = run(spark, [(d, "CafÃ©") for d in days(19)], "d date, name string")
    assert ("mojibake", "defect") in ids(a)


def test_repeated_key_blocks(spark):
    a = run(spark, [(DAY, "x", i) for i in range(40)], "d date, tag string, payload int")
    assert next(c for c in a.coverage if c[0] == "duplicate_grain")[1] in ("blocked", "ran")
    m = Manifest(declared={"grain": ["d", "tag"]})
    a = run(spark, [(DAY, "x", i) for i in range(40)], "d date, tag string, payload int", m)
    assert ("duplicate_grain", "defect") in ids(a)


def test_key_of_millions_of_rows_is_counted_exactly(spark):
    ids = spark.range(2_100_000)
    for df, status in ((ids, "ran"), (ids.unionAll(spark.range(1)), "blocked")):
        a = A.audit(tables.Source(df, "", "parquet", "strict", ""), as_of=DAY)
        assert a.profile[0].distinct == 2_100_000 and a.profile[0].distinct_exact
        assert next(c for c in a.coverage if c[0] == "duplicate_grain")[1] == status


def test_future_rows_need_a_flag_to_be_fine(spark):
    rows = [(d, float(i), True) for i, d in enumerate(days(40))]
    a = run(spark, rows, "d date, v double, is_forecast boolean", as_of=DAY + timedelta(days=20))
    assert ("future_dates", "bookkeeping") in ids(a)
    a = run(spark, [r[:2] for r in rows], "d date, v double", as_of=DAY + timedelta(days=20))
    assert ("future_dates", "suspect") in ids(a)


def test_gap_and_weekends(spark):
    rows = [(d, float(i * 37 % 11)) for i, d in enumerate(days(60)) if d.weekday() < 5]
    assert "cadence_gap" not in {x for x, _ in ids(run(spark, rows, "d date, v double"))}
    a = run(spark, [r for r in rows if not 20 <= (r[0] - DAY).days < 35], "d date, v double")
    assert "cadence_gap" in {x for x, _ in ids(a)}


def test_unit_change_and_spike(spark):
    flat = [(d, 100 + i % 5 * 0.01) for i, d in enumerate(days(120))]
    a = run(spark, [(d, float(v * (1000 if i >= 60 else 1))) for i, (d, v) in enumerate(flat)], "d date, v double")
    assert ("level_shift", "defect") in ids(a)
    a = run(spark, [(d, float(v * (1000 if i == 60 else 1))) for i, (d, v) in enumerate(flat)], "d date, v double")
    assert [f.disposition for f in a.findings if f.check_id == "level_shift"] == ["suspect"]


def test_flat_tail_saturation_residue(spark):
    rows = [(d, float(i * 7919 % 101) if i < 50 else 3.5) for i, d in enumerate(days(60))]
    assert "flatline_tail" in {x for x, _ in ids(run(spark, rows, "d date, v double"))}
    rows = [(d, 100.0 if i % 3 else float(i * 7919 % 97)) for i, d in enumerate(days(120))]
    assert ("saturation_at_bound", "defect") in ids(run(spark, rows, "d date, v double"))
    rows = [(d, -7e-22 if i % 5 == 0 else 100.0 + i) for i, d in enumerate(days(60))]
    assert ("negligible_residue", "defect") in ids(run(spark, rows, "d date, v double"))


def test_nonfinite_never_reaches_a_finding(spark):
    rows = [(d, float("nan") if i % 10 == 0 else float(i % 13)) for i, d in enumerate(days(42))]
    a = run(spark, rows, "d date, v double")
    assert any(n.code == "non_finite_values" for n in a.notes)
    assert "nan" not in str([f.to_dict() for f in a.findings]).lower()


def test_composite_axis(spark):
    rows = [("n", 2020 + i // 36, i // 3 % 12 + 1, i % 3 + 1, float(i * 31 % 17)) for i in range(72)]
    a = run(spark, rows, "region string, year int, month int, dekad int, v double")
    assert a.structure.time_parts == ["year", "month", "dekad"]


def test_rollup_reports_only_new(spark):
    rows = [(d, r, float(100 + i * 7 % 13), 1.0) for i, d in enumerate(days(40)) for r in ("a", "b")]
    a = run(spark, rows, "d date, region string, qty double, share double", rollup=True)
    assert a.rollups and all(not ({f.key() for f in r.findings} & {f.key() for f in a.findings}) for r in a.rollups)


def test_csv_round_trip_and_manifest(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("d;v\n" + "".join(f"{d};{i % 7}\n" for i, d in enumerate(days(30))))
    s = tables.load(spark, str(p))
    assert s.delimiter == ";" and s.df.count() == 30 and len(s.sha256) == 64
    Manifest(schema={"columns": ["d", "v", "gone"]}).write(sidecar(str(p)))
    a = A.run(spark, str(p), as_of=DAY + timedelta(days=30))
    assert ("schema_drift", "defect") in ids(a)
    with pytest.raises(tables.UnsupportedFormat):
        tables.reader_for("x.xlsx")


def test_row_order_changes_only_file_order(spark, tmp_path):
    rows = [(d, float(i * 31 % 17)) for i, d in enumerate(days(40))]
    def stored(name, data):
        spark.createDataFrame(data, "d date, v double").coalesce(1).write.parquet(str(tmp_path / name))
        import glob
        return A.run(spark, glob.glob(str(tmp_path / name / "*.parquet"))[0], as_of=DAY + timedelta(days=41))
    a, b = stored("a.parquet", rows), stored("b.parquet", rows[20:] + rows[:20])
    assert ids(a) ^ ids(b) == {("file_order", "defect")}


def test_raw_verdicts():
    t = dict.fromkeys(("number_eu", "number_us", "number_ambiguous", "date_iso", "date_parts", "date_first_high", "date_second_high"), 0)
    assert rawscan.decimal_verdict(t | {"number_eu": 1, "number_us": 1}) == "conflicting"
    assert rawscan.decimal_verdict(t | {"number_ambiguous": 3}) == "ambiguous"
    assert rawscan.date_verdict(t | {"date_parts": 2, "date_first_high": 1}) == "DD/MM"
    assert rawscan.decode(b"\xef\xbb\xbfa")[0] == "a" and "fallback" in rawscan.decode(b"\xe9")[1]

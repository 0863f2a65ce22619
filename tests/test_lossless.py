"""Writers and readers that must lose nothing: other months, digits, entries without id, list order."""

import json

from pyspark.sql import functions as F

from gustledger.functions.numbers import decimal_comma
from gustledger.operators.adjustments import edit_adjustments
from gustledger.sources import readers, writers


def test_grouped_tables_and_reports_of_other_months_stay(spark, tmp_path):
    month = lambda p, x: spark.createDataFrame([(1, p, 7, x)], "row int, period string, StationId int, ELX double")
    path = str(tmp_path / "grouped")
    writers.write_grouped(month("2024-01", 12345678.91), path)
    writers.write_grouped(month("2024-02", 0.0005), path)
    writers.write_grouped(month("2024-02", 3.5), path)
    got = spark.read.option("header", True).csv(path).orderBy("period").collect()
    assert [(str(r["period"])[:7], r["ELX"]) for r in got] == [("2024-01", "12345678,91"), ("2024-02", "3,5")]
    issues = lambda p: spark.createDataFrame([(p, "gap")], "period string, type string")
    for p in ("2024-01", "2024-02"):
        writers.write_report(issues(p), issues(p), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "issues")).count() == 2


def test_decimal_comma_has_no_exponent(spark):
    values = [12345678.91, 0.0005, 1e7, -2.5e-7, 0.1, 0.0, 1.5, 123456789012345.6, None, float("nan")]
    out = decimal_comma(spark.createDataFrame([(v,) for v in values], "x double")).collect()
    assert [r["x"] for r in out] == ["12345678,91", "0,0005", "10000000,0", "-0,00000025", "0,1", "0,0", "1,5", "123456789012345,6", None, "NaN"]


def test_edits_keep_entries_without_id(spark):
    schema = "pos long, id long, alarm_code int, station_nr long, time_on string, time_off string, notes string, last_updated string"
    adj = spark.createDataFrame([(0, 5, 1, 1, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "a", "t"), (1, None, 1, 1, None, None, "b", "t")], schema)
    edits = spark.createDataFrame([(5, None, None, "new")], "id long, time_on string, time_off string, notes string")
    after, refused = edit_adjustments(adj, edits, "now")
    assert sorted((r["pos"], r["id"], r["notes"]) for r in after.collect()) == [(0, 5, "new"), (1, None, "b")]
    assert refused.count() == 0


def test_positions_grow_over_documents(spark, tmp_path):
    path = tmp_path / "adjustments.json"
    entry = lambda i, note: {"id": i, "notes": note}
    path.write_text("\n".join(json.dumps({"adjustments": [entry(1, f"{k}a"), entry(2, f"{k}b")]}) for k in range(3)))
    rows = readers.read_adjustments(spark, str(path), one_document=False).orderBy("pos").collect()
    assert [r["notes"] for r in rows] == ["0a", "0b", "1a", "1b", "2a", "2b"]
    assert len({r["pos"] for r in rows}) == 6


def test_first_line_of_a_repeated_code_counts(spark, tmp_path):
    path = tmp_path / "alarms.csv"
    names = [f.name for f in readers.S.CODE_SCHEMA.fields] if hasattr(readers.S.CODE_SCHEMA, "fields") else [c.strip().strip("`").split("` ")[0].split(" ")[0] for c in readers.S.CODE_SCHEMA.split(",")]
    line = lambda number, kind: ",".join({"Number": str(number), "Error Type": str(kind)}.get(n, "text") for n in names)
    path.write_text("\n".join([",".join(names), line(10, 2), line(10, 0), line(11, 1)]))
    got = {r["Alarmcode"]: r["Error Type"] for r in readers.read_alarm_codes(spark, str(path)).select("Alarmcode", F.col("Error Type")).collect()}
    assert got == {10: 2, 11: 1}

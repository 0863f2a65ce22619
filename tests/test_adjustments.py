"""Corrections: overlay against a plain loop, and the edits of the list."""

import random
from datetime import datetime

import pytest

from gustledger.operators import adjustments as J
from gustledger.operators.reconcile import reconcile
from gustledger.plans.export import export_rows, incremental_export
from gustledger.sources.state import state_checksum

ADJ = "pos long, id long, alarm_code long, station_nr long, time_on string, time_off string, notes string, last_updated string"
ALARM = "ID long, TimeOn timestamp_ntz, TimeOff timestamp_ntz"
NOW = "2024-02-01T00:00:00"


def T(day, hour=0):
    return datetime(2024, 1, day, hour)


def entry(pos, ident, on=None, off=None, notes="", code=1, station=1):
    return (pos, ident, code, station, on, off, notes, None)


def overlay_loop(alarms, entries):
    """Apply entries one after the other to a copy of the log."""
    state, stale = {a[0]: [a[1], a[2]] for a in alarms}, set()

    def parsed(text):
        try:
            return datetime.strptime(text, "%Y-%m-%d %H:%M:%S") if text else None
        except ValueError:
            return None

    for _, ident, _, _, on, off, notes, _ in sorted(entries):
        if ident not in state:
            continue
        if "Auto-imputed" in notes and off is not None and state[ident][1] is not None:
            stale.add(ident)
            continue
        state[ident][1] = parsed(off) or state[ident][1]
        state[ident][0] = parsed(on) or state[ident][0]
    return {k: tuple(v) for k, v in state.items()}, stale


@pytest.mark.parametrize("seed", range(3))
def test_overlay_against_a_loop(spark, seed):
    rng = random.Random(seed)
    alarms = [(i, T(1, i % 24), None if rng.random() < 0.5 else T(2, i % 24)) for i in range(60)]
    texts = [None, "", "rubbish", *[f"2024-01-{d:02d} 00:00:00" for d in range(3, 28)]]
    entries = [
        entry(p, rng.randrange(70), rng.choice(texts), rng.choice(texts), rng.choice(["", "by hand", "Auto-imputed from production data"]))
        for p in range(300)
    ]
    al, adj = spark.createDataFrame(alarms, ALARM), spark.createDataFrame(entries, ADJ)
    want, stale = overlay_loop(alarms, entries)
    assert {r["ID"]: (r["TimeOn"], r["TimeOff"]) for r in J.apply_adjustments(al, adj).collect()} == want
    assert {r["id"] for r in J.stale_adjustments(al, adj).collect()} == stale


def test_start_and_end_in_two_entries_both_count(spark):
    al = spark.createDataFrame([(1, T(1), T(2))], ALARM)
    adj = spark.createDataFrame([entry(0, 1, on="2024-01-05 00:00:00"), entry(1, 1, off="2024-01-06 00:00:00")], ADJ)
    row = J.apply_adjustments(al, adj).first()
    assert (row["TimeOn"], row["TimeOff"]) == (T(5), T(6))


def test_upsert_updates_the_last_entry_and_inserts_in_order(spark):
    adj = spark.createDataFrame([entry(0, 1, off="a", notes="first"), entry(1, 1, off="b", notes="second")], ADJ)
    changes = spark.createDataFrame(
        [
            (0, 1, 9, 9, None, None, None, False, True, False),
            (1, 7, None, 5, "x", None, None, True, False, False),
            (2, 7, 3, 3, None, None, "later", False, False, True),
            (3, None, 1, 1, "x", None, None, True, False, False),
        ],
        "pos long, id long, alarm_code long, station_nr long, time_on string, time_off string, notes string, set_time_on boolean, set_time_off boolean, set_notes boolean",
    )
    got = [tuple(r) for r in J.upsert_adjustments(adj, changes, NOW).orderBy("pos").collect()]
    assert got == [
        (0, 1, 1, 1, None, "a", "first", None),
        (1, 1, 1, 1, None, None, "second", NOW),
        (3, 7, 0, 5, "x", None, "later", NOW),
    ]


def test_add_refuses_known_ids_bad_times_and_reversed_times(spark):
    adj = spark.createDataFrame([entry(0, 1)], ADJ)
    new = spark.createDataFrame(
        [
            (0, 1, 1, 1, "2024-01-01 00:00:00", None, ""),
            (1, 2, 1, 1, None, "", ""),
            (2, 3, 1, 1, "2024-01-01", None, ""),
            (3, 4, 1, 1, "2024-01-02 00:00:00", "2024-01-02 00:00:00", ""),
            (4, 5, 1, 1, "2024-01-02 00:00:00", "2024-01-03 00:00:00", None),
            (5, 5, 1, 1, "2024-01-04 00:00:00", None, ""),
        ],
        "pos long, id long, alarm_code long, station_nr long, time_on string, time_off string, notes string",
    )
    kept, refused = J.add_adjustments(adj, new, NOW)
    assert [(r["pos"], r["id"], r["notes"]) for r in kept.orderBy("pos").collect()] == [(0, 1, ""), (5, 5, "")]
    assert {r["pos"]: r["reason"] for r in refused.collect()} == {
        0: "id exists", 1: "no time given", 2: "bad time_on", 3: "end not after start", 5: "id exists",
    }


def test_edit_checks_the_new_start_against_the_stored_end(spark):
    adj = spark.createDataFrame(
        [entry(0, 1, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), entry(1, 1, "2024-01-01 00:00:00"), entry(2, 2, "2024-01-01 00:00:00")], ADJ
    )
    edits = spark.createDataFrame(
        [(1, "2024-01-03 00:00:00", "2024-01-04 00:00:00", "x"), (2, None, "2024-01-05 00:00:00", ""), (9, None, None, "x")],
        "id long, time_on string, time_off string, notes string",
    )
    kept, refused = J.edit_adjustments(adj, edits, NOW)
    assert {r["id"]: r["reason"] for r in refused.collect()} == {1: "start not before end", 9: "id not found"}
    got = {r["pos"]: (r["time_off"], r["notes"], r["last_updated"]) for r in kept.collect()}
    assert got == {0: ("2024-01-02 00:00:00", "", None), 1: (None, "", None), 2: ("2024-01-05 00:00:00", "", NOW)}


def test_remove_and_bulk_update(spark):
    adj = spark.createDataFrame([entry(0, 1), entry(1, 2), entry(2, 1)], ADJ)
    ids = spark.createDataFrame([(1,), (1,)], "id long")
    assert [r["id"] for r in J.remove_adjustments(adj, ids).collect()] == [2]
    assert [r["notes"] for r in J.update_adjustments(adj, ids, NOW, notes="n").orderBy("pos").collect()] == ["n", "", "n"]


def test_page_beyond_the_end_is_empty_and_totals_are_whole(spark):
    adj = spark.createDataFrame([entry(p, p) for p in range(7)], ADJ)
    page = J.adjustment_page(adj, page=3, size=3).collect()
    assert [(r["id"], r["total"], r["total_pages"]) for r in page] == [(0, 7, 3)]
    assert J.adjustment_page(adj, page=4, size=3).count() == 0


def test_reconcile_keeps_deleted_rows_and_source_nulls_win(spark):
    source = spark.createDataFrame([(1, None, "s"), (2, 2, "s")], "k long, v long, fresh string")
    stored = spark.createDataFrame([(1, 9, "e"), (3, 3, "e")], "k long, v long, old string")
    out = reconcile(source, stored, ["k"])
    assert out.columns == ["k", "v", "old", "fresh", "_change"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, None, "s", "common"), (2, 2, None, "s", "new"), (3, 3, "e", None, "kept")]


def test_export_modes(spark):
    source = spark.createDataFrame([(1, T(1), None)], ALARM)
    stored = spark.createDataFrame([(1, T(1), T(9)), (2, T(3), T(4))], ALARM)
    adj = spark.createDataFrame([entry(0, 1, off="2024-01-05 00:00:00"), entry(1, 2, off="2024-01-06 00:00:00")], ADJ)

    def ends(mode):
        return {r["ID"]: r["TimeOff"] for r in export_rows("sum", source, stored, adj, mode).collect()}

    assert ends("append") == {1: T(5), 2: T(4)}
    assert ends("force-overwrite") == {1: T(5)}
    assert ends("process-existing") == {1: T(5), 2: T(6)}
    assert ends("process-existing-except-alarms") == {1: T(5), 2: T(4)}


def test_reconcile_keeps_the_stored_type(spark):
    source = spark.createDataFrame([(1, 2.0)], "k long, v double")
    stored = spark.createDataFrame([(1, 7), (2, 8)], "k long, v int")
    out = reconcile(source, stored, ["k"])
    assert dict(out.dtypes)["v"] == "int"
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, 2), (2, 8)]


def test_incremental_export_leaves_unchanged_months_alone(spark):
    schema = f"period string, {ALARM}"
    stored = spark.createDataFrame([("2024-01", 1, T(1), T(2)), ("2024-02", 1, T(3), T(4)), ("2024-02", 2, T(3), T(4))], schema)
    source = spark.createDataFrame([("2024-01", 1, T(1), T(2)), ("2024-02", 1, T(3), T(5)), ("2024-03", 3, T(6), None)], schema)
    columns = ["ID", "TimeOn", "TimeOff"]
    log = state_checksum(stored, columns, ["period"]).selectExpr("*", "'a' AS last_updated")
    done = incremental_export("sum", source, stored, log, columns, "b")
    rows = {(r["period"], r["ID"]): r["TimeOff"] for r in done.rows.collect()}
    assert rows == {("2024-02", 1): T(5), ("2024-02", 2): T(4), ("2024-03", 3): None}
    assert sorted((r["period"], r["row_count"], r["last_updated"]) for r in done.state.collect()) == [("2024-02", 1, "b"), ("2024-03", 1, "b")]
    again = incremental_export("sum", source, stored, log.unionByName(done.state), columns, "c")
    assert again.rows.isEmpty() and again.state.isEmpty()

"""The correction journal against edits made one after the other, and what survives writers and dead runs."""

import random

import pytest
from pyspark.sql import functions as F

from gustledger.operators import adjustments as J
from gustledger.sources import journal
from test_adjustments import ADJ, NOW, entry

CHANGES = (
    "pos long, id long, alarm_code long, station_nr long, time_on string, time_off string, notes string, "
    "set_time_on boolean, set_time_off boolean, set_notes boolean"
)


def change(pos, ident, on=None, off=None, notes=None, code=1, station=1):
    return (pos, ident, code, station, on, off, notes, on is not None, off is not None, notes is not None)


def listed(df):
    """Rows in list order, without their places."""
    return [tuple(r)[1:] for r in df.select("pos", *[c for c in df.columns if c != "pos"]).orderBy("pos").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_edits_one_after_the_other(spark, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path)
    adj = spark.createDataFrame([entry(p, rng.choice([1, 2, 3, None]), on=f"on{p}", notes="n") for p in range(6)], ADJ)
    journal.create(adj, path)
    for batch in range(5):
        now = f"2024-02-0{batch + 1}T00:00:00"
        if batch in (2, 3):
            ids = spark.createDataFrame([(rng.randrange(7),), (rng.randrange(7),)], "id long")
            adj = J.remove_adjustments(adj, ids)
            journal.append_removal(ids, path, now)
        else:
            rows = [change(p, rng.randrange(7), *[rng.choice([None, f"{k}{batch}{p}"]) for k in ("on", "off", "note")], code=p) for p in range(5)]
            changes = spark.createDataFrame(rows, CHANGES)
            adj = J.upsert_adjustments(adj, changes, now)
            journal.append(changes, path, now)
        adj = spark.createDataFrame(adj.select(*[n.split()[0] for n in ADJ.split(", ")]).collect(), ADJ)
        if batch == 2:
            journal.compact(spark, path)
    assert listed(journal.read(spark, path)) == listed(adj)


def test_batches_of_two_writers_both_survive_and_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    journal.create(spark.createDataFrame([entry(0, 1, notes="old")], ADJ), path)
    stale = journal.read(spark, path)
    for ident in (2, 3):
        # Either writer has seen the list without the other's batch.
        journal.append(spark.createDataFrame([change(0, ident, on="x"), change(1, 1, off=f"end{ident}")], CHANGES), path, NOW)
    before = listed(journal.read(spark, path))
    assert [(r[0], r[4]) for r in before] == [(1, "end3"), (2, None), (3, None)]
    assert stale.count() == 1
    for version in (1, 2):
        assert journal.compact(spark, path) == version
        assert listed(journal.read(spark, path)) == before
    journal.append(spark.createDataFrame([change(0, 4, on="y")], CHANGES), path, NOW)
    assert [r[0] for r in listed(journal.read(spark, path))] == [1, 2, 3, 4]
    journal.clean(spark, path)
    assert [r[0] for r in listed(journal.read(spark, path))] == [1, 2, 3, 4]
    assert len(list((tmp_path / "log").iterdir())) == 1 and len(list((tmp_path / "base").iterdir())) == 1


def test_runs_that_die_leave_the_list_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    journal.create(spark.createDataFrame([entry(0, 1, notes="old")], ADJ), path)
    journal.append(spark.createDataFrame([change(0, 2, on="x")], CHANGES), path, NOW)
    before = listed(journal.read(spark, path))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(journal, "_appear", die)
        with pytest.raises(RuntimeError):
            journal.compact(spark, path)
        with pytest.raises(RuntimeError):
            journal.append(spark.createDataFrame([change(0, 9, on="x")], CHANGES), path, NOW)
    assert listed(journal.read(spark, path)) == before
    assert journal.compact(spark, path) == 1
    journal.clean(spark, path)
    assert listed(journal.read(spark, path)) == before
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("staged")]


def test_a_batch_with_an_older_name_that_appears_late_is_folded(spark, tmp_path):
    path = str(tmp_path)
    journal.create(spark.createDataFrame([entry(0, 1, notes="old")], ADJ), path)
    name = journal.append(spark.createDataFrame([change(0, 2, on="x")], CHANGES), path, NOW)
    journal.compact(spark, path)
    late = spark.createDataFrame([change(0, 5, on="late")], CHANGES).withColumns({"removed": F.lit(False), "last_updated": F.lit(NOW)})
    late.write.parquet(f"{path}/log/batch=0{name[1:-1]}!")
    assert [r[0] for r in listed(journal.read(spark, path))] == [1, 2, 5]


@pytest.mark.parametrize("order", [{}, {"sort_by": "notes"}, {"sort_by": "alarm_code", "desc": True}])
def test_pages_that_follow_each_other_cover_the_list(spark, order):
    rows = [(p, p % 3 or None, p % 2 or None, 1, None, None, ["a", "", None][p % 3], None) for p in range(11)]
    adj = spark.createDataFrame(rows, ADJ)
    wanted = [r["pos"] for r in J.adjustment_page(adj, size=20, **order).collect()]
    got, last = [], None
    while page := J.adjustment_page_after(adj, last, size=3, **order).collect():
        got += [r["pos"] for r in page]
        last = page[-1]
    assert got == wanted and len(got) == 11

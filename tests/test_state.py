"""Change states: what counts as a change, merging by file, and runs that die between publication and state."""

import random

import pytest
from pyspark.sql import functions as F

from gustledger.plans import export
from gustledger.sources import state, writers

COLUMNS = ["a", "b"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "period string, a double, b double")


def status(spark, before, after):
    states = [state.state_checksum(frame(spark, [("m", *r) for r in rows]), COLUMNS, ["period"]) for rows in (after, before)]
    return state.changed_periods(*states, ["period"]).first()["status"]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ([(5.0, None)], [(None, 5.0)]),
        ([(1.0, 1.0)] * 2, [(2.0, 2.0)] * 2),
        ([(None, None)] * 2, [(0.0, None)] * 2),
        ([(1.0, 2.0), (3.0, 4.0)], [(1.0, 4.0), (3.0, 2.0)]),
        ([(1.0, 2.0)], [(2.0, 1.0)]),
        ([(float("nan"), 1.0)], [(None, 1.0)]),
        ([(1.0, 2.0)] * 3, [(1.0, 2.0)] * 2),
    ],
)
def test_every_change_is_seen(spark, before, after):
    assert status(spark, before, after) == status(spark, after, before) == "CHANGE_DETECTED"
    assert status(spark, after, after[::-1]) == "NO_CHANGE"


def test_states_of_parts_add_up(spark):
    rng = random.Random(3)
    rows = [(rng.choice("mn"), rng.choice([None, 1.0, 2.0]), rng.choice([None, -1.0, 0.5])) for _ in range(200)]
    parts = [state.state_checksum(frame(spark, rows[i::3]), COLUMNS, ["period"]) for i in range(3)]
    merged = state.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["period"]).collect()
    assert sorted(merged) == sorted(state.state_checksum(frame(spark, rows), COLUMNS, ["period"]).collect())
    nothing = state.state_checksum(frame(spark, []), COLUMNS)
    assert nothing.collect() == state.merge_states(nothing.where("row_count > 0")).collect() and nothing.first()["row_count"] == 0


def test_only_changed_files_are_read_again(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_partitioned(frame(spark, [("m", 1.0, None), ("n", 2.0, 3.0), ("o", 1.0, 1.0)]), path)
    read = []

    def reader(paths):
        read.append(sorted(p.split("period=")[1][0] for p in paths))
        return spark.read.option("basePath", path).parquet(*paths)

    def refresh(known):
        return spark.createDataFrame(state.file_states(spark, path, COLUMNS, known, read=reader).collect(), first.schema)

    first = state.file_states(spark, path, COLUMNS, read=reader)
    known = spark.createDataFrame(first.collect(), first.schema)
    assert refresh(known).count() == 3 and read == [["m", "n", "o"]]
    writers.write_partitioned(frame(spark, [("n", 2.0, 4.0), ("p", 0.0, 0.0)]), path)
    known = refresh(known)
    assert read[1:] == [["n", "p"]]
    whole = state.state_checksum(spark.read.parquet(path), COLUMNS, ["period"])
    assert sorted(state.merge_states(known, ["period"]).collect()) == sorted(whole.collect())


def alarms(spark, rows):
    return spark.createDataFrame(rows, "period string, ID long, value string")


def run(spark, rows, path, when):
    return export.publish_export(spark, "sum", alarms(spark, rows), path, ["ID", "value"], when)


def stored(spark, path):
    return sorted((r["period"], r["ID"], r["value"]) for r in spark.read.parquet(path).collect())


def test_published_months_and_states(spark, tmp_path):
    path = str(tmp_path / "t")
    done = run(spark, [("m", 1, "a"), ("n", 2, "b"), ("n", 3, None)], path, "1")
    assert sorted(r["period"] for r in done.state.collect()) == ["m", "n"] and done.rows.count() == 3
    done = run(spark, [("m", 1, "a"), ("n", 2, None), ("n", 3, "b"), ("o", 4, "c")], path, "2")
    assert sorted(r["period"] for r in done.state.collect()) == ["n", "o"]
    assert stored(spark, path) == [("m", 1, "a"), ("n", 2, None), ("n", 3, "b"), ("o", 4, "c")]
    assert run(spark, [("m", 1, "a"), ("n", 2, None), ("n", 3, "b"), ("o", 4, "c")], path, "3").state.isEmpty()
    log = spark.read.parquet(f"{path}_state")
    assert {r["period"]: r["last_updated"] for r in state.latest_state(log, ["period"]).collect()} == {"m": "1", "n": "2", "o": "2"}


@pytest.mark.parametrize("step", ["stage", "publish", "append_state"])
def test_run_that_dies_is_made_up_for(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    old, new = [("m", 1, "a"), ("n", 2, "b")], [("m", 1, "a"), ("n", 2, "c")]
    run(spark, old, path, "1")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(writers, step, dies)
        with pytest.raises(RuntimeError, match="lost"):
            run(spark, new, path, "2")
    # The state never claims more than is stored.
    assert spark.read.parquet(f"{path}_state").where("last_updated = '2'").isEmpty()
    assert stored(spark, path) == (new if step == "append_state" else old)
    assert [r["period"] for r in run(spark, new, path, "3").state.collect()] == ["n"]
    assert stored(spark, path) == new
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "t_state"]


def test_month_set_aside_comes_back(spark, tmp_path):
    path = tmp_path / "t"
    run(spark, [("m", 1, "a"), ("n", 2, "b")], str(path), "1")
    (tmp_path / "t.aside-x").mkdir()
    (path / "period=n").rename(tmp_path / "t.aside-x" / "period=n")
    assert writers.recover(spark, str(path)) == ["period=n"]
    assert stored(spark, str(path)) == [("m", 1, "a"), ("n", 2, "b")]
    assert writers.recover(spark, str(path)) == [] and writers.recover(spark, str(tmp_path / "none" / "t")) == []


def test_marks_differ_by_seed(spark):
    df = frame(spark, [("m", 1.0, None)]).select(*[state.row_mark(COLUMNS, s).alias(f"s{s}") for s in state.SEEDS])
    assert len(set(df.first())) == len(state.SEEDS)
    assert df.select(F.expr("s1 IS NOT NULL")).first()[0]

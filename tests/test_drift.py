import json
from datetime import datetime, timedelta

from traceloom.operators import drift

DAY = datetime(2026, 1, 1)


def files(spark, docs, station="s"):
    rows = [(i, station, DAY + timedelta(days=20 * i), "p", d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "file_id long, station string, saved_at timestamp, stream string, text string")


def found(spark, docs):
    return sorted((r["file_id"], r["change"], r["field"], r["new_field"]) for r in drift.changes(files(spark, docs)).collect() if r["change"] != "followed")


def test_changes_across_buckets(spark):
    docs = [{"a": 1, "b": {"c": "x"}}, None, "{broken", {"a": 1.0, "d": {"c": "x"}}, {"a": True, "d": {"c": "x"}, "e": []}, {"d": {"c": "x"}, "e": []}, [1]]
    assert found(spark, docs) == [(3, "renamed", "b.c", "d.c"), (4, "added", "e", ""), (4, "type_changed", "a", ""), (5, "removed", "a", "")]


def test_values_that_are_not_unique_are_no_renames(spark):
    assert found(spark, [{"a": 1, "b": 1}, {"c": 1, "d": 1}]) == [(1, "added", "c", ""), (1, "added", "d", ""), (1, "removed", "a", ""), (1, "removed", "b", "")]


def test_one_table_follows_chains(spark):
    rows = files(spark, [{"a": 5, "z": "q"}, {"b": 5, "z": "q"}, {"c": 5, "z": "q"}, {"c": 5, "z": "q"}])
    table = drift.one_table(drift.parse(rows), drift.changes(rows)).collect()
    got = {(r["file_id"], r["written_as"]): r["field"] for r in table}
    assert not any(r["doubtful"] for r in table)
    assert got == {(0, "a"): "a", (1, "b"): "a", (2, "c"): "a", (3, "c"): "a", **{(i, "z"): "z" for i in range(4)}}


def test_flooding_prefers_the_same_value():
    old, new = [("x.gain", "number", "1"), ("x.rate", "number", "2")], [("y.speed", "number", "2"), ("y.gain", "number", "9")]
    scores = drift.flood(old, new)
    assert scores[1, 0] > scores[1, 1] and (1, 0) in [c[:2] for c in drift.correspondences(old, new)]


def test_flooding_follows_a_name_whose_value_changed_too(spark):
    docs = [{"p": {"ordered_step_ids": [1], "gain": 3}, "q": "x"}, {"p": {"orderedStepIds": [1, 2], "gain": 4}, "q": "x"}]
    rows = files(spark, docs)
    changed = drift.changes(rows)
    assert sorted((r["change"], r["field"], r["new_field"]) for r in changed.collect()) == [
        ("added", "p.orderedStepIds", ""),
        ("followed", "p.ordered_step_ids", "p.orderedStepIds"),
        ("removed", "p.ordered_step_ids", ""),
    ]
    got = {r["written_as"]: (r["field"], r["doubtful"]) for r in drift.one_table(drift.parse(rows), changed).where("file_id = 1").collect()}
    assert got == {"p.orderedStepIds": ("p.ordered_step_ids", True), "p.gain": ("p.gain", False), "q": ("q", False)}


def test_a_long_chain_in_a_hot_station(spark):
    rows = files(spark, [{f"n{i}": 7, "z": i} for i in range(300)])
    table = drift.one_table(drift.parse(rows), drift.changes(rows)).where("written_as <> 'z'")
    assert table.count() == 300 and {r["field"] for r in table.collect()} == {"n0"}


def test_empty(spark):
    rows = files(spark, [])
    assert drift.changes(rows).count() == 0 and drift.one_table(drift.parse(rows), drift.changes(rows)).count() == 0

"""Keyed state and ordered events on streams."""

import datetime
import json
import os
import random

from pyspark.sql import functions as F

from paperloom.streaming import cache, progress

SCHEMA = "k string, v long, at timestamp, n long, gone boolean"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in").withColumns({"modified": F.col("at"), "place": F.col("n")})
    cache.run_changes(cache.follow(rows.drop("at", "n"), F.col("k"), F.col("gone")), f"{folder}/changes", f"{folder}/state")
    return {r["cache_key"]: r["v"] for r in cache.read_cache(spark, f"{folder}/state", "v long").collect()}


def test_cache_follows_versions_deletes_and_late_files(spark, tmp_path):
    put(spark, tmp_path / "in", "a", [("x", 1, at(1), 0, False), ("x", 2, at(1), 1, False), (" y ", 3, at(5), 0, None), ("z", 4, at(1), 0, False), (None, 5, at(1), 0, False), (" ", 6, at(1), 0, False)])
    assert run(spark, str(tmp_path)) == {"x": 2, "y": 3, "z": 4}
    put(spark, tmp_path / "in", "b", [("z", None, at(3), 0, True), ("y", 30, at(4), 9, False), ("y", None, None, 0, True)])
    assert run(spark, str(tmp_path)) == {"x": 2, "y": 3}, "a restart goes on, a late row changes nothing, a delete deletes"
    put(spark, tmp_path / "in", "c", [("z", 40, at(2), 0, False), ("x", 2, at(1), 1, False), ("y", 31, at(5), 1, False), ("w", None, at(9), 0, False)])
    assert run(spark, str(tmp_path)) == {"x": 2, "y": 31, "w": None}, "a file older than a delete brings nothing back"
    put(spark, tmp_path / "in", "d", [("z", 41, at(4), 0, False)])
    assert run(spark, str(tmp_path))["z"] == 41
    told = spark.read.schema(cache.CHANGE).parquet(str(tmp_path / "changes"))
    assert sorted((r["cache_key"], r["deleted"]) for r in told.collect()) == [("w", False), ("x", False), ("y", False), ("y", False), ("z", False), ("z", False), ("z", True)]


def test_any_order_of_files_gives_the_batch_answer(spark, tmp_path):
    rows = [(f"k{i % 7}", i, at(i * 37 % 50), i, i % 11 == 0) for i in range(200)]
    for name, part in (("a", rows[150:]), ("b", rows[:90]), ("c", rows[90:150])):
        put(spark, tmp_path / "in", name, part)
    last = {}
    for k, v, t, n, gone in rows:
        last[k] = max(last.get(k, (at(0), -1, 0, True)), (t, n, v, gone))
    assert run(spark, str(tmp_path)) == {k: v for k, (_, _, v, gone) in last.items() if not gone}


def test_no_python_runs_a_key_and_rows_of_one_version_have_an_order(spark, tmp_path):
    put(spark, tmp_path / "in", "a", [("x", 2, at(1), 0, False), ("x", 1, at(1), 0, False), *((f"k{i}", i, at(2), 0, False) for i in range(50))])
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withColumns({"modified": F.col("at"), "place": F.col("n")})
    plan = cache.follow(rows.drop("at", "n"), F.col("k"), F.col("gone"))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan and "TransformWithState" not in plan, "state is an aggregate's; a Python call a key took ms each"
    got = run(spark, str(tmp_path))
    assert got.pop("x") == 2 and got == {f"k{i}": i for i in range(50)}


def test_files_are_versions(spark, tmp_path):
    schema = "k string, v long"
    spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    rows = cache.read_versions(spark, str(tmp_path / "in" / "*"), schema)
    go = lambda: cache.run_changes(cache.follow(rows, F.col("k")), str(tmp_path / "out"), str(tmp_path / "state"))
    go()
    old = tmp_path / "in" / "old"
    spark.createDataFrame([("x", 7), ("q", 8)], schema).coalesce(1).write.parquet(str(old))
    for f in os.listdir(old):
        os.utime(old / f, (1_600_000_000, 1_600_000_000))
    go()
    assert {r["cache_key"]: r["v"] for r in cache.read_cache(spark, str(tmp_path / "state"), "v long").collect()} == {"x": 2, "y": 3, "q": 8}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != cache.PROVIDER


STEPS = "k string, step int, section string, error string, total int"


def stream_events(spark, folder):
    rows = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    progress.write_events(progress.ordered_events(rows, F.col("k")), f"{folder}/events", f"{folder}/state")
    return progress.read_events(spark, f"{folder}/events").orderBy("key", "seq").collect()


def put_steps(spark, folder, name, rows):
    spark.createDataFrame(rows, STEPS).coalesce(1).write.parquet(f"{folder}/in/{name}")


def expected(key, sections, error=None):
    """Events of a key whose steps come one by one; ``error``: step and text."""
    n, out = len(sections), []
    add = lambda *a: out.append(progress.event(key, len(out) + 1, "scoring", *a))
    add("start", 0, n)
    for i, s in enumerate(sections, 1):
        add("begin", i, n, s)
        if error and error[0] == i:
            add("error", i, n, s, error[1])
            add("failed", i, n, s, error[1])
            return out
        add("end", i, n, s)
    add("complete", n, n)
    add("result", n, n)
    return out


def test_events_leave_in_order_and_end_once(spark, tmp_path):
    put_steps(spark, tmp_path, "a", [("m", 3, "C", None, 3), ("m", 2, "B", None, 3), ("bad", 2, "B", "down", 3), (None, 1, "A", None, 1), ("none", 0, None, None, 0), ("m", 9, "X", None, 3)])
    first = stream_events(spark, str(tmp_path))
    assert [(r["key"], r["stage"]) for r in first] == [("bad", "start"), ("m", "start"), ("none", "start"), ("none", "complete"), ("none", "result")]
    put_steps(spark, tmp_path, "b", [("m", 1, "A", None, 3), ("m", 2, "again", None, 3), ("bad", 3, "C", None, 3)])
    put_steps(spark, tmp_path, "c", [("bad", 1, "A", None, 3), ("m", 1, "late", None, 3)])
    got = [{k: v for k, v in r.asDict().items() if k != "batch"} for r in stream_events(spark, str(tmp_path))]
    held = [r for r in got if r["key"] == "m"]
    assert [r["stage"] for r in held] == ["start", "begin", "end", "begin", "end", "begin", "end", "complete", "result"]
    assert [r["section"] for r in held if r["stage"] == "end"] == ["A", "again", "C"], "of a step that comes again in another batch, what came with its turn counts"
    assert [r for r in got if r["key"] == "bad"] == expected("bad", ["A", "B", "C"], (2, "down"))
    for key in ("m", "bad", "none"):
        mine = [r for r in got if r["key"] == key]
        assert [r["seq"] for r in mine] == list(range(1, len(mine) + 1)) and sum(r["type"] != "progress" for r in mine) == 1


def test_a_replayed_batch_writes_no_event_twice(spark, tmp_path):
    put_steps(spark, tmp_path, "a", [("m", 1, "A", None, 2), ("m", 2, "B", None, 2)])
    before = stream_events(spark, str(tmp_path))
    assert [{k: v for k, v in r.asDict().items() if k != "batch"} for r in before] == expected("m", ["A", "B"])
    # the query dies after the sink's commit and before its own: the batch runs again
    commits = tmp_path / "state" / "commits"
    for name in os.listdir(commits):
        if name.strip(".").startswith("0"):
            os.remove(commits / name)
    assert stream_events(spark, str(tmp_path)) == before
    assert len(os.listdir(tmp_path / "events" / progress.PARTS)) == 1, "the files of the second run are gone"


def test_a_batch_killed_between_the_phases_leaves_nothing_to_read(spark, tmp_path):
    row = lambda seq: spark.createDataFrame([tuple(progress.event("m", seq, "scoring", "start", 0, 2).values())], progress.EVENT).first()
    sink = progress.EventWriter(str(tmp_path), [])
    lost = sink.write(iter([row(1)]))  # the task ran, the driver died
    sink.commit([sink.write(iter([row(2), row(1)])), sink.write(iter([])), None], 0)
    assert [r["seq"] for r in progress.read_events(spark, str(tmp_path)).orderBy("seq").collect()] == [1, 2]
    again = sink.write(iter([row(1)]))
    sink.commit([again], 0)
    sink.abort([sink.write(iter([row(5)]))], 1)
    sink.commit([sink.write(iter([row(3)]))], 1)
    assert [(r["batch"], r["seq"]) for r in progress.read_events(spark, str(tmp_path)).orderBy("seq").collect()] == [(0, 1), (0, 2), (1, 3)]
    assert lost.name in os.listdir(tmp_path / progress.PARTS) and again.name not in os.listdir(tmp_path / progress.PARTS)


def test_state_travels_with_the_rows_and_texts_stay_whole(spark, tmp_path):
    """A state call a key and step took ms each; now state comes and goes with the rows, and texts come through as they are."""
    odd = ['a "b" \\ c', "line\nline\t\x01", "\u00e9\u4e2d\U0001f600", "", None, "null", "[1]"]
    keys = {f"k {i} \"{odd[i % 7]}\"": (odd[i % 7 :] + odd[: i % 7], (i % 9, odd[i % 3]) if i % 9 in range(1, 8) else None) for i in range(60)}
    rows = [(k, i, x, bad[1] if bad and bad[0] == i else None, 7) for k, (sections, bad) in keys.items() for i, x in enumerate(sections, 1)]
    random.Random(3).shuffle(rows)
    for n in range(4):
        put_steps(spark, tmp_path, f"f{n}", rows[n::4])
    stream = spark.readStream.schema(STEPS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    plan = progress.ordered_events(stream, F.col("k"))._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
    got = [{k: v for k, v in r.asDict().items() if k != "batch"} for r in stream_events(spark, str(tmp_path))]
    want = [e for k in sorted(keys) for e in expected(k, *keys[k])]
    assert sorted(got, key=lambda r: (r["key"], r["seq"])) == want


def test_only_what_is_ahead_is_held():
    first = progress._in_order("m", {1: ("A", None), 3: ("C", None), 5: ("E", "down")}, 5, (0, 0, False, None), "scoring")
    assert [e["stage"] for e in first[0]] == ["start", "begin", "end"] and first[1][:3] == (2, 3, False)
    assert sorted(json.loads(first[1][3])) == ["3", "5"]
    out, held = progress._in_order("m", {3: ("again", None), 2: ("B", None), 5: ("late", None)}, 5, first[1], "scoring")
    assert [e["section"] for e in out if e["stage"] == "end"] == ["B", "again"] and json.loads(held[3]) == {"5": ["E", "down"]}
    out, held = progress._in_order("m", {4: ("D", None)}, 5, held, "scoring")
    assert [e["stage"] for e in out] == ["begin", "end", "begin", "error", "failed"] and held[2:] == (True, None), "an ended key holds nothing"

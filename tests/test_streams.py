"""Streams over several files, with restarts and repeats, against plain folds in Python."""

import random

import pytest
from pyspark.sql import functions as F

from ferrolith.streaming import jobs, sessions

SELECTING = "event_id long, ts timestamp, session long, action string, ids array<long>, item string, weight double"
BEGIN = 1_700_000_000


def selecting(n, seed=1, sessions_=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        action = "clear" if rng.random() < 0.05 else "toggle"
        ids = [rng.randrange(6) for _ in range(rng.randrange(4))] if rng.random() < 0.95 else None
        rows.append((i, BEGIN + 60 * i, rng.randrange(sessions_), action, ids, rng.choice([None, "a", "b"]), rng.choice([None, 1.5, float(i)])))
    return rows


def fold(rows):
    ids, items = {}, {}
    for _, _, s, action, raw, item, weight in sorted(rows, key=lambda r: r[0]):
        chosen, held = ids.setdefault(s, set()), items.setdefault(s, {})
        raw = set(raw or ())
        if action == "clear":
            chosen.clear(), held.clear()
        elif raw and (item in held or raw <= chosen):
            chosen -= raw | held.get(item, (None, set()))[1]
            held.pop(item, None)
        elif raw:
            chosen |= raw
            if item:
                held[item] = (weight, raw)
    return {(s, "id", str(i), None) for s in ids for i in ids[s]} | {(s, "item", k, w) for s in items for k, (w, _) in items[s].items()}


def put(spark, folder, name, rows):
    df = spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], SELECTING)
    df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60 + BEGIN)).coalesce(1).write.mode("append").parquet(str(folder / name))


def stream(spark, folder):
    return spark.readStream.schema(SELECTING).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_selection_stream_goes_on_after_a_restart_and_ignores_repeats(spark, tmp_path):
    rows, folder, base = selecting(120), tmp_path / "in", jobs.new_base(spark, "t")
    put(spark, folder, "a", rows[:40])
    first = jobs.run_to_table(sessions.changes_of(stream(spark, folder), sessions.Selection()), "append", "t", base)
    assert set(map(tuple, sessions.latest(first).collect())) == fold(rows[:40])
    put(spark, folder, "b", rows[40:90])
    put(spark, folder, "c", rows[70:90])  # delivered twice
    put(spark, folder, "d", rows[90:])
    rest = jobs.run_to_table(sessions.changes_of(stream(spark, folder), sessions.Selection()), "append", "t", base)
    assert set(map(tuple, sessions.latest(rest).collect())) == fold(rows)


def test_idle_sessions_end_and_leave_no_state(spark, tmp_path):
    rows = [(i, 0, 1, "toggle", [i], None, None) for i in range(3)] + [(100 + i, 0, 2, "toggle", [7 + i], f"w{i}", 2.0) for i in range(2)]
    put(spark, tmp_path / "in", "a", rows)
    timed = stream(spark, tmp_path / "in").withWatermark("ts", "1 minute")
    base = jobs.new_base(spark, "t")
    held = sessions.latest(jobs.run_to_table(sessions.changes_of(timed, sessions.Selection(idle_ms=30 * 60_000)), "append", "t", base))
    assert set(map(tuple, held.collect())) == {(2, "id", "7", None), (2, "id", "8", None), (2, "item", "w0", 2.0), (2, "item", "w1", 2.0)}
    state = spark.read.format("state-metadata").load(f"{base}/checkpoint").collect()
    assert any("transformWithState" in str(r) for r in state)


def test_toggles_and_reveals_over_several_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, 0, rng.randrange(3), rng.choice(["tab", "exit", "group", "group", "group", "group"]), [rng.randrange(4) for _ in range(rng.randrange(3))], rng.choice("pq"), None) for i in range(150)]
    for k in range(3):
        put(spark, tmp_path / "in", f"f{k}", rows[50 * k : 50 * k + 50])
    events = stream(spark, tmp_path / "in").withColumnRenamed("item", "tab")
    got = sessions.latest(jobs.run_to_table(sessions.changes_of(events, sessions.Reveal()), "append", "t"))
    batch = sessions.revealed(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumnRenamed("item", "tab")).collect()
    want = {(r["session"], "part", str(i)) for r in batch for i in r["parts"]} | {(r["session"], "tab", r["tab"]) for r in batch if r["tab"]}
    assert {tuple(r)[:3] for r in got.collect()} == want and want

    named = stream(spark, tmp_path / "in").withColumn("action", F.when(F.col("action") == "exit", "reset").otherwise("toggle")).withColumn("key", F.coalesce("item", F.lit("-")))
    got = sessions.latest(jobs.run_to_table(sessions.changes_of(named, sessions.Toggles()), "append", "t"))
    counts = {}
    for i, _, s, action, _, item, _ in rows:
        if action == "exit":
            counts = {k: v for k, v in counts.items() if k[0] != s}
        else:
            counts[s, item] = counts.get((s, item), 0) + 1
    assert {(r["session"], r["key"], r["value"]) for r in got.collect()} == {(s, k, float(n)) for (s, k), n in counts.items() if n % 2}


def test_state_ends_one_way():
    with pytest.raises(ValueError):
        sessions.Selection(idle_ms=1, ttl_ms=1)


def test_upsert_keeps_the_latest_row_and_repeats_change_nothing(spark, tmp_path):
    rng = random.Random(5)
    schema, folder, base = "id long, version long, name string", str(tmp_path / "in"), jobs.new_base(spark, "t")
    rows = [(rng.randrange(30), v, f"n{v}") for v in range(200)]
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    want, tables = {}, []
    for part in (rows[:80], rows[80:120], rows[:30] + rows[100:120], rows[120:]):  # old and repeated rows come again
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for i, v, name in part:
            want[i] = max(want.get(i, (-1, "")), (v, name))
        tables.append({r["id"]: (r["version"], r["name"]) for r in jobs.upserted(read(), "id", "version", base, buckets=4).collect()})
        assert tables[-1] == want
    assert jobs.manifest(spark, base).keys() == {0, 1, 2, 3}
    # a manifest that was not finished does not count
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest/batch=99/part")
    half.getFileSystem(spark._jsc.hadoopConfiguration()).create(half).close()
    assert all("version=99" not in p for p in jobs.manifest(spark, base).values())

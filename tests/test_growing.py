"""Streams with late rows and restarts, sketches, functions in SQL, the keyed store and the logs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadenza.functions import tables as sql_tables
from cadenza.operators import sketches
from cadenza.sources import store
from cadenza.sources.shared import SharedTables
from cadenza.streaming import joins

T0 = datetime(2024, 1, 1)
NOTES, FRAMES = "song_id string, note_idx long, pitch int, on_at timestamp, off_at timestamp", "song_id string, frame_idx long, at timestamp"


def sec(s):
    return T0 + timedelta(seconds=s)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def go(out, tmp_path, name):
    """Reads what there is and stops; the next call goes on from the checkpoint."""
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert q.exception() is None and not q.isActive
    return sorted(map(tuple, out.sparkSession.read.schema(out.schema).parquet(f"{tmp_path}/{name}").collect()))


def test_streamed_joins_with_late_rows_and_a_restart(spark, tmp_path):
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    put(spark, tmp_path / "n", [("a", 0, 60, sec(1), sec(2)), ("a", 1, 61, sec(5), sec(6)), ("b", 0, 60, sec(1), sec(9))], NOTES)
    put(spark, tmp_path / "f", [("a", 0, sec(1)), ("a", 1, sec(2)), ("a", 2, sec(2.5)), ("b", 0, sec(3)), ("b", 1, sec(5))], FRAMES)
    met = lambda: joins.streamed_range_join(stream("f", FRAMES), stream("n", NOTES), ["song_id"], "at", "on_at", "off_at", "3 SECONDS").select("song_id", "frame_idx", "note_idx")
    unseen = lambda: joins.streamed_unseen(stream("n", NOTES), stream("f", FRAMES), ["song_id"], "on_at", "at", "0.5 SECONDS").select("song_id", "note_idx")
    first = [("a", 0, 0), ("a", 1, 0), ("b", 0, 0)]  # b's frame at 5 s is more than 3 s after its note's start
    assert go(met(), tmp_path, "met") == first and go(unseen(), tmp_path, "unseen") == []
    # the watermarks move on; a late frame is still in time for note 1, another comes after its note has left
    put(spark, tmp_path / "n", [("a", 2, 62, sec(14), sec(15))], NOTES)
    put(spark, tmp_path / "f", [("a", 3, sec(5.2)), ("a", 4, sec(14))], FRAMES)
    assert go(met(), tmp_path, "met") == sorted([*first, ("a", 3, 1), ("a", 4, 2)])
    put(spark, tmp_path / "n", [("c", 0, 60, sec(100), sec(101))], NOTES)
    put(spark, tmp_path / "f", [("c", 0, sec(100))], FRAMES)
    go(met(), tmp_path, "met"), go(unseen(), tmp_path, "unseen")
    put(spark, tmp_path / "f", [("a", 9, sec(1.5)), ("c", 1, sec(100.5))], FRAMES)
    assert go(met(), tmp_path, "met") == sorted([*first, ("a", 3, 1), ("a", 4, 2), ("c", 0, 0), ("c", 1, 0)])
    assert go(unseen(), tmp_path, "unseen") == [("b", 0)]  # its frames were two seconds away


def test_unseen_notes_come_once_nothing_can_see_them(spark, tmp_path):
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    put(spark, tmp_path / "n", [("a", 0, 60, sec(1), sec(2)), ("a", 1, 61, sec(5), sec(6)), ("z", 9, 1, sec(900), sec(901))], NOTES)
    put(spark, tmp_path / "f", [("a", 0, sec(1.2)), ("a", 1, sec(5.9)), ("z", 9, sec(900))], FRAMES)
    out = joins.streamed_unseen(stream("n", NOTES), stream("f", FRAMES), ["song_id"], "on_at", "at", "0.5 SECONDS").select("song_id", "note_idx")
    assert go(out, tmp_path, "unseen") == [("a", 1)]


def test_open_notes_expire(spark, tmp_path):
    schema = "song_id string, pitch int, at timestamp, is_on boolean"
    put(spark, tmp_path / "e", [("a", 60, sec(0), True), ("a", 60, sec(1), True), ("a", 60, sec(2), False), ("a", 61, sec(1), False), ("a", 62, sec(1), True)], schema)
    out = joins.streamed_notes(spark.readStream.schema(schema).parquet(f"{tmp_path}/e"), longest=5.0, late="1 second")
    assert go(out, tmp_path, "notes") == [("a", 60, sec(0), sec(2), False)]
    put(spark, tmp_path / "e", [("a", 60, sec(4), False), ("b", 60, sec(60), True)], schema)
    assert go(out, tmp_path, "notes") == [("a", 60, sec(0), sec(2), False), ("a", 60, sec(1), sec(4), False), ("a", 62, sec(1), sec(6), True)]


def test_sketches_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i % 7, rng.gauss(0, 1), f"u{min(rng.randrange(3000), rng.randrange(3000))}") for i in range(30_000)] + [("a", 0, None, None), (None, 1, 1.0, "x")]
    d = spark.createDataFrame(rows, "g string, day int, v double, item string").repartition(5)
    fine = sketches.sketched(d, ["g", "day"], F.col("v"), F.col("item"))
    told = {r.g: r for r in sketches.estimates(sketches.rolled_up(fine, ["g"]), (0.1, 0.9), 3).collect()}
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        values, items = sorted(r[2] for r in own if r[2] is not None), {r[3] for r in own if r[3]}
        assert told[g].n == len(own)
        assert abs(told[g].n_distinct - len(items)) <= max(1, sketches.distinct_error() * len(items))
        for q, v in zip((0.1, 0.9), told[g].quantiles, strict=True):
            assert abs(sum(x <= v for x in values) / len(values) - q) <= sketches.rank_error() + 1 / len(values)
    whole = sketches.estimates(sketches.rolled_up(fine, [])).first()
    assert whole.n == len(rows) and len(whole.frequent) == 5


def test_table_function(spark):
    sql_tables.register(spark)
    spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.4), ("a", 3, 1.5), ("b", 1, None), (None, 7, 2.0)], "k string, i int, t double").createOrReplaceTempView("stretch_rows")
    got = spark.sql("SELECT * FROM stretches(TABLE(stretch_rows) PARTITION BY k ORDER BY (t), 't', 0.5)")
    assert got.columns == ["k", "i", "first", "last", "n"]
    assert sorted(map(str, map(tuple, got.collect()))) == ["('a', 1, 0.0, 0.4, 2)", "('a', 3, 1.5, 1.5, 1)", "(None, 7, 2.0, 2.0, 1)"]
    for bad in ("'nothing', 0.5", "'t', -1.0", "k, 0.5"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT * FROM stretches(TABLE(stretch_rows), {bad})").collect()
    assert spark.sql("SELECT median_deviation(i) AS d FROM stretch_rows").first().d == 1.0


def test_store(spark, tmp_path):
    schema = spark.createDataFrame([], "key string, v int, at int").schema
    s = store.KeyedStore(spark, f"{tmp_path}/s", schema, buckets=3)
    assert s.read().count() == 0
    s.upsert(spark.createDataFrame([(f"k{i}", i, 0) for i in range(20)] + [(None, 1, 1)], schema))
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "s").glob("_bucket=*")}
    s.upsert(spark.createDataFrame([("k3", 100, 1), ("k3", 200, 2)], schema), ["at"])
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "s").glob("_bucket=*")}
    assert sum(before[b] != after[b] for b in before) == 1  # the other buckets' files stay
    assert {r.key: r.v for r in s.read().collect()} == {f"k{i}": i for i in range(20)} | {"k3": 200}
    s.upsert(spark.createDataFrame([], schema))
    assert s.read().count() == 20


def test_streams_feed_store_and_log(spark, tmp_path):
    schema = spark.createDataFrame([], "key string, v int, at int").schema
    s, log = store.KeyedStore(spark, f"{tmp_path}/s", schema), store.Log(spark, f"{tmp_path}/log", schema)
    for batch in ([("a", 1, 1), ("b", 2, 1)], [("a", 3, 2)]):
        put(spark, tmp_path / "in", batch, schema)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        for w in (s.follow(stream, f"{tmp_path}/cp1", ["at"]), log.follow(stream, f"{tmp_path}/cp2")):
            q = w.trigger(availableNow=True).start()
            q.awaitTermination(100)
            assert q.exception() is None
    assert {r.key: r.v for r in s.read().collect()} == {"a": 3, "b": 2}
    assert sorted(map(tuple, log.read().collect())) == [("a", 1, 1), ("a", 3, 2), ("b", 2, 1)]
    log.append(spark.createDataFrame([("c", 1, 1)], schema))
    assert log.read().count() == 4


def test_picks_and_runs(spark):
    picks = spark.createDataFrame([("v1", {"LH_white": [1, 2, 3], "RH_white": [4, 5, 6], "RH_black": [7, 8, 9]}), ("v2", {}), ("v3", None)], "video string, picked map<string,array<int>>")
    got = {r.video: r for r in store.logged_picks(picks, F.lit("now")).collect()}
    assert got["v1"].assumed == {"LH_black": [1, 2, 3]} and got["v1"].picked == got["v1"].user_picked | got["v1"].assumed
    assert got["v2"].assumed == {} == got["v3"].assumed and got["v3"].user_picked == {}
    runs = spark.createDataFrame([("https://x", "o/a.json", None, "o/a.zip"), ("file.mp4", "b.json", "t.mid", None)], "video string, out_path string, transcript_path string, bundle_path string")
    assert [tuple(r) for r in store.run_lines(runs).collect()] == [("https://x", ["a.zip", "a.json"])]


def test_counters(spark):
    tables = SharedTables(spark, "t")
    out, n = store.counted(lambda: spark.range(10).withColumn("odd", F.col("id") % 2 == 1), tables, "x", rows=F.count("*"), odd=F.count_if("odd"))
    assert out.count() == 10 and n == {"rows": 10, "odd": 5}

"""Performance-shaped tables made from the star schema's ``events``: notes, frames, points, pedal and colour samples.

The sample data has no music, so each event also stands for a note and for a frame. Users are songs, four at a time; a
month is squeezed to about a minute, which gives a few notes a second. All values are exact functions of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, note_idx, onset_tick, pitch, start_sec, duration_sec, velocity, channel, hand, finger, confidence,
    distance, pick_rank, wi (white index)."""
    from ..functions.music import white_index

    e = events(spark, sf_dir)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    e = e.withColumn("us", micros)
    e = e.withColumn("start_us", F.expr("us DIV 40000")).withColumn("song_id", F.concat(F.lit("s"), F.expr("user_id DIV 4").cast("string")))
    e = e.withColumn("note_idx", (F.row_number().over(Window.partitionBy("song_id").orderBy("start_us", "event_id")) - 1).cast("long"))
    return e.select(
        "song_id", "note_idx", "event_id", F.expr("start_us * 960 DIV 1000000").alias("onset_tick"), (36 + (F.col("event_id") * 11) % 49).cast("int").alias("pitch"),
        (F.col("start_us") / F.lit(1e6)).alias("start_sec"), ((1 + F.col("event_id") % 13) / F.lit(10.0)).alias("duration_sec"), (1 + (F.col("event_id") * 13) % 127).cast("int").alias("velocity"),
        F.lit(0).alias("channel"), F.when(F.col("event_type").isin("click", "view"), "L").otherwise("R").alias("hand"), (F.col("event_id") % 7).cast("int").alias("finger"),
        (((F.col("event_id") * 29) % 101) / F.lit(100.0)).alias("confidence"), (((F.col("event_id") * 17) % 80) / F.lit(20.0)).alias("distance"), F.col("note_idx").alias("pick_rank"),
        white_index(36 + (F.col("event_id") * 11) % 49).alias("wi"), "value", "event_type", "user_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, frame_idx, time_sec: a frame for each event; those whose id is a multiple of five have no points."""
    return notes(spark, sf_dir).select("song_id", F.col("note_idx").alias("frame_idx"), F.col("start_sec").alias("time_sec"), "event_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, frame_idx, time_sec, hand, finger (0 wrist, 2, 6 palm), x, y, wi."""
    f = frames(spark, sf_dir).where("event_id % 5 <> 0")
    hands = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("L"), F.lit("R"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("L"))).otherwise(F.array(F.lit("R")))
    f = f.withColumn("hand", F.explode(hands)).withColumn("finger", F.explode(F.array(F.lit(0), F.lit(2), F.lit(6))))
    wi = F.when(F.col("hand") == "L", 21 + ((F.col("event_id") * 11 + F.col("finger")) % 140) / F.lit(10.0)).otherwise(35 + ((F.col("event_id") * 13 + F.col("finger")) % 140) / F.lit(10.0))
    return f.select("song_id", "frame_idx", "time_sec", "hand", "finger", (wi * 20).alias("x"), ((F.col("event_id") * 19 + F.col("finger")) % 50).cast("double").alias("y"), wi.alias("wi"))


def pedal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, time_sec, value (0 to 127), event_id: controller changes."""
    n = notes(spark, sf_dir)
    return n.select("song_id", F.col("start_sec").alias("time_sec"), ((F.col("event_id") * 31) % 128).cast("int").alias("value"), "event_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, note_idx, time_sec, r, g, b: six colour samples from each note's onset on."""
    n = notes(spark, sf_dir).select("song_id", "note_idx", "start_sec", "event_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    shade = lambda m: ((F.col("event_id") * m + F.col("i") * 53) % 256).cast("double")
    return n.select("song_id", "note_idx", (F.col("start_sec") + F.col("i") / F.lit(10.0)).alias("time_sec"), shade(3).alias("r"), shade(5).alias("g"), shade(7).alias("b"), "start_sec")


#: The same tables in SQL, as the oracles' first common table expressions.
SQL = {
    "notes": """notes AS (SELECT 's' || (user_id // 4)::VARCHAR AS song_id, row_number() OVER (PARTITION BY user_id // 4 ORDER BY (epoch_us(ts) - 1704067200000000) // 40000, event_id) - 1 AS note_idx, event_id,
        ((epoch_us(ts) - 1704067200000000) // 40000) * 960 // 1000000 AS onset_tick, (36 + event_id * 11 % 49)::INTEGER AS pitch, ((epoch_us(ts) - 1704067200000000) // 40000)::DOUBLE / 1e6 AS start_sec,
        (1 + event_id % 13)::DOUBLE / 1e1 AS duration_sec, (1 + event_id * 13 % 127)::INTEGER AS velocity, 0 AS channel, CASE WHEN event_type IN ('click', 'view') THEN 'L' ELSE 'R' END AS hand, (event_id % 7)::INTEGER AS finger,
        (event_id * 29 % 101)::DOUBLE / 1e2 AS confidence, (event_id * 17 % 80)::DOUBLE / 2e1 AS distance, value, event_type, user_id,
        [0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6][(36 + event_id * 11 % 49) % 12 + 1]::DOUBLE + 7 * ((36 + event_id * 11 % 49) // 12) + CASE WHEN (36 + event_id * 11 % 49) % 12 IN (1, 3, 6, 8, 10) THEN 7e-1 ELSE 0e0 END AS wi FROM events)""",
    "frames": "frames AS (SELECT song_id, note_idx AS frame_idx, start_sec AS time_sec, event_id FROM notes)",
    "points": """points AS (SELECT song_id, frame_idx, time_sec, hand, finger, wi * 2e1 AS x, ((event_id * 19 + finger) % 50)::DOUBLE AS y, wi FROM (
        SELECT f.*, h.hand, g.finger, CASE WHEN h.hand = 'L' THEN 21 + ((event_id * 11 + finger) % 140)::DOUBLE / 1e1 ELSE 35 + ((event_id * 13 + finger) % 140)::DOUBLE / 1e1 END AS wi
        FROM frames f, (VALUES ('L'), ('R')) h(hand), (VALUES (0), (2), (6)) g(finger)
        WHERE event_id % 5 <> 0 AND (event_id % 3 = 0 OR (event_id % 3 = 1 AND h.hand = 'L') OR (event_id % 3 = 2 AND h.hand = 'R'))))""",
    "pedals": "pedals AS (SELECT song_id, start_sec AS time_sec, (event_id * 31 % 128)::INTEGER AS value, event_id FROM notes)",
    "samples": """samples AS (SELECT song_id, note_idx, start_sec + i::DOUBLE / 1e1 AS time_sec, ((event_id * 3 + i * 53) % 256)::DOUBLE AS r, ((event_id * 5 + i * 53) % 256)::DOUBLE AS g, ((event_id * 7 + i * 53) % 256)::DOUBLE AS b, start_sec
        FROM notes, (SELECT unnest(range(6)) AS i))""",
}


def with_tables(*names: str) -> str:
    """WITH and the named tables, to be followed by further expressions or the query."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)

"""Registered queries for Spark's own facilities: sliding and session windows, subqueries, dates, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registered
from ..streaming.windows import streamed_means, streamed_sessions
from . import analogue as A
from .catalogue import query, read


def _seconds(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


@query("""WITH e AS (SELECT event_type, value, epoch_us(ts) // 7200000000 AS slot FROM events),
    w AS (SELECT event_type, value, (slot - k) * 7200000000 AS window_us FROM e, (SELECT unnest([0, 1, 2]) AS k))
    SELECT window_us, event_type, avg(value) AS mean, count(value) AS n FROM w GROUP BY ALL""")
def sliding_means(spark, d):
    """Mean value per type of event over six hours, every two hours."""
    w = streamed_means(A.events(spark, d), ["event_type"], "ts", "value", "6 hours", slide="2 hours")
    return w.select(_seconds("window_start").alias("window_us"), "event_type", "mean", "n")


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 14400000000 AS end_us, avg(value) AS mean, count(value) AS n FROM s GROUP BY user_id, nth""")
def sessions(spark, d):
    """Users' sessions, which end after four hours without an event."""
    s = streamed_sessions(A.events(spark, d), ["user_id"], "ts", "value", "4 hours")
    return s.select("user_id", _seconds("session_start").alias("start_us"), _seconds("session_end").alias("end_us"), "mean", "n")


_SUBQUERIES = """SELECT o_orderkey, o_totalprice, (SELECT max(l_extendedprice) FROM {lineitem} WHERE l_orderkey = o_orderkey) AS dearest
    FROM {orders} AS o WHERE o_totalprice > (SELECT avg(p.o_totalprice) FROM {orders} AS p WHERE p.o_custkey = o.o_custkey)"""


@query(_SUBQUERIES.format(lineitem="lineitem", orders="orders"))
def correlated_subqueries(spark, d):
    """Orders above their customer's mean, with the dearest line of each; the optimiser turns both into joins."""
    return spark.sql(_SUBQUERIES, lineitem=read(spark, d, "lineitem"), orders=read(spark, d, "orders"))


@query("""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total,
    max(date_diff('day', o_orderdate::DATE, last_day(o_orderdate)))::BIGINT AS most_days_left, count(*) FILTER (o_orderdate + INTERVAL 1 MONTH < last_day(o_orderdate) + INTERVAL 15 DAYS) AS early
    FROM orders GROUP BY ALL""")
def dates_and_decimals(spark, d):
    """Orders by month: exact totals, days left, and those whose next month's day comes before its fifteenth."""
    day, end = F.col("o_orderdate").cast("timestamp_ntz"), F.last_day("o_orderdate")
    early = day + F.expr("INTERVAL 1 MONTH") < end.cast("timestamp_ntz") + F.expr("INTERVAL 15 DAYS")
    return read(spark, d, "orders").groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        F.max(F.datediff(end, day.cast("date"))).cast("long").alias("most_days_left"), F.count_if(early).alias("early"))


@query("""WITH k AS (SELECT range::INTEGER AS pitch, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][range % 12 + 1] || (range // 12 - 1)::VARCHAR AS name FROM range(21, 109))
    SELECT k.pitch, k.name, k.pitch % 12 IN (1, 3, 6, 8, 10) AS black, count(p_partkey) AS n FROM k LEFT JOIN part ON p_partkey % 128 = k.pitch GROUP BY ALL""")
def sql_functions(spark, d):
    """A piano's keys and how many parts' numbers lead to each, by functions registered for SQL."""
    registered.register(spark)
    return spark.sql("""SELECT k.pitch, k.name, is_black_key(k.pitch) AS black, count(p_partkey) AS n
        FROM keys_between(21, 108) AS k LEFT JOIN {part} ON note_name(CAST(p_partkey % 128 AS INT)) = k.name GROUP BY k.pitch, k.name""", part=read(spark, d, "part"))

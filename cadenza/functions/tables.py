"""Functions for SQL that need Python: a table function over ordered partitions and an aggregate over Arrow batches.

    register(spark)
    SELECT * FROM stretches(TABLE(SELECT song_id, start_sec FROM notes) PARTITION BY song_id ORDER BY (start_sec), 'start_sec', 0.5)
    SELECT song_id, median_deviation(pitch) FROM notes GROUP BY song_id
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Stretches:
    """Stretches of rows without a gap above a limit: the columns of the table that aren't the time (as the stretch's first
    row has them), then first, last, n. Rows come in the order that the call asks for; those without a time don't count.

    The result's columns follow from the table that is passed: that is what ``analyze`` says before anything runs.
    """

    def __init__(self) -> None:
        self.first = self.last = None
        self.n, self.head = 0, ()

    @staticmethod
    def analyze(rows: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("stretches takes a TABLE first")
        if not at.isConstantExpression or at.value not in rows.dataType.names:
            raise ValueError("the second argument names the table's time column")
        if not gap.isConstantExpression or gap.value is None or gap.value < 0:
            raise ValueError("the third argument is the widest gap inside a stretch")
        own = [StructField("first", DoubleType()), StructField("last", DoubleType()), StructField("n", LongType())]
        return AnalyzeResult(schema=StructType([f for f in rows.dataType.fields if f.name != at.value] + own))

    def eval(self, rows, at, gap):
        t = rows[at]
        if t is None:
            return
        t = float(t)
        if self.n and t - self.last > float(gap):
            yield (*self.head, self.first, self.last, self.n)
            self.n = 0
        if not self.n:
            self.first, self.head = t, tuple(v for k, v in rows.asDict().items() if k != at)
        self.last, self.n = t, self.n + 1

    def terminate(self):
        if self.n:
            yield (*self.head, self.first, self.last, self.n)


def _median_deviation(values: pd.Series) -> float:
    return float((values - values.median()).abs().median())


def register(spark: SparkSession) -> None:
    """Make stretches and median_deviation known to the session's SQL."""
    spark.udtf.register("stretches", F.udtf(Stretches))
    spark.udf.register("median_deviation", F.pandas_udf(_median_deviation, "double"))

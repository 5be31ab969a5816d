"""A keyed store of settings and an appended log, both fed by tables or by streams."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import SharedTables


class KeyedStore:
    """Rows by key in a folder, dealt to ``buckets`` by the key's hash. An upsert reads and rewrites only the buckets that
    its keys fall into; Spark's dynamic partition overwrite swaps them in when the job commits. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "key", buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def read(self) -> DataFrame:
        """All rows; none where nothing was stored."""
        return self._stored().select(*self.schema.names)

    def _stored(self) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jvm.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)

    def upsert(self, fresh: DataFrame, order: list[str] | None = None) -> None:
        """Put ``fresh`` in place of the rows of the same keys. Of rows that share a key the last by ``order`` counts (any
        one, if not told); rows without a key are left out."""
        fresh = fresh.where(F.col(self.key).isNotNull())
        last = F.row_number().over(Window.partitionBy(self.key).orderBy(*(F.desc(c) for c in order or [self.key])))
        fresh = fresh.withColumn("_n", last).where("_n = 1").select(*self.schema.names).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        tables = SharedTables(self.spark, "upsert")
        fresh = tables.write(fresh, "fresh")
        touched = fresh.select("_bucket").distinct()
        old = self._stored().join(touched, "_bucket", "left_semi").join(fresh.select(self.key), self.key, "left_anti").select(*fresh.columns)
        merged = tables.write(old.unionByName(fresh), "merged")  # read no more from what is overwritten
        merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        tables.clear()

    def follow(self, fresh: DataFrame, checkpoint: str, order: list[str] | None = None):
        """A stream's writer that upserts each batch; a batch that comes again changes nothing."""
        return fresh.writeStream.foreachBatch(lambda batch, _: self.upsert(batch, order)).option("checkpointLocation", checkpoint)


class Log:
    """Rows appended to a folder of JSON lines, never changed. Each append, and each batch of a stream, has a folder of its
    own below, so a batch that comes again takes its own place."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, rows: DataFrame, name: str | None = None) -> None:
        """Add rows under a name of their own; rows under a name that is there already are replaced."""
        rows.select(*self.schema.names).write.mode("overwrite").json(f"{self.path}/{name or uuid.uuid4().hex}")

    def follow(self, rows: DataFrame, checkpoint: str):
        """A stream's writer; the checkpoint's name tells streams apart."""
        stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
        return rows.writeStream.foreachBatch(lambda batch, n: self.append(batch, f"{stream}-{n}")).option("checkpointLocation", checkpoint)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).json(self.path)


#: What a colour pick leaves in its log: what was picked and what was assumed for it.
PICKS = "timestamp string, video string, user_picked map<string,array<int>>, assumed map<string,array<int>>"


def logged_picks(picks: DataFrame, stamp) -> DataFrame:
    """Picks (video, picked map) with a hand's white-key colour for its missing black-key colour: PICKS and ``picked``,
    the picked and assumed colours together."""
    missing = lambda hand: F.map_contains_key("picked", f"{hand}_white") & ~F.map_contains_key("picked", f"{hand}_black")
    entry = lambda hand: F.when(missing(hand), F.create_map(F.lit(f"{hand}_black"), F.element_at("picked", f"{hand}_white"))).otherwise(F.create_map().cast("map<string,array<int>>"))
    assumed = F.map_concat(entry("LH"), entry("RH"))
    p = picks.withColumn("_picked", F.coalesce("picked", F.create_map().cast("map<string,array<int>>"))).withColumn("picked", F.col("_picked"))
    return p.select(stamp.alias("timestamp"), "video", F.col("_picked").alias("user_picked"), assumed.alias("assumed"), F.map_concat("_picked", assumed).alias("picked"))


def run_lines(runs: DataFrame) -> DataFrame:
    """What a finished run of an address leaves in the log: video, files (names of bundle, transcript, result, those there
    are). Runs of local files leave nothing."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = F.filter(F.array(name("bundle_path"), name("transcript_path"), name("out_path")), lambda f: f.isNotNull())
    return runs.where(F.col("video").rlike("^https?://")).select("video", files.alias("files"))


def counted(build: Callable[[], DataFrame], tables: SharedTables, name: str, **counters) -> tuple[DataFrame, dict[str, int]]:
    """A table that is written and, from the same job, its counters (aggregates by name)."""
    from pyspark.sql import Observation

    seen = Observation()
    out = tables.write(build().observe(seen, *(c.alias(n) for n, c in counters.items())), name)
    return out, seen.get

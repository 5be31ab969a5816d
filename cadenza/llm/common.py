"""What the training-data operators share: tables, shared scratch space, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch: texts and blocks of keys may be long, so batches stay short.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(size: str) -> int:
    """A Spark size setting in bytes."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)(?:i?b)?\s*", size.lower())
    return int(m[1]) << 10 * "bkmgtp".index(m[2] or "b") if m else BATCH_BYTES + 1


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch sizes (never raise them), which bounds a Python worker's memory.

    They stay lowered: the frames that need them are lazy and may run at any later time.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key, "256MB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where the session names none, a local session gets a temporary one and any
    other is refused, since its executors couldn't read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Tables of one query in the shared folder; they cut lineage, so a lost executor costs a reread.

    ``write`` stores a frame and reads it back, ``drop`` deletes it, and what is left goes when the
    session's Python process ends (the returned frame is lazy and may still read it until then).
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cadenza-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def counted(self, df: DataFrame, name: str, *aggregates: Column) -> tuple[DataFrame, dict]:
        """``write``, and aggregates of the table that the same job takes."""
        seen = Observation()
        kept = self.write(df.observe(seen, *aggregates), name)
        return kept, seen.get

    def write(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Store a frame and read it back; ``codec`` is Parquet's, the session's if not told."""
        path = f"{self.root}/{name}"
        # the table stands for its plan from now on, so the plan's shuffle files go as soon as it is written
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            df.write.mode("overwrite").options(**({"compression": codec} if codec else {})).parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null read as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    at = batch.schema.get_field_index
    return pa.RecordBatch.from_arrays([*(batch.column(at(k)) for k in keep), *new.values()], names=[*keep, *new])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the given links but the smallest ones."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition, as stars. What is held is merged whenever it has doubled since; a forest that is then
    still above two million links is sent on as it is, so that memory stays bounded."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, limit = 0, 2_000_000

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    def sent(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows > limit:
            held = [merged()]
            rows = len(held[0][0])
            if rows > 2_000_000:
                yield from sent(*held[0])
                held, rows = [], 0
            limit = max(2_000_000, 2 * rows)
    if held:
        yield from sent(*merged())


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of ``links`` (a long, b long) as rows (node, component), component the smallest node.

    Rounds of large-star and small-star: every node links its neighbours to the smallest one it knows, until no
    link changes. Each partition first shrinks its links to a forest. A round is one job, whose links are written to
    the shared folder. A node's links are aggregated in part before they meet and joined as a stream, so no task holds
    them, but those of the forest that lead to one node pass through one task. Nodes without links don't appear. Empty
    links give an empty result.
    """
    digest = F.count("*").alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").mapInArrow(_contract, "a long, b long")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, was = scratch.counted(edges, f"{name}0", *digest)
    for step in range(1, 60):
        # large star: a link leads on to the smallest neighbour of its smaller end, if that has any
        low = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        large = edges.join(low, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges, now = scratch.counted(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}{step}", *digest)
        scratch.drop(f"{name}{step - 1}")
        if was == now:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, short_batches, texts_of

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def targets_of(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size, the excess shared again by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), total
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share >= most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Integer quotas: ``seats`` go one by one to the highest quotient votes / (2 * quota + 1); ties to the first.

    The quotas of a slightly too large divisor are rounded counts that are never too many; the few seats that are
    left are then dealt by quotient.
    """
    votes = np.asarray(votes, float)
    quota = np.zeros(len(votes), np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return quota
    quota = np.maximum(0, np.floor(votes * seats / votes.sum() - 0.5)).astype(np.int64)
    while (left := int(seats - quota.sum())) > 0:
        ahead = votes[:, None] / (2 * (quota[:, None] + np.arange(4)) + 1)
        best = np.argsort(-ahead, axis=None, kind="stable")[:left]
        quota += np.bincount(best // 4, minlength=len(votes))
    while True:  # a seat moves while that puts it under a higher quotient
        gain, loss = votes / (2 * quota + 1), np.where(quota > 0, votes / np.maximum(2 * quota - 1, 1), np.inf)
        up, down = int(np.argmax(gain)), int(np.argmin(loss))
        if gain[up] <= loss[down] or up == down:
            return quota
        quota[up] += 1
        quota[down] -= 1


def _take(sizes: np.ndarray, words: int, block: int, seed: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """What is taken from each document of a shard: whole rounds over all blocks, then blocks in a seeded order until
    ``words`` are reached, the last one cut. Gives the rounds and per document the word spans of the last, partial one."""
    total = int(sizes.sum())
    spans: list[list[tuple[int, int]]] = [[] for _ in sizes]
    if not total or words <= 0:
        return 0, spans
    rounds, rest = divmod(words, total)
    if not rest:
        return rounds, spans
    n = -(-total // block)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    lens = np.minimum(block, total - order * block)
    upto = np.cumsum(lens)
    k = int(np.searchsorted(upto, rest))
    lens = lens[: k + 1].copy()
    lens[k] = rest - (upto[k - 1] if k else 0)
    lo = order[: k + 1] * block
    by = np.argsort(lo)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for a, b in zip(lo[by].tolist(), (lo + lens)[by].tolist(), strict=True):
        d = int(np.searchsorted(ends, a, side="right"))
        while a < b:
            cut = min(b, int(ends[d]))
            if cut > a:
                own, at = spans[d], int(starts[d])
                if own and own[-1][1] == a - at:
                    own[-1] = (own[-1][0], cut - at)
                else:
                    own.append((a - at, cut - at))
            a, d = max(a, cut), d + 1
    return rounds, spans


#: Shards of a source that are dealt to together.
FAN = 4096


def _dealt(sizes: DataFrame, keys: list[str], part: str, block: int, most: float) -> DataFrame:
    """A group's blocks for each part by Sainte-Laguë on the parts' sizes: keys, part, blocks, words.

    ``sizes`` has keys, part, size, and blocks and words, those of the whole group. Whole blocks are dealt; no part gets
    more words than ``most`` times its size, and what is left of the group's words goes to the last parts with room.
    """

    def quota(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(part, kind="stable")
        size, words = p["size"].to_numpy(np.int64), int(p["words"].iloc[0])
        cap = (most * size).astype(np.int64)
        blocks = sainte_lague(size, int(p["blocks"].iloc[0]))
        q = np.minimum(blocks * block, cap)
        short = words - int(q.sum())
        for i in range(len(q) - 1, -1, -1):
            if not short:
                break
            move = max(-int(q[i]), min(short, int(cap[i] - q[i])))
            q[i] += move
            short -= move
        return p[[*keys, part]].assign(blocks=blocks, words=q)

    kinds = ", ".join(f"{k} {sizes.schema[k].dataType.simpleString()}" for k in [*keys, part])
    return sizes.groupBy(*keys).applyInPandas(quota, f"{kinds}, blocks long, words long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, most: float = 2.0, block: int = 64, shard_docs: int = 1024, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Words that a mix takes from each row of ``docs``: key, source, size, source_size, target, taken; and rounds
    (how often it is taken whole) and parts (word spans of the round that is taken in part).

    Size is the number of words (null text: 0). Sources, by code point and null last, weigh ``weights`` in turn and
    share ``factor`` times all words; a target stops at ``most`` times its source's words and the excess is shared
    again. Blocks of ``block`` words are dealt to sources by Sainte-Laguë on the targets and within a source to its
    shards by Sainte-Laguë on their words; a shard then takes blocks of its seeded document order. What rounding to
    blocks leaves of a target goes, cut, to the source's last shard with room. No document is taken more than ``most``
    times. Shards hold about ``shard_docs`` documents by a hash of key, so a hot source is many shards; rows
    of sources meet on the driver, sums of at most ``FAN`` shards in a task. Reruns agree. Empty sources have target 0;
    an empty table gives no rows; rows that repeat a key are taken each for itself.
    """
    rows = docs.select(docs[key].alias("k"), docs[source].cast("string").alias("s"), F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    # texts are read once: what follows needs their sizes alone
    rows = Scratch(docs.sparkSession, "source-mix").write(rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("k").cast("string"), "size")), "sizes")
    by_source = rows.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_docs).cast("long"))
    # A row per source: its order gives its weight. Their number, not that of documents, bounds this step.
    listed = by_source.orderBy(F.col("s").asc_nulls_last()).toPandas()
    sizes = listed["source_size"].to_numpy(np.int64) if len(listed) else np.empty(0, np.int64)
    w = np.resize(np.asarray(weights, float), len(sizes))
    target = targets_of(sizes, w, factor * float(sizes.sum()), most)
    quota = sainte_lague(target, int(round(float(target.sum()) / block)))
    plan = pd.DataFrame({"s": listed["s"].where(listed["s"].notna(), None), "source_size": sizes, "target": target, "quota": quota, "shards": listed["shards"].astype("int64")})
    spark = docs.sparkSession
    plan_df = spark.createDataFrame([tuple(x) for x in plan.itertuples(index=False)], "s string, source_size long, target double, quota long, shards long")
    # Never forced to be broadcast: sources may be many.
    sharded = rows.join(plan_df, rows["s"].eqNullSafe(plan_df["s"])).select("k", rows["s"], "size", "h", "source_size", "target", "quota", "shards", F.pmod("h", F.col("shards")).alias("shard"))

    # a source's shards are dealt to in two steps, so that no task holds more than FAN of them in all usual cases
    sized = sharded.groupBy("s", F.expr(f"shard DIV {FAN}").alias("fan"), "shard").agg(F.sum("size").alias("size"), F.first("quota").alias("blocks"), F.rint(F.first("target")).cast("long").alias("words"))
    fans = sized.groupBy("s", "fan").agg(F.sum("size").alias("size"), F.first("blocks").alias("blocks"), F.first("words").alias("words"))
    fans = _dealt(fans, ["s"], "fan", block, most)
    fans = fans.withColumnsRenamed({"s": "qs", "fan": "qfan"})
    own = sized.drop("blocks", "words").join(fans, F.col("s").eqNullSafe(F.col("qs")) & (F.col("fan") == F.col("qfan"))).drop("qs", "qfan")
    quotas = _dealt(own, ["s", "fan"], "shard", block, most).select(F.col("s").alias("qs"), F.col("shard").alias("qshard"), "words")
    joined = sharded.join(quotas, F.col("s").eqNullSafe(F.col("qs")) & (F.col("shard") == F.col("qshard"))).drop("qs", "qshard")

    def take(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["h", "k", "size"], kind="stable")
        name = p["s"].iloc[0]
        own = zlib.crc32(f"{seed}|{'' if pd.isna(name) else 's' + str(name)}|{p['shard'].iloc[0]}".encode())
        rounds, spans = _take(p["size"].to_numpy(np.int64), int(p["words"].iloc[0]), block, own)
        p["rounds"] = rounds
        p["parts"] = [[{"lo": a, "hi": b} for a, b in x] for x in spans]
        p["taken"] = p["size"] * rounds + [sum(b - a for a, b in x) for x in spans]
        return p[["k", "s", "size", "source_size", "target", "taken", "rounds", "parts"]]

    kind = docs.schema[key].dataType.simpleString()
    out = joined.groupBy("s", "shard").applyInPandas(take, f"k {kind}, s string, size long, source_size long, target double, taken long, rounds long, parts array<struct<lo: long, hi: long>>")
    return out.withColumnsRenamed({"k": key, "s": source})


def mixed_documents(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` as ``mix`` has them, same columns: a row for each time that a whole document is taken and one for the
    words of its partly taken round, those words joined by blanks. Documents without words are left out. Rows that share
    key and size, null keys too, are all taken as the first of them; ``n_chars``, if there is such a column, is counted
    anew."""
    short_batches(docs.sparkSession)
    # names that no column has
    own = "_" * (1 + max(map(len, docs.columns)))
    at, words, chosen, size = (f"{own}{n}" for n in ("key", "words", "plan", "size"))
    # one plan for each key and size, so that the join neither drops nor repeats rows
    plan = mixed.where("taken > 0").groupBy(F.col(key).alias(at), F.col("size").alias(words)).agg(F.min(F.struct("rounds", "parts")).alias(chosen))
    plan = plan.select(at, words, F.col(f"{chosen}.rounds").alias(f"{own}rounds"), F.col(f"{chosen}.parts").alias(f"{own}parts"))
    counted = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.withColumn(size, counted).join(plan, docs[key].eqNullSafe(F.col(at)) & (F.col(size) == F.col(words))).drop(at, words, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = range(batch.num_columns - 2)
            texts = texts_of(batch, text)
            which, out = [], []
            for i, (t, rounds, parts) in enumerate(zip(texts, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                which += [i] * rounds
                out += [t] * rounds
                if parts:
                    words = WORDS.findall(t)
                    which.append(i)
                    out.append(" ".join(w for p in parts for w in words[p["lo"] : p["hi"]]))
            at = pa.array(which, pa.int64())
            cols = {batch.schema.names[i]: batch.column(i).take(at) for i in keep}
            cols[text] = pa.array(out, pa.string())
            if n_chars in cols:
                cols[n_chars] = pa.array(list(map(len, out)), cols[n_chars].type)
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, docs.schema)

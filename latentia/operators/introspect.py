"""Inspection of representations: clusters, best states, similar words, sparsity, distances, two-dimensional maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from latentia.functions.numeric import argmax, usable
from latentia.session import cut, ship

QUERY_BLOCK = 4096


def vectors(df: DataFrame, word: str, vector: str, dim: int) -> DataFrame:
    """``word_id, v`` of usable rows."""
    return df.where(usable(F.col(vector), dim)).select(F.col(word).alias("word_id"), F.col(vector).alias("v"))


def exploded(v: DataFrame) -> DataFrame:
    return v.select("word_id", F.posexplode("v").alias("state", "p")).withColumn("p", F.col("p").cast("double"))


def max_emission(v: DataFrame) -> DataFrame:
    """``word_id, state``: the state of the greatest value; the lowest wins ties."""
    return v.select("word_id", argmax(F.col("v")).alias("state"))


def best_states(v: DataFrame, n: int = 5, threshold: float = 1e-5) -> DataFrame:
    """``word_id, state, p, rank``: at most n states above a threshold, inside the row: no shuffle."""
    pairs = F.filter(F.transform("v", lambda x, i: F.struct((-x.cast("double")).alias("m"), i.alias("state"))), lambda s: -s["m"] > threshold)
    return v.select("word_id", F.posexplode(F.slice(F.array_sort(pairs), 1, n)).alias("r", "s")).select("word_id", F.col("s.state").cast("int").alias("state"), (-F.col("s.m")).alias("p"), (F.col("r") + 1).alias("rank"))


def state_words(v: DataFrame, threshold: float) -> DataFrame:
    """``state, word_id, p, place``: words of each state above a threshold, by falling value.

    Few states hold all words: places are given within ranges of the order, not by one task per state.
    """
    kept = exploded(v).where(F.col("p") > threshold)
    by = [F.col("state"), F.col("p").desc(), F.col("word_id")]
    parts = cut(kept.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "places")
    local = parts.withColumn("r", F.row_number().over(Window.partitionBy("part", "state").orderBy(F.col("p").desc(), "word_id")))
    sizes = parts.groupBy("part", "state").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("state").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(sizes.select("part", "state", before.alias("shift"))), ["part", "state"]).select("state", "word_id", "p", (F.col("r") + F.col("shift")).alias("place"))


def clusters_by_word(v: DataFrame, n: int = 5, threshold: float = 1e-5, always: bool = False) -> DataFrame:
    """``state, label, p``: words under their best states; a word with several gets ``__k`` by falling value."""
    best = best_states(v, n, threshold)
    several = F.count("*").over(Window.partitionBy("word_id")) > 1
    label = F.concat(F.col("word_id").cast("string"), F.lit("__"), F.col("rank").cast("string"))
    return best.select("state", (label if always else F.when(several, label).otherwise(F.col("word_id").cast("string"))).alias("label"), "p")


def sparsity(v: DataFrame) -> DataFrame:
    """``state, std, cv``: population standard deviation of a state's column, and divided by its mean."""
    s = exploded(v).groupBy("state").agg(F.stddev_pop("p").alias("sd"), F.avg("p").alias("mean"))
    return s.select("state", F.round(F.col("sd") * 1e6, 3).alias("std_ppm"), F.round(F.col("sd") / F.col("mean"), 6).alias("cv"))


def _similar(block, measure: str, k: int):
    ids, q = block.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s = np.full((len(ids), 0), 0.0)
        best_i = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            s = measured(q, x, measure)
            s = np.hstack([best_s, s])
            i = np.hstack([best_i, np.broadcast_to(batch.column("word_id").to_numpy(), (len(ids), batch.num_rows))])
            best_s, best_i = _best(np.round(s, 9), i, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1])), pa.array(best_i.ravel()), pa.array(best_s.ravel())], ["query_id", "word_id", "score"])

    return run


def _best(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each row and their ids; ties go to lesser ids. Only what reaches the k-th score is sorted."""
    if s.shape[1] > k:
        row, col = np.nonzero(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = (a.ravel() for a in np.indices(s.shape))
    order = np.lexsort((i[row, col], -s[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(s)))
    take = np.arange(len(row)) - first[row] < k
    shape = (len(s), min(k, s.shape[1]))
    return s[row[take], col[take]].reshape(shape), i[row[take], col[take]].reshape(shape)


def measured(q: np.ndarray, x: np.ndarray, measure: str) -> np.ndarray:
    if measure == "cosine":
        return (q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None])
    if measure == "hellinger":
        a, b = np.sqrt(q), np.sqrt(x)
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
        return np.nan_to_num(1 - np.sqrt(d) / np.sqrt(2), nan=0.0)
    raise ValueError(f"unknown measure {measure}")


def most_similar(v: DataFrame, queries: DataFrame, k: int = 10, measure: str = "cosine") -> DataFrame:
    """``query_id, word_id, score, rank``: the k most similar rows of each query row, itself included.

    Queries are sent out in blocks of ``QUERY_BLOCK`` vectors; a task keeps its k best per query, so k rows per query
    and task are shuffled, never pairs.
    """
    spark = v.sparkSession
    ship(spark)
    q = queries.select("word_id", "v").orderBy("word_id")
    out, held = None, []

    def block(rows: list) -> DataFrame:
        ids = np.array([r.word_id for r in rows], np.int64)
        sent = spark.sparkContext.broadcast((ids, np.array([r.v for r in rows], np.float64)))
        return v.select("word_id", "v").mapInArrow(_similar(sent, measure, k), "query_id long, word_id long, score double")

    for r in q.toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            out, held = block(held) if out is None else out.unionByName(block(held)), []
    if held or out is None:
        part = block(held) if held else v.limit(0).select(F.col("word_id").alias("query_id"), "word_id", F.lit(0.0).alias("score"))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "word_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def distances(v: DataFrame, queries: DataFrame) -> DataFrame:
    """``a, b, distance`` (Euclidean) of each query row to every row; queries are sent out in blocks of ``QUERY_BLOCK``."""
    spark = v.sparkSession
    ship(spark)
    held, out = [], None

    def block(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r.word_id for r in rows], np.int64), np.array([r.v for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    for i in range(len(ids)):
                        d = np.sqrt(((x - q[i]) ** 2).sum(1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ids[i])), batch.column("word_id"), pa.array(np.round(d, 6))], ["a", "b", "distance"])

        return v.select("word_id", "v").mapInArrow(run, "a long, b long, distance double")

    for r in queries.select("word_id", "v").orderBy("word_id").toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            out, held = block(held) if out is None else out.unionByName(block(held)), []
    if held or out is None:
        out = block(held) if out is None else out.unionByName(block(held))
    return out


TARGET_LIMIT = 4096


def smacof(d: np.ndarray, seed: int = 3, rounds: int = 300, eps: float = 1e-3) -> np.ndarray:
    """Metric scaling of a distance matrix to two dimensions by majorization."""
    n = len(d)
    x, last = np.random.default_rng(seed).random((n, 2)), None
    for _ in range(rounds):
        own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        stress = ((own - d) ** 2).sum() / 2
        own[own == 0] = 1e-5
        b = -d / own
        b[np.arange(n), np.arange(n)] += (d / own).sum(1)
        x = b @ x / n
        scale = np.sqrt((x * x).sum(1)).sum()
        if last is not None and last - stress / scale < eps:
            break
        last = stress / scale
    return x


def planar_map(v: DataFrame, targets: DataFrame, seed: int = 3) -> DataFrame:
    """``word_id, x, y``: the target words (a list of bounded size) laid out by their distances."""
    spark, chosen = v.sparkSession, v.join(targets.select("word_id").distinct(), "word_id", "left_semi")
    if chosen.limit(TARGET_LIMIT + 1).count() > TARGET_LIMIT:
        raise ValueError(f"a map takes at most {TARGET_LIMIT} target rows")
    rows = distances(chosen, chosen).collect()
    ids = sorted({r.a for r in rows})
    at = {w: i for i, w in enumerate(ids)}
    d = np.zeros((len(ids), len(ids)))
    for r in rows:
        d[at[r.a], at[r.b]] = r.distance
    xy = smacof((d + d.T) / 2, seed) if ids else np.zeros((0, 2))
    return spark.createDataFrame([(w, float(a), float(b)) for w, (a, b) in zip(ids, xy)], "word_id long, x double, y double")

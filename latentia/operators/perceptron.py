"""Averaged structured perceptron for tagging.

The update depends on the order of sentences. An epoch runs over shards: each starts from the shared weights, updates
on its own sentences in ``sent_id`` order, and the shards' weights are averaged; the result is the mean of the
end-of-epoch weights. One shard is the sequential algorithm, for corpora that fit a task. Unless given, the number of
shards follows from the number of sentences, so that the model does not depend on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latentia.operators.chain import best_path
from latentia.session import cut

WEIGHTS = "name string, w array<double>"
WEIGHT_LIMIT = 20_000_000
SHARD_SENTENCES = 20_000


def as_sentences(features: DataFrame) -> DataFrame:
    """``sent_id, feats, vals, tags``: per token its feature names and values, from feature rows."""
    tok = features.groupBy("sent_id", "pos", "tag").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("f"))
    held = tok.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "f"))).alias("a"))
    get = lambda c: F.transform("a", lambda t: F.transform(t["f"], lambda x: x[c]))
    return held.select("sent_id", get("name").alias("feats"), get("value").alias("vals"), F.transform("a", lambda t: t["tag"]).alias("tags"))


class Weights:
    """Emission weights as rows of a matrix, by feature name; initial, transition (by previous tag) and final weights under own names."""

    def __init__(self, n: int, held: dict[str, np.ndarray] | None = None):
        self.n, held = n, held or {}
        self.row: dict[str, int] = {k: i for i, k in enumerate(held)}
        for k in ("\x01init", *(f"\x01prev:{j}" for j in range(n)), "\x01final"):
            self.row.setdefault(k, len(self.row))
        self.w = np.zeros((max(16, len(self.row)), n))
        if held:
            self.w[: len(held)] = np.stack(list(held.values()))
        self.init, self.final = self.row["\x01init"], self.row["\x01final"]
        self.prev = np.array([self.row[f"\x01prev:{j}"] for j in range(n)])

    def rows(self, names: pa.Array, grow: bool) -> np.ndarray:
        """Row of each feature; unseen ones get a row (``grow``) or -1."""
        coded = names.dictionary_encode() if not isinstance(names, pa.DictionaryArray) else names
        known = coded.dictionary.to_pylist()
        if grow:
            at = np.array([self.row.setdefault(k, len(self.row)) for k in known], np.int64)
            if len(self.row) > len(self.w):
                self.w = np.vstack([self.w, np.zeros((max(len(self.w), len(self.row) - len(self.w)), self.n))])
        else:
            at = np.array([self.row.get(k, -1) for k in known], np.int64)
        return at[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)

    def scores(self, rows: np.ndarray, vals: np.ndarray, token: np.ndarray, n_tokens: int) -> np.ndarray:
        """Summed weights of each token's features."""
        seen = rows >= 0
        e = np.zeros((n_tokens, self.n))
        np.add.at(e, token[seen], self.w[rows[seen]] * vals[seen, None])
        return e

    def decode(self, e: np.ndarray) -> np.ndarray:
        return best_path(self.w[self.init], self.w[self.prev].T, self.w[self.final], e[None])[0][0]

    def update(self, rows: np.ndarray, vals: np.ndarray, token: np.ndarray, gold: np.ndarray, pred: np.ndarray) -> None:
        for y, by in ((gold, 1.0), (pred, -1.0)):
            self.w[self.init, y[0]] += by
            self.w[self.final, y[-1]] += by
            np.add.at(self.w, (self.prev[y[:-1]], y[1:]), by)
            wrong = (gold != pred)[token]
            np.add.at(self.w, (rows[wrong], y[token[wrong]]), by * vals[wrong])


def _tokens(sentences: DataFrame) -> DataFrame:
    """A row per token, successive within a sentence: ``sent_id, pos, feats, vals, tags``.

    A sentence may have a thousand features or more, and readers and Arrow hold thousands of rows at once: rows have to be small.
    """
    each = sentences.select(F.col("sent_id").cast("long").alias("sent_id"), F.posexplode(F.arrays_zip("feats", "vals", "tags")).alias("pos", "t"))
    return each.select("sent_id", "pos", "t.feats", "t.vals", "t.tags")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same token rows in batches that end with a sentence."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("sent_id").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if rest and rest[-1].column("sent_id")[0].as_py() != ids[0]:
            starts = np.append(0, starts)
        if not len(starts):
            rest.append(batch)
            continue
        done = [*rest, batch.slice(0, int(starts[-1]))]
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        rest = [batch.slice(int(starts[-1]))]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _flat(batch: pa.RecordBatch):
    """Features of all tokens of whole sentences: names, values, token of each within its sentence; ends of features and tokens per sentence."""
    feats, ids = batch.column("feats"), batch.column("sent_id").to_numpy(zero_copy_only=False)
    token_end = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids))
    per_sentence, per_token = np.diff(token_end, prepend=0), feats.value_lengths().to_numpy(zero_copy_only=False)
    feature_end = np.append(0, np.cumsum(per_token))[token_end]
    place = np.arange(len(per_token)) - np.repeat(token_end - per_sentence, per_sentence)
    return feats.flatten(), batch.column("vals").flatten().to_numpy(zero_copy_only=False), np.repeat(place, per_token), feature_end, per_sentence


def _epoch(sent, tags: list[str]):
    index = {t: i for i, t in enumerate(tags)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights(len(tags), sent.value)
        for batch in _whole(batches):
            names, vals, token, ends, sizes = _flat(batch)
            rows, start, first = w.rows(names, True), 0, 0
            every = np.array([index[t] for t in batch.column("tags").to_pylist()], np.int64)
            for end, n in zip(ends.tolist(), sizes.tolist()):
                gold = every[first : first + n]
                part = slice(start, end)
                pred = w.decode(w.scores(rows[part], vals[part], token[part], n))
                if (pred != gold).any():
                    w.update(rows[part], vals[part], token[part], gold, pred)
                start, first = end, first + n
        names = list(w.row)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(w.w[: len(names)]), pa.list_(pa.float64()))], ["name", "w"])

    return run


def train(sentences: DataFrame, tags: list[str], epochs: int = 2, shards: int | None = None) -> DataFrame:
    """``name, w``: a weight per tag for each feature name."""
    spark = sentences.sparkSession
    data = cut(_tokens(sentences), "sentences")
    shards = shards or max(1, -(-data.select("sent_id").distinct().count() // SHARD_SENTENCES))
    data = data.withColumn("shard", F.pmod(F.xxhash64("sent_id"), F.lit(shards)).cast("int"))
    held: dict[str, np.ndarray] = {}
    total = None
    n = len(tags)
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast(held)
        ordered = data.repartition(shards, "shard").sortWithinPartitions("shard", "sent_id", "pos")
        rows = ordered.select("sent_id", "feats", "vals", "tags").mapInArrow(_epoch(sent, tags), WEIGHTS)
        mean = cut(rows.groupBy("name").agg(F.array(*[F.sum(F.col("w")[i]) / shards for i in range(n)]).alias("w")), "weights")
        if mean.count() * n > WEIGHT_LIMIT:
            raise ValueError("too many weights to send to every task: select features first")
        held = {r.name: np.array(r.w) for r in mean.toLocalIterator()}
        total = mean if total is None else total.unionByName(mean)
    return total.groupBy("name").agg(F.array(*[F.sum(F.col("w")[i]) / epochs for i in range(n)]).alias("w"))


def predict(sentences: DataFrame, weights: DataFrame, tags: list[str]) -> DataFrame:
    """``sent_id, pos, gold, pred``."""
    spark = sentences.sparkSession
    if weights.count() * len(tags) > WEIGHT_LIMIT:
        raise ValueError("too many weights to send to every task")
    sent = spark.sparkContext.broadcast({r.name: np.array(r.w) for r in weights.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights(len(tags), sent.value)
        for batch in _whole(batches):
            names, vals, token, ends, sizes = _flat(batch)
            rows, start, pred = w.rows(names, False), 0, []
            for end, n in zip(ends.tolist(), sizes.tolist()):
                part = slice(start, end)
                pred += [tags[i] for i in w.decode(w.scores(rows[part], vals[part], token[part], n)).tolist()]
                start = end
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), batch.column("pos"), batch.column("tags"), pa.array(pred, pa.string())], ["sent_id", "pos", "gold", "pred"])

    return _tokens(sentences).mapInArrow(run, "sent_id long, pos int, gold string, pred string")

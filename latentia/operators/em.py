"""Expectation maximization over sequences and trees: batch, online, split-merge.

One job per step: partitions accumulate expected counts with numpy kernels (emission counts only of words they saw),
keyed vectors are summed by one shuffle, the M-step is arithmetic on the sums. Parameters travel as a broadcast while
they hold at most ``DENSE_LIMIT`` numbers; larger emissions stay a table and are joined to the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latentia.operators import chain, treebp
from latentia.operators.params import SMOOTHING, Params, merge_arrays, split_arrays, step_size
from latentia.session import cut, ship

DENSE_LIMIT = 16_000_000
FLUSH_WORDS = 50_000
COUNTS = "kind string, key long, vals array<double>"


def check_size(p: Params) -> None:
    """Parameters are broadcast; larger emissions stay a table."""
    if p.E.size > DENSE_LIMIT:
        raise ValueError(f"{p.E.size} emission parameters are too many to broadcast: use em_joined")


def as_sequences(toks: DataFrame, word: str = "word_id", emissions: bool = False) -> DataFrame:
    """``sent_id, x[, e]``: token rows with ``pos`` become one row per sequence, with ``emissions`` also their emission rows ``e``."""
    more = ["e"] if emissions else []
    held = F.array_sort(F.collect_list(F.struct("pos", F.col(word).alias("w"), *more)))
    rows = toks.groupBy("sent_id").agg(held.alias("a"))
    return rows.select("sent_id", F.transform("a", lambda t: t["w"].cast("long")).alias("x"), *[F.transform("a", lambda t: t[c]).alias(c) for c in more])


def as_trees(nodes: DataFrame, word: str = "word_id", rel: str | None = None) -> DataFrame:
    """``sent_id, head, x, rel``: node rows become one row per tree; indices must run from 1 without gaps."""
    r = F.col(rel).cast("int") if rel else F.lit(0)
    held = F.array_sort(F.collect_list(F.struct("idx", "head", F.col(word).cast("long").alias("w"), r.alias("r"))))
    rows = nodes.groupBy("sent_id").agg(held.alias("a"), F.max("idx").alias("last")).where(F.size("a") == F.col("last"))
    part = lambda c, t: F.transform("a", lambda s: s[c].cast(t)).alias
    return rows.select("sent_id", part("head", "int")("head"), part("w", "long")("x"), part("r", "int")("rel"))


def ragged(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))


def by_length(flat: np.ndarray, offsets: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their sequences as a matrix, in groups of one length and bounded size."""
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        n = int(size[rows[0]])
        step = max(1, most // max(n, 1))
        for i in range(0, len(rows) if n else 0, step):
            part = rows[i : i + step]
            yield part, flat[offsets[part][:, None] + np.arange(n)[None]]


def _sums_by(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(vals[order], first, axis=0) if len(first) else vals[:0]


def given_emissions(batch: pa.RecordBatch, n: int):
    """The emission rows ``e`` of a batch's tokens as a function of row numbers and their length; it gives None if the batch has none."""
    if "e" not in batch.schema.names:
        return lambda part, size: None
    rows, offsets = batch.column("e").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, n), ragged(batch.column("x"))[1]
    return lambda part, size: rows[offsets[part][:, None] + np.arange(size)[None]]


class Counts:
    """Expected counts of a partition; emissions as vectors of the words seen."""

    def __init__(self, n: int, r: int):
        self.n, self.r = n, r
        self.init, self.final, self.trans, self.ll = np.zeros((n, r)), np.zeros((n, r)), np.zeros((n, n, r)), np.zeros(3)
        self.emit: dict[int, np.ndarray] = {}

    def words(self, keys: np.ndarray, vals: np.ndarray) -> None:
        for k, v in zip(*(a.tolist() if a.ndim == 1 else a for a in _sums_by(keys, vals))):
            held = self.emit.get(k)
            self.emit[k] = v if held is None else held + v

    def rows(self, final: bool) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, np.ndarray]] = [("emit", k, v) for k, v in self.emit.items()]
        self.emit = {}
        if final:
            out += [("init", 0, self.init.ravel()), ("final", 0, self.final.ravel()), ("ll", 0, self.ll)]
            out += [("trans", i, self.trans[i].ravel()) for i in range(self.n)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["kind", "key", "vals"])


def _chain_counts(sent, approx: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Params = sent.value
        c = Counts(p.n, 1)
        for batch in batches:
            flat, offsets = ragged(batch.column("x"))
            given = given_emissions(batch, p.n)
            for part, x in by_length(flat.astype(np.int64), offsets):
                ll, gamma, xi = chain.posteriors(x, p, approx, given(part, x.shape[1]))
                c.init[:, 0] += gamma[:, 0].sum(0)
                c.final[:, 0] += gamma[:, -1].sum(0)
                c.trans[:, :, 0] += xi
                c.ll += ll.sum(), len(x), x.size
                c.words(x.ravel(), gamma.reshape(-1, p.n))
            if len(c.emit) > FLUSH_WORDS:
                yield from c.rows(False)
        yield from c.rows(True)

    return run


def _forests(batch: pa.RecordBatch, step: int = 2000) -> Iterator[tuple[np.ndarray, treebp.Forest]]:
    head, offsets = ragged(batch.column("head"))
    word, rel = ragged(batch.column("x"))[0], ragged(batch.column("rel"))[0]
    cut_at = lambda a: [a[offsets[i] : offsets[i + 1]] for i in rows]
    for i in range(0, batch.num_rows, step):
        rows = np.arange(i, min(batch.num_rows, i + step))
        yield rows, treebp.forest(cut_at(head), cut_at(word), cut_at(rel))


def _tree_counts(sent, approx: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Params = sent.value
        Rc, Re = p.T.shape[2], p.E.shape[2]
        c = Counts(p.n, Rc)
        for batch in batches:
            for _, fo in _forests(batch):
                b = treebp.Beliefs(fo, p, approx)
                post = b.descend()
                rel = np.minimum(fo.rel, Rc - 1)
                for name, at in (("init", fo.leaf), ("final", fo.parent < 0)):
                    k, v = _sums_by(rel[at], post[at])
                    getattr(c, name)[:, k] += v.T
                c.trans += b.edge_counts()
                c.ll += b.ll.sum(), fo.n_trees, len(fo.parent)
                c.words(fo.word * Re + np.minimum(fo.rel, Re - 1), post)
            if len(c.emit) > FLUSH_WORDS:
                yield from c.rows(False)
        yield from c.rows(True)

    return run


def summed(counts: DataFrame) -> DataFrame:
    """Sums vectors by (kind, key): rows are combined per partition already, so a key has one row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            out: list[tuple[str, int, np.ndarray]] = []
            vals = batch.column("vals")
            flat, offsets = ragged(vals)
            for i, key in enumerate(zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist())):
                v = flat[offsets[i] : offsets[i + 1]]
                if key == held:
                    total = total + v
                else:
                    if held is not None:
                        out.append((*held, total))
                    held, total = key, v
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["kind", "key", "vals"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["kind", "key", "vals"])

    return counts.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(run, COUNTS)


def expected_counts(data: DataFrame, p: Params, approx: bool = False) -> DataFrame:
    """``kind, key, vals``: init, final [N x R]; trans by state [N x R]; emit by word (x R + relation) [N]; ll."""
    check_size(p)
    ship(data.sparkSession)
    sent = data.sparkSession.sparkContext.broadcast(p)
    if "head" in data.columns:
        return summed(data.select("head", "x", "rel").mapInArrow(_tree_counts(sent, approx), COUNTS))
    return summed(data.select("x").mapInArrow(_chain_counts(sent, approx), COUNTS))


def maximized(rows: list, n: int, m: int, rc: int, re: int, smoothing: float = SMOOTHING) -> tuple[Params, float]:
    """Parameters from summed counts, smoothing added once; the log-likelihood of the old ones."""
    pi, f, T, E, ll = np.full((n, rc), smoothing), np.full((n, rc), smoothing), np.full((n, n, rc), smoothing), np.full((m, n, re), smoothing), 0.0
    for kind, key, vals in rows:
        v = np.asarray(vals)
        if kind == "emit":
            E[key // re, :, key % re] += v
        elif kind == "trans":
            T[key] += v.reshape(n, rc)
        elif kind == "init":
            pi += v.reshape(n, rc)
        elif kind == "final":
            f += v.reshape(n, rc)
        else:
            ll = float(v[0])
    joint = T.sum(0) + f
    return Params(pi / pi.sum(0), T / joint, f / joint, E / E.sum(0)), ll


def step(data: DataFrame, p: Params, approx: bool = False) -> tuple[Params, float]:
    rows = [(r.kind, r.key, r.vals) for r in expected_counts(data, p, approx).collect()]
    return maximized(rows, p.n, p.E.shape[0], p.T.shape[2], p.E.shape[2])


def em(data: DataFrame, p: Params, max_iter: int = 5, approx: bool = False) -> tuple[Params, list[float]]:
    """Batch EM; the log-likelihoods are those before each step."""
    data, lls = cut(data, "corpus"), []
    for _ in range(max_iter):
        p, ll = step(data, p, approx)
        lls.append(ll)
    return p, lls


def blended(old: Params, new: Params, eta: float) -> Params:
    mix = lambda a, b: (1 - eta) * a + eta * b
    return Params(mix(old.pi, new.pi), mix(old.T, new.T), mix(old.f, new.f), mix(old.E, new.E))


def online_em(data: DataFrame, p: Params, epochs: int = 1, batch_size: int = 1000, a: float = 4, alpha: float = 0.5, approx: bool = False, seed: int | None = None) -> tuple[Params, list[float]]:
    """Mini-batches in hash order (``seed``) or of ``batch_size`` successive ``sent_id``; t restarts with each epoch.

    A mini-batch is a step of its own by definition; within one, sequences are spread over the cluster. The corpus is
    written once, partitioned by mini-batch, so that a step reads its own rows only.
    """
    if seed is None:
        batch = F.floor((F.col("sent_id") - 1) / batch_size).cast("long")
    else:
        batch = F.pmod(F.xxhash64("sent_id", F.lit(seed)), F.lit(max(1, -(-data.count() // batch_size))))
    share = F.pmod(F.xxhash64("sent_id"), F.lit(max(1, batch_size // 10_000)))  # files of a mini-batch
    numbered = cut(data.withColumn("b", batch).repartition("b", share), "minibatches", by=["b"])
    steps = sorted(r.b for r in numbered.select("b").distinct().collect())
    lls = []
    for _ in range(epochs):
        for t, b in enumerate(steps):
            new, ll = step(numbered.where(F.col("b") == b).drop("b"), p, approx)
            p = blended(p, new, step_size(t, a, alpha))
            lls.append(ll)
    return p, lls


def merge_losses(data: DataFrame, p: Params) -> np.ndarray:
    """Change of log-likelihood for each pair (2i, 2i + 1), over the whole corpus; chains only."""
    if "head" in data.columns:
        raise ValueError("states of tree models cannot be merged")
    sums = expected_counts(data, p).where("kind = 'emit'").agg(*[F.sum(F.col("vals")[i]).alias(f"s{i}") for i in range(p.n)]).first()
    occupancy = np.array([1.0 if s is None else s for s in sums])
    sent = data.sparkSession.sparkContext.broadcast((p, occupancy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, occ = sent.value
        total = np.zeros(q.n // 2)
        for batch in batches:
            for _, x in by_length(*ragged(batch.column("x"))):
                total += chain.merge_losses(x.astype(np.int64), q, occ)
        yield pa.RecordBatch.from_arrays([pa.array(["loss"]), pa.array([0], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["kind", "key", "vals"])

    got = summed(data.select("x").mapInArrow(run, COUNTS)).collect()
    return np.array(got[0].vals) if got else np.zeros(p.n // 2)


def split_merge_em(data: DataFrame, p: Params, desired: int, max_iter: int = 2, noise: float = 0.01, sensitivity: float = 0.5, merge: bool = True, seed: int = 0, keep=None, batch_size: int | None = None, a: float = 4, alpha: float = 0.5, order: int | None = None) -> tuple[Params, list[tuple[int, float]]]:
    """Train; while there are too few states: split all, train, and merge back the share of pairs that lose least.

    ``keep(params, stage)`` is called with the parameters of each stage. With ``batch_size`` each training is online.
    """
    data, log = cut(data, "corpus"), []

    def train(q: Params) -> Params:
        q, lls = online_em(data, q, max_iter, batch_size, a, alpha, seed=order) if batch_size else em(data, q, max_iter)
        log.extend((q.n, ll) for ll in lls)
        return q

    p, stage = train(p), 0
    while p.n < desired:
        if keep is not None:
            keep(p, f"split{(stage := stage + 1)}")
        p = train(split_arrays(p, noise, seed + p.n))
        if merge and "head" not in data.columns and p.n > 2:
            losses = merge_losses(data, p)
            worst_kept = np.argsort(-losses, kind="stable")[: int(len(losses) * sensitivity)]
            if p.n - len(worst_kept) <= p.n // 2:
                worst_kept = worst_kept[: max(0, p.n // 2 - 1)]
            p = merge_arrays(p, [(2 * int(i), 2 * int(i) + 1) for i in worst_kept])
            p = Params(p.pi / p.pi.sum(0), *(a / (p.T.sum(0) + p.f) for a in (p.T, p.f)), p.E / p.E.sum(0))
    return p, log


def with_emissions(data: DataFrame, emission: DataFrame) -> DataFrame:
    """``x, e``: each sequence with the emission rows of its tokens, for vocabularies too large to broadcast.

    ``emission``: ``word_id, v array<double>``. Frequent words skew this join; adaptive execution splits them.
    """
    toks = data.select("sent_id", F.posexplode("x").alias("pos", "word_id")).join(emission, "word_id")
    held = F.array_sort(F.collect_list(F.struct("pos", "word_id", "v")))
    return toks.groupBy("sent_id").agg(held.alias("a")).select(F.transform("a", lambda t: t["word_id"]).alias("x"), F.transform("a", lambda t: t["v"]).alias("e"))


def em_joined(data: DataFrame, p: Params, emission: DataFrame, max_iter: int = 1, approx: bool = False, smoothing: float = SMOOTHING) -> tuple[Params, DataFrame, list[float]]:
    """Batch EM of chains with emissions as a table ``word_id, v``; p.E is not used."""
    spark, n, lls = data.sparkSession, p.n, []
    m = emission.count()
    for _ in range(max_iter):
        sent = spark.sparkContext.broadcast(Params(p.pi, p.T, p.f, np.zeros((0, n, 1))))
        got = cut(summed(with_emissions(data, emission).mapInArrow(_chain_counts(sent, approx), COUNTS)), "counts")
        rows = [(r.kind, r.key, r.vals) for r in got.where("kind <> 'emit'").collect()]
        new, ll = maximized(rows, n, 1, 1, 1, smoothing)
        lls.append(ll)
        counts = got.where("kind = 'emit'").select(F.col("key").alias("word_id"), F.col("vals").alias("c"))
        sums = counts.agg(*[F.sum(F.col("c")[i]).alias(f"s{i}") for i in range(n)]).first()
        scale = F.array(*[F.lit(1.0 / ((sums[i] or 0.0) + m * smoothing)) for i in range(n)])
        zero = F.array(*[F.lit(0.0)] * n)
        emission = cut(emission.select("word_id").join(counts, "word_id", "left").select("word_id", F.zip_with(F.coalesce("c", zero), scale, lambda c, s: (c + smoothing) * s).alias("v")), "emission")
        p = Params(new.pi, new.T, new.f, p.E)
    return p, emission, lls

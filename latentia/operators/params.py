"""Model parameters as long tables ``(param, i, j, r, v)`` and their operators; conversion to and from arrays.

``init``: i = state; ``trans``: i = state, j = previous state; ``final``: j = state; ``emit``: i = word, j = state.
``r`` is the relation (0 in models without relations). For every j and r the transitions and the final probability sum
to one; initial probabilities sum to one per r, emissions per state and r.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCHEMA = "param string, i long, j long, r long, v double"
SMOOTHING = 1e-8
DRIVER_LIMIT = 20_000_000


@dataclass
class Params:
    """Arrays with a trailing relation axis R (1 without relations): pi[N,R], T[N,N,R], f[N,R], E[M,N,R]."""

    pi: np.ndarray
    T: np.ndarray
    f: np.ndarray
    E: np.ndarray
    extra: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return self.pi.shape[0]

    @property
    def r(self) -> int:
        return max(self.pi.shape[1], self.T.shape[2], self.f.shape[1], self.E.shape[2])

    def sane(self, tol: float = 1e-2) -> bool:
        """Shapes agree and everything sums to one, for all relations."""
        n = self.n
        if self.T.shape[:2] != (n, n) or self.f.shape[0] != n or self.E.shape[1] != n:
            return False
        sums = (self.pi.sum(0), self.T.sum(0) + self.f, self.E.sum(0))
        return all(np.allclose(s, 1, atol=tol) for s in sums)


def normalized_arrays(pi, T, f, E) -> Params:
    pi, T, f, E = (np.asarray(a, np.float64) for a in (pi, T, f, E))
    joint = T.sum(0) + f
    return Params(pi / pi.sum(0), T / joint, f / joint, E / E.sum(0))


def random_params(n: int, m: int, r: int = 1, seed: int = 0, omit_class: bool = False, omit_emission: bool = False) -> Params:
    """Uniform random, normalized; the flags leave relations out of transitions and initial, or of emissions."""
    g, rc, re = np.random.default_rng(seed), 1 if omit_class else r, 1 if omit_emission else r
    return normalized_arrays(g.random((n, rc)), g.random((n, n, rc)), g.random((n, rc)), g.random((m, n, re)))


def to_table(spark: SparkSession, p: Params) -> DataFrame:
    """All parameters as rows, through Arrow."""
    import pandas as pd

    def rows(name: str, a: np.ndarray, axes: tuple[str, ...]) -> pd.DataFrame:
        at = np.indices(a.shape).reshape(a.ndim, -1)
        cols = dict.fromkeys(("i", "j", "r"), np.zeros(a.size, np.int64)) | {c: x.astype(np.int64) for c, x in zip(axes, at)}
        return pd.DataFrame({"param": name, **cols, "v": a.ravel()})

    parts = [rows("init", p.pi, ("i", "r")), rows("trans", p.T, ("i", "j", "r")), rows("final", p.f, ("j", "r")), rows("emit", p.E, ("i", "j", "r"))]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True), SCHEMA)


def from_table(table: DataFrame) -> Params:
    """Arrays of a table of at most ``DRIVER_LIMIT`` rows; larger emissions stay a table (``em_joined``)."""
    if table.limit(DRIVER_LIMIT + 1).count() > DRIVER_LIMIT:
        raise ValueError(f"more than {DRIVER_LIMIT} parameters do not go to the driver")
    pdf = table.toPandas()
    out = {}
    for name, axes in (("init", ("i", "r")), ("trans", ("i", "j", "r")), ("final", ("j", "r")), ("emit", ("i", "j", "r"))):
        rows = pdf[pdf.param == name]
        at = [rows[a].to_numpy(np.int64) for a in axes]
        a = np.zeros([int(x.max()) + 1 for x in at])
        a[tuple(at)] = rows.v
        out[name] = a
    return Params(out["init"], out["trans"], out["final"], out["emit"])


def normalized(table: DataFrame) -> DataFrame:
    """Divides each row by its group's sum: transitions together with final probabilities per (j, r), initial per r,
    emissions per (j, r). The sums, one row per state and relation, are joined, so no state's column is one task."""
    group = F.when(F.col("param").isin("trans", "final"), "out").otherwise(F.col("param"))
    key = F.when(F.col("param") == "init", "").otherwise(F.col("j").cast("string"))  # states may be numbers or names
    keyed = table.withColumn("g", group).withColumn("k", key)
    sums = keyed.groupBy("g", "k", "r").agg(F.sum("v").alias("s"))
    return keyed.join(F.broadcast(sums), ["g", "k", "r"]).select("param", "i", "j", "r", (F.col("v") / F.col("s")).alias("v"))


def unbalanced(table: DataFrame, tol: float = 1e-2) -> DataFrame:
    """Groups that do not sum to one: ``g, k, r, s``; none in a sane model."""
    group = F.when(F.col("param").isin("trans", "final"), "out").otherwise(F.col("param"))
    key = F.when(F.col("param") == "init", "").otherwise(F.col("j").cast("string"))  # states may be numbers or names
    return table.groupBy(group.alias("g"), key.alias("k"), "r").agg(F.sum("v").alias("s")).where(F.abs(F.col("s") - 1) > tol)


def interpolated(old: DataFrame, batch: DataFrame, eta: float) -> DataFrame:
    """(1 - eta) x old + eta x batch; a row missing on one side counts as zero there."""
    b = batch.select("param", "i", "j", "r", F.col("v").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return old.join(b, ["param", "i", "j", "r"], "full").select("param", "i", "j", "r", ((1 - eta) * zero("v") + eta * zero("b")).alias("v"))


def split(table: DataFrame, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Each state s becomes 2s and 2s + 1, values times 1 + N(0, noise), normalized."""
    twice = lambda c: F.array(2 * F.col(c), 2 * F.col(c) + 1)
    out = table
    for c, params in (("i", ("init", "trans")), ("j", ("trans", "final", "emit"))):
        out = out.withColumn(c, F.explode(F.when(F.col("param").isin(*params), twice(c)).otherwise(F.array(c))))
    if noise:
        out = out.withColumn("v", F.col("v") * (1 + noise * F.randn(seed)))
    return normalized(out)


def merge(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merges the states of ``pairs(keep, gone)``: initial probabilities and rows of transitions are summed, columns
    (previous state, final, emission) averaged. State numbers of merged-away states stay unused."""
    into = pairs.select(F.col("gone").alias("_g"), F.col("keep").alias("_k"))
    out = table
    for c, params in (("i", ("init", "trans")), ("j", ("trans", "final", "emit"))):
        joined = out.join(F.broadcast(into), (F.col(c) == F.col("_g")) & F.col("param").isin(*params), "left")
        out = joined.withColumn(c, F.coalesce("_k", c)).drop("_g", "_k")
        out = out.groupBy("param", "i", "j", "r").agg(F.sum("v").alias("s"), F.avg("v").alias("m")).select("param", "i", "j", "r", (F.col("s") if c == "i" else F.when(F.col("param") == "init", F.col("s")).otherwise(F.col("m"))).alias("v"))
    return out


def brown_emission(vocab: DataFrame, clusters: DataFrame, factor: float = 1000.0) -> DataFrame:
    """Emission rows from word clusters: a word weighs ``factor`` in its cluster's state and 1 elsewhere, normalized
    per state. States are numbered by cluster name; words without a cluster weigh 1 everywhere."""
    names = clusters.select("cluster").distinct()
    states = names.withColumn("state", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("int"))
    of = clusters.join(F.broadcast(states), "cluster").select("word", F.col("state").alias("own"))
    listed = F.broadcast(states.agg(F.array_sort(F.collect_list("state")).alias("all")).withColumn("_one", F.lit(1)))
    words = vocab.select(F.col("id").alias("word_id"), "word").join(of, "word", "left").withColumn("_one", F.lit(1)).join(listed, "_one")
    rows = words.select("word_id", F.explode("all").alias("state"), "own").withColumn("w", F.when(F.col("own") == F.col("state"), factor).otherwise(1.0))
    sums = words.agg(F.count("*").alias("m")).withColumn("_one", F.lit(1))
    hits = of.join(vocab.select("word"), "word", "left_semi").groupBy(F.col("own").alias("state")).agg(F.count("*").alias("h"))
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(sums), "_one").join(F.broadcast(hits), "state", "left")
    return joined.select("word_id", "state", (F.col("w") / (F.col("m") + (factor - 1) * F.coalesce("h", F.lit(0)))).alias("v"))


def split_arrays(p: Params, noise: float, seed: int = 0) -> Params:
    g = np.random.default_rng(seed)
    twice = lambda a, *axes: a if not axes else twice(np.repeat(a, 2, axes[0]), *axes[1:])
    shaken = lambda a: a * np.clip(1 + g.normal(0, noise, a.shape), 1e-6, None)
    return normalized_arrays(*(shaken(a) for a in (twice(p.pi, 0), twice(p.T, 0, 1), twice(p.f, 0), twice(p.E, 1))))


def merge_arrays(p: Params, pairs: list[tuple[int, int]]) -> Params:
    """The same on arrays; states are renumbered."""
    gone = {b for _, b in pairs}
    keep = [s for s in range(p.n) if s not in gone]
    pi, T, f, E = p.pi.copy(), p.T.copy(), p.f.copy(), p.E.copy()
    for a, b in pairs:
        pi[a] += pi[b]
        f[a], E[:, a] = (f[a] + f[b]) / 2, (E[:, a] + E[:, b]) / 2
        T[:, a] = (T[:, a] + T[:, b]) / 2
    for a, b in pairs:
        T[a] += T[b]
    return Params(pi[keep], T[np.ix_(keep, keep)], f[keep], E[:, keep])


def step_size(t: int, a: float, alpha: float) -> float:
    return (t + a) ** -alpha

"""Mixing sources to target shares: Poisson replication.

Each document has a uniform number from a seeded hash of its id; inverting the Poisson distribution with its source's
rate at that number gives its uses, at most ``max_repeats``. The total is the largest at which every target source
can supply its share under its cap. Because capping lowers a Poisson mean, and because texts differ in length, the
rate is not the quotient of sizes: it is the rate at which the uses *as drawn* sum up to the source's share. Those sums
are monotone in the rate, and are taken over all documents for a grid of rates, refined until one document decides.

Driver-side data: one row per target source and grid point; never documents.

Defined cases: a null source, or one without a target, is used 0 times; a target source without documents contributes
nothing and its share is spread over the others in proportion; null and empty texts have 0 tokens and are used 0
times; a target share of 0 uses nothing; ``max_repeats`` null or below 1 counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from latentia.llm.tokens import PATTERN, VOCABULARY, with_tokens
from latentia.session import cut

GRID, ROUNDS = 64, 4


def thresholds(rate: float, cap: int) -> list[float]:
    """P(X < j) for j = 1 to cap: a document is used once for each that lies below its number."""
    if math.isinf(rate):
        return [-1.0] * cap
    if rate <= 0:
        return [1.0] * cap
    total, out = 0.0, []
    for j in range(cap):  # by logarithms: exp(-rate) alone is 0 for large rates
        total += math.exp(j * math.log(rate) - rate - math.lgamma(j + 1))
        out.append(min(total, 1.0))
    return out


def _grid_sums(grids):
    """Partial sums of tokens x uses per source and rate of its grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros(len(g), np.int64) for s, g in grids.value.items()}
        for batch in batches:
            source = batch.column("source").to_pylist()
            u, n = batch.column("u").to_numpy(), batch.column("n_tokens").to_numpy()
            which = np.array([x if x in sums else "" for x in map(str, source)], object)
            for s, grid in grids.value.items():
                at = which == s
                if at.any():
                    x, w = u[at], n[at]
                    order = np.argsort(x)
                    above = np.append(np.cumsum(w[order][::-1])[::-1], 0)  # tokens of documents whose number is greater
                    for i, cuts in enumerate(grid):
                        sums[s][i] += int(above[np.searchsorted(x[order], cuts, side="right")].sum())
        rows = [(s, i, int(v)) for s, a in sums.items() for i, v in enumerate(a.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["source", "i", "v"])

    return run


def uses(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, n_tokens, uses`` for every document, also those never used."""
    spark = docs.sparkSession
    # 53 bits of the hash: a uniform number that depends on the id and the seed only
    number = f"(pmod(xxhash64(cast({doc_id} as bigint), {seed}L), 9007199254740992L) + 0.5D) / 9007199254740992.0D"
    sized = with_tokens(docs, text, {"doc_id": f"cast({doc_id} as bigint)", "source": f"cast({source} as string)", "u": number}, vocabulary, pattern)
    sized = cut(sized, "sizes")
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("source is not null")
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    plan = {r.source: (r.share or 0.0, max(0, r.cap or 0), r.tokens) for r in wanted.join(have, "source").collect()}
    plan = {s: v for s, v in plan.items() if v[0] > 0 and v[1] > 0}
    total = min((cap * tokens / share for share, cap, tokens in plan.values()), default=0.0)
    goal = {s: total * share for s, (share, cap, tokens) in plan.items()}
    # bounds of each rate: uses cannot need more than the cap at every document
    low, high = dict.fromkeys(plan, 0.0), {s: 40.0 + 4.0 * plan[s][1] for s in plan}
    rate = {s: math.inf for s, (share, cap, tokens) in plan.items() if goal[s] >= cap * tokens * (1 - 1e-12)}
    for _ in range(ROUNDS if len(plan) > len(rate) else 0):
        grid = {s: np.linspace(low[s], high[s], GRID) for s in plan if s not in rate}
        sent = spark.sparkContext.broadcast({s: [thresholds(x, plan[s][1]) for x in g] for s, g in grid.items()})
        rows = sized.select("source", "u", "n_tokens").where(F.col("source").isin(list(grid))).mapInArrow(_grid_sums(sent), "source string, i int, v long").groupBy("source", "i").agg(F.sum("v").alias("v")).collect()
        at = {(r.source, r.i): r.v for r in rows}
        for s, g in grid.items():
            i = max([0, *(i for i in range(GRID) if at.get((s, i), 0) <= goal[s])])
            low[s], high[s] = float(g[i]), float(g[min(i + 1, GRID - 1)])
            best = min(range(GRID), key=lambda i: abs(at.get((s, i), 0) - goal[s]))
            plan[s] = (*plan[s][:3], float(g[best]))
    cuts = [(s, thresholds(rate[s] if s in rate else v[3], v[1])) for s, v in plan.items()]
    cuts = spark.createDataFrame(cuts, "source string, cuts array<double>")
    n = F.when(F.col("n_tokens") > 0, F.coalesce(F.size(F.filter("cuts", lambda c: F.col("u") > c)), F.lit(0))).otherwise(0)
    return sized.join(F.broadcast(cuts), "source", "left").select("doc_id", "source", "n_tokens", F.greatest(n, F.lit(0)).alias("uses"))


def mixture(used: DataFrame, seed: int = 42) -> DataFrame:
    """One row per use, in a global order that depends on the seed only."""
    each = used.where("uses > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use_no"))
    return each.withColumn("shuffle_key", F.xxhash64("doc_id", "use_no", F.lit(seed + 1))).orderBy("shuffle_key", "doc_id", "use_no")


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: documents, tokens, tokens as mixed, target and actual share, most uses of one document."""
    per = used.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses")
    )
    joined = per.join(F.broadcast(targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))), "source", "full")
    everything = Window.partitionBy(F.lit(0))  # one row per source
    return joined.withColumn("all_tokens", F.sum("mixed_tokens").over(everything)).select(
        "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens", "mixed_tokens")], F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats", "target_share",
        F.round(F.coalesce("mixed_tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("actual_share"),
    )

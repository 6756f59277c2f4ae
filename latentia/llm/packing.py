"""Filling containers of fixed capacity: Karmarkar-Karp multiway differencing.

Texts longer than the capacity are split into full pieces, each a container of its own, and a rest. Rests and all
other texts are hashed into blocks of about ``BLOCK_WINDOWS`` containers; each block is differenced on its own, so
the work per block is bounded whatever the size of the table, and only (id, piece, size) is shuffled. In a block the
number of windows starts at a lower bound and rises while some window exceeds the capacity.

Multiway differencing: every item starts as a partial partition with one filled window. The two partial partitions of
the greatest imbalance are merged by laying the fullest windows of one on the emptiest of the other, until one
partition is left.

Defined cases: null and empty texts have no tokens and get no container; ties are broken by order of (id, piece);
repeated rows with different ids are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from latentia.llm.tokens import PATTERN, VOCABULARY, with_tokens
from latentia.session import cut

BLOCK_WINDOWS = 128


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Least number of windows by volume, given that items over half the capacity need windows of their own."""
    big = sizes[2 * sizes > capacity]
    best = max(-(-int(sizes.sum()) // capacity), len(big))
    for t in np.unique(np.quantile(sizes, [0.25, 0.5, 0.75, 0.9])).astype(int).tolist() if len(sizes) else []:
        if 0 < 2 * t <= capacity:
            alone = sizes > capacity - t  # nothing of size t or more fits beside these
            shared = (2 * sizes > capacity) & ~alone
            room = capacity * int(shared.sum()) - int(sizes[shared].sum())
            rest = int(sizes[(sizes >= t) & (2 * sizes <= capacity)].sum())
            best = max(best, int(alone.sum()) + int(shared.sum()) + max(0, -(-(rest - room) // capacity)))
    return best


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each item."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # node: sums of its windows, greatest first; a merged node also remembers its children and the laying
    sums: list = [None] * n
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)

    def of(i: int) -> np.ndarray:
        if i >= n or sums[i] is not None:
            return sums[i]
        v = np.zeros(k, np.int64)
        v[0] = sizes[i]
        return v

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = of(a) + of(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        sums[a] = sums[b] = None
        made.append((a, b, order.astype(np.int32)))
        sums.append(total)
        heapq.heappush(heap, (-int(total[0]), len(sums) - 1))
    window = np.zeros(n, np.int64)
    places = {len(sums) - 1: np.arange(k)}
    for j in range(len(made) - 1, -1, -1):
        a, b, order = made[j]
        here = places.pop(n + j)
        at = np.empty(k, np.int64)
        at[order] = here  # window of the merge before sorting -> final window
        for child, lay in ((a, at), (b, at[::-1])):
            if child < n:
                window[child] = lay[0]
            else:
                places[child] = lay
    return window


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of all items, none over the capacity."""
    k = max(1, lower_bound(sizes, capacity))
    while True:
        window = differencing(sizes, min(k, len(sizes)) or 1)
        over = np.bincount(window, sizes) - capacity
        if over.max(initial=0) <= 0:
            return window
        k += max(1, int(over[over > 0].sum()) // capacity)


def containers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, pattern: str = PATTERN, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, container`` of every piece of every non-empty text."""
    sizes = with_tokens(docs.where(F.length(text) > 0), text, {"doc_id": f"cast({doc_id} as bigint)"}, vocabulary, pattern)
    sizes = cut(sizes.where("n_tokens > 0"), "tokens")
    cap = F.lit(capacity)
    full = sizes.where(F.col("n_tokens") >= cap).select(
        "doc_id", F.explode(F.sequence(F.lit(0), (F.col("n_tokens") / cap).cast("int") - 1)).alias("piece")
    ).select("doc_id", "piece", (F.col("piece") * cap).cast("long").alias("first_token"), cap.cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"))
    rest = sizes.where(F.col("n_tokens") % cap > 0).select(
        "doc_id", (F.col("n_tokens") / cap).cast("int").alias("piece"), (F.col("n_tokens") - F.col("n_tokens") % cap).alias("first_token"), (F.col("n_tokens") % cap).alias("n_tokens")
    )
    total = rest.agg(F.sum("n_tokens")).first()[0] or 0
    blocks = max(1, round(total / (capacity * block_windows)))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))

    def run(key, pdf):
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        window = pack(pdf["n_tokens"].to_numpy(np.int64), capacity)
        return pdf.drop(columns="block").assign(container=[f"block-{key[0]}-{w}" for w in window.tolist()])

    schema = "doc_id long, piece int, first_token long, n_tokens long, container string"
    return full.unionByName(rest.groupBy("block").applyInPandas(run, schema))


def fill_report(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, least possible containers by volume, share of used space, fullest container."""
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"), F.max("used").alias("fullest"),
    )

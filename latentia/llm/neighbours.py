"""The k most similar vectors of every vector: learned partitions of the space.

1. Copies of a vector are one class: its least ids stand for all of them, so that a group of copies holding a third of
   all rows is one vector to the search. Ties go to lesser ids.
2. A sample of at most ``SAMPLE`` classes gives a neighbour graph, which recursive bisection (smoothed vectors split at
   the median, then swaps across the cut) divides into parts of equal size. A small network learns the part of a
   vector. Sample size is the only bound on training; every row is indexed.
3. Each class is indexed in its most probable part and visits parts in order of probability until ``COVER`` of it is
   reached, at least ``LEAST`` and at most ``probes`` of them. Parts of more than ``PART_ROWS`` rows are divided again:
   one scan samples all of them, each is graphed and trained in a task, and its network meets the rows that are routed
   there, in shares. Only the first network is broadcast; the others stay a table.
4. Some groups have nothing to learn, such as near copies that differ by noise: their neighbours lie in parts that the
   networks cannot foresee. So the index is measured: the true neighbours of ``MEASURED`` classes are found by brute
   force, and parts whose measured recall is below ``RECALL`` are joined with those that hold what they miss. Joined
   parts are searched as a whole, all rows against all, in blocks of ``PART_ROWS`` residents.
5. In each part or block visitors are compared with all residents; the best k of all parts are a row's neighbours.

Defined cases: unusable vectors (null, another length, not finite, all zero) take no part; a vector is not its own
neighbour but its copies are; fewer than k other vectors give fewer rows; an empty table gives none; ids are unique.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from latentia.llm.clusters import shared_out
from latentia.llm.vectors import as_list, matrix, units
from latentia.session import cut

SAMPLE = 16_384
PART_ROWS = 16_384
TARGET_ROWS = 2_048
COVER, LEAST, PROBES = 0.999, 2, 8
HIDDEN, EPOCHS, LEVELS = 128, 30, 6
MOST_PARTS = 256  # of one network
VISITORS = 8
MEASURED, RECALL = 1024, 0.95
ROUTED_ROWS = 65_536  # that meet a network in one task
ROUTES = "id long, v array<float>, part long, p double, resident boolean"
NETS = "part long, parts int, w array<float>"


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(nbr: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Recursive bisection of the neighbour graph into parts of equal size (up to one row)."""
    n, rng = len(nbr), np.random.default_rng(seed)
    label, done, todo = np.zeros(n, np.int64), 0, [(np.arange(n), parts)]
    local = np.full(n, -1)
    while todo:
        rows, p = todo.pop()
        if p == 1 or len(rows) < 2:
            label[rows] = done
            done += 1
            continue
        local[rows] = np.arange(len(rows))
        v = local[nbr[rows]]
        u, v = np.repeat(np.arange(len(rows)), nbr.shape[1]), v.ravel()
        u, v = u[v >= 0], v[v >= 0]
        u, v = np.append(u, v), np.append(v, u)
        deg = np.bincount(u, minlength=len(rows)) + 1.0
        y = rng.standard_normal(len(rows))
        for _ in range(30):
            y = (np.bincount(u, y[v], len(rows)) + y) / deg
            y -= y.mean()
            y /= np.abs(y).max() or 1
        left = p // 2
        at = len(rows) * left // p
        side = np.zeros(len(rows), bool)
        side[np.argsort(y, kind="stable")[at:]] = True
        for _ in range(5):  # swap the rows that gain most, as many from either side
            cross = np.bincount(u, side[u] != side[v], len(rows)) * 2 - (deg - 1)
            a, b = (np.flatnonzero(side == s) for s in (False, True))
            a, b = a[np.argsort(-cross[a], kind="stable")], b[np.argsort(-cross[b], kind="stable")]
            m = min(len(a), len(b))
            gain = cross[a[:m]] + cross[b[:m]] > 0
            m = int(gain.sum()) // 2
            if not m:
                break
            side[a[:m]], side[b[:m]] = True, False
        local[rows] = -1
        todo += [(rows[~side], left), (rows[side], p - left)]
    return label


class Network:
    """One hidden layer, softmax over parts."""

    def __init__(self, w: list[np.ndarray]):
        self.w = w

    @classmethod
    def trained(cls, x: np.ndarray, y: np.ndarray, parts: int, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        w = [rng.standard_normal((d, HIDDEN)) * (2 / d) ** 0.5 * 3, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / HIDDEN**0.5, np.zeros(parts)]
        w = [a.astype(np.float32) for a in w]
        m, s, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(EPOCHS):
            order, rate = rng.permutation(len(x)), 3e-3 * (1 - epoch / EPOCHS) + 1e-4
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                xb = x[rows]
                h = np.maximum(xb @ w[0] + w[1], 0)
                g = cls.soft(h @ w[2] + w[3])
                g[np.arange(len(rows)), y[rows]] -= 1
                g /= len(rows)
                gh = (g @ w[2].T) * (h > 0)
                t += 1
                for j, grad in enumerate((xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    s[j] = 0.999 * s[j] + 0.001 * grad * grad
                    w[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w])

    @classmethod
    def of(cls, flat: np.ndarray, dim: int, parts: int) -> Network:
        shapes = ((dim, HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,))
        ends = np.cumsum([int(np.prod(n)) for n in shapes])
        return cls([a.reshape(n) for a, n in zip(np.split(np.asarray(flat, np.float32), ends[:-1]), shapes)])

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.soft(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + np.float32(0) if batch.num_rows else np.zeros((0, 1), np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary()), v], ["id", "key", "v"])


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """``id, n, ids, v`` of each distinct vector: ids are its k + 1 least ones. Combined per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            first: dict[bytes, int] = {}
            for i, (key, row) in enumerate(zip(batch.column("key").to_pylist(), batch.column("id").to_pylist())):
                held.setdefault(key, []).append(row)
                first.setdefault(key, i)
            keys = list(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([len(held[x]) for x in keys], pa.int64()), pa.array([sorted(held[x])[: k + 1] for x in keys], pa.list_(pa.int64())), batch.column("v").take(pa.array([first[x] for x in keys], pa.int64()))],
                ["key", "n", "ids", "v"],
            )

    return (
        rows.mapInArrow(run, "key binary, n long, ids array<long>, v array<float>").groupBy("key")
        .agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.first("v").alias("v"))
        .select(F.col("ids")[0].alias("id"), "key", "n", "ids", "v")
    )


def _hash(row: str = "id") -> Column:
    return F.pmod(F.xxhash64(row), F.lit(2**62))


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """Rows (``id, v, part, n``) of least hash, near ``sample`` of each part; ``n`` is the part's size."""
    return rows.where(_hash() <= F.least(F.lit(1.0), 1.5 * sample / F.col("n")) * F.lit(float(2**62))).select("part", "n", "id", "v", _hash().alias("h"))


def _trained(dim: int, target_rows: int, sample: int):
    """One network for the sample of a part."""

    def run(table: pa.Table) -> pa.Table:
        part, n = table.column("part")[0].as_py(), table.column("n")[0].as_py()
        order = np.lexsort((table.column("id").to_numpy(), table.column("h").to_numpy()))[:sample]
        x = np.ascontiguousarray(matrix(table.column("v"), dim)[order])
        parts = min(max(2, n // target_rows), max(2, len(x) // 64), MOST_PARTS)
        label = balanced_parts(graph(x, min(10, len(x) - 1)), parts, seed=part % 2**31)
        net = Network.trained(x, label, parts, seed=part % 2**31)
        return pa.table({"part": pa.array([part], pa.int64()), "parts": pa.array([parts], pa.int32()), "w": as_list(net.flat()[None])})

    return run


def _next(net: Network, x: np.ndarray, probes: int, cover: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the parts they go on to, how probable those are, and whether it is the most probable one."""
    q = net(x)
    few = min(probes, q.shape[1])
    best = np.argpartition(-q, few - 1, axis=1)[:, :few]
    p = np.take_along_axis(q, best, 1)
    order = np.lexsort((best, -p), axis=1)
    best, p = np.take_along_axis(best, order, 1), np.take_along_axis(p, order, 1)
    keep = (np.arange(few) < LEAST) | (np.cumsum(p, 1) - p < cover)
    row, rank = np.nonzero(keep)
    return row, best[row, rank], p[row, rank], rank == 0


def _first_routes(net, dim: int, probes: int, cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, to, p, first = _next(net.value, matrix(batch.column("v"), dim), probes, cover)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(to + 1), pa.array(p.astype(np.float64)), pa.array(first)], ["id", "v", "part", "p", "resident"])

    return run


def _further_routes(dim: int, probes: int, cover: float):
    """Rows at a part and its network: their routes to the part's parts."""

    def run(rows: pa.Table, nets: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["id", "v", "part", "p", "resident"])
        net = Network.of(nets.column("w")[0].values.to_numpy(), dim, nets.column("parts")[0].as_py())
        row, to, p, first = _next(net, matrix(rows.column("v"), dim), probes, cover)
        take = pa.array(row)
        part = rows.column("part").to_numpy()[row] * 2 * MOST_PARTS + 1 + to
        return pa.table({"id": rows.column("id").take(take), "v": rows.column("v").take(take), "part": part, "p": rows.column("p").to_numpy()[row] * p, "resident": rows.column("resident").to_numpy()[row] & first})

    return run


def routed(classes: DataFrame, dim: int, probes: int, cover: float, target_rows: int = TARGET_ROWS, part_rows: int = PART_ROWS, sample: int = SAMPLE) -> DataFrame:
    """``id, v, part, p, resident``: the parts that each class visits, and the one it lives in."""
    spark, n = classes.sparkSession, classes.count()
    whole = classes.select("id", "v", F.lit(0).cast("long").alias("part"))
    if n <= 2 * target_rows:
        return whole.select("id", "v", "part", F.lit(1.0).alias("p"), F.lit(True).alias("resident"))
    train = lambda rows: _sampled(rows, sample).groupBy("part").applyInArrow(_trained(dim, target_rows, sample), NETS)
    first = train(whole.withColumn("n", F.lit(n))).first()
    sent = spark.sparkContext.broadcast(Network.of(np.array(first.w, np.float32), dim, first.parts))
    routes = cut(whole.mapInArrow(_first_routes(sent, dim, probes, cover), ROUTES), "routes")
    for level in range(LEVELS):
        homes = routes.where("resident").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > part_rows)
        large = cut(routes.join(homes.select("part"), "part", "left_semi").groupBy("part").agg(F.count_if("resident").alias("n"), F.count("*").alias("m")), "large")  # one row per part
        if large.isEmpty():
            break
        rows = routes.join(large, "part")
        nets = cut(train(rows.where("resident")), "networks")
        shares = F.ceil(F.col("m") / ROUTED_ROWS).cast("int")
        left = rows.withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).groupBy("part", "share")
        right = nets.join(large, "part").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).select("part", "share", "parts", "w").groupBy("part", "share")
        further = left.cogroup(right).applyInArrow(_further_routes(dim, probes, cover), ROUTES)
        routes = cut(routes.join(large.select("part"), "part", "left_anti").select("id", "v", "part", "p", "resident").unionByName(further), "routes")
    else:
        level += 1
    if level:  # routes of several levels: the most probable ones of each row
        w = Window.partitionBy("id").orderBy(F.col("resident").desc(), F.col("p").desc(), "part")
        routes = cut(routes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= probes).drop("r"), "routes")
    return routes


def _nearest_of(sent, dim: int, k: int):
    """The k nearest rows of a task for each measured class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        held_s, held_i = np.full((len(ids), k), -2.0), np.full((len(ids), k), -1)
        for batch in batches:
            x, own = matrix(batch.column("v"), dim).astype(np.float64), batch.column("id").to_numpy()
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            for a in range(0, len(x), 4096):
                s = q @ x[a : a + 4096].T
                s[ids[:, None] == own[None, a : a + 4096]] = -2
                row = np.flatnonzero((s > held_s[:, -1:]).any(axis=1))  # later rows seldom are among the nearest
                few = min(k, s.shape[1])
                best = np.argpartition(-s[row], few - 1, axis=1)[:, :few]
                both_s = np.hstack([held_s[row], np.take_along_axis(s[row], best, 1)])
                both_i = np.hstack([held_i[row], own[a + best]])
                order = np.argsort(-both_s, axis=1, kind="stable")[:, :k]
                held_s[row], held_i[row] = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_i, order, 1)
        row, rank = np.nonzero(held_i >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(held_i[row, rank]), pa.array(held_s[row, rank])], ["q", "nb", "cosine"])

    return run


def joined_parts(classes: DataFrame, routes: DataFrame, dim: int, k: int, least: float, measured: int = MEASURED) -> tuple[dict[int, int], float]:
    """Parts to be searched together (part: the least part of its group), and the recall of the index as routed.

    Measured on ``measured`` classes of least hash, a bounded sample: their neighbours by brute force over all classes,
    and whether those live in parts they visit.
    """
    spark = classes.sparkSession
    n = classes.count()
    chosen = classes.where(_hash() <= min(1.0, 3 * measured / max(n, 1)) * 2**62).orderBy(_hash(), "id").limit(measured).select("id", "v").toArrow()
    ids = chosen.column("id").to_numpy()
    x = matrix(chosen.column("v"), dim).astype(np.float64)  # near copies differ by less than single precision
    sent = spark.sparkContext.broadcast((ids, x / np.sqrt((x * x).sum(axis=1))[:, None]))
    near = classes.select("id", "v").mapInArrow(_nearest_of(sent, dim, k), "q long, nb long, cosine double").where(F.col("cosine") >= least)
    w = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "nb")
    near = cut(near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "nb"), "measured")  # at most k rows of each measured class
    lives = routes.where("resident").select("id", F.col("part").alias("at")).join(F.broadcast(near), F.col("id") == F.col("nb")).select("q", "at").collect()
    visits, home = defaultdict(set), {}
    for r in routes.select("id", "part", "resident").join(F.broadcast(near.select(F.col("q").alias("id")).distinct()), "id").collect():  # at most ``probes`` rows of each
        visits[r.id].add(r.part)
        if r.resident:
            home[r.id] = r.part
    total, missed = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in lives:
        total[home[r.q]] += 1
        if r.at not in visits[r.q]:
            missed[home[r.q]][r.at] += 1
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    for part, lost in missed.items():
        if sum(lost.values()) > (1 - RECALL) * total[part] + 1:
            for other, times in lost.items():
                if times > 0.01 * total[part]:
                    a, b = root(part), root(other)
                    up[max(a, b)] = min(a, b)
                    up.setdefault(min(a, b), min(a, b))
    lost = sum(sum(m.values()) for m in missed.values())
    return {x: root(x) for x in up}, 1 - lost / max(1, len(lives))


def visits_of(routes: DataFrame, groups: dict[int, int], part_rows: int) -> DataFrame:
    """``place, resident, id, v``: parts as they are, and all blocks of joined parts for every row that visits one of them."""
    alone = routes.select(F.col("part").alias("place"), "resident", "id", "v")
    if not groups:
        return alone
    spark = routes.sparkSession
    joined = F.broadcast(spark.createDataFrame([(a, b) for a, b in groups.items()], "part long, whole long"))  # parts with measured classes only
    rows = routes.join(joined, "part").groupBy("whole", "id").agg(F.bool_or("resident").alias("resident"), F.first("v").alias("v"))
    rows = cut(rows, "joined")
    blocks = rows.groupBy("whole").agg(F.ceil(F.count_if("resident") / part_rows).cast("int").alias("blocks"))
    each = rows.join(F.broadcast(blocks), "whole").withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    here = F.col("resident") & (F.pmod(F.xxhash64("id"), F.greatest("blocks", F.lit(1))) == F.col("block"))
    each = cut(each.select(F.xxhash64("whole", "block").alias("place"), here.alias("resident"), "id", "v"), "blocks")
    return alone.join(joined.select(F.col("part").alias("place")), "place", "left_anti").unionByName(each)


def _search(dim: int, k: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        x, ids, resident = matrix(table.column("v"), dim), table.column("id").to_numpy(), table.column("resident").to_numpy()
        order = np.lexsort((ids, ~resident))
        x, ids = np.ascontiguousarray(x[order]), ids[order]
        held, own = x[: int(resident.sum())], ids[: int(resident.sum())]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        few = min(k + 4, len(own))
        # unit vectors are ranked by distance from the part's mean: cosines of near copies differ by less than single precision
        mean = held.mean(axis=0, dtype=np.float64).astype(np.float32) if len(held) else np.float32(0)
        y = x - mean
        away = (y * y).sum(axis=1) / 2
        for i in range(0, len(x) if few else 0, 512):
            s = y[i : i + 512] @ y[: len(held)].T - away[: len(held)]
            s[ids[i : i + 512, None] == own[None, :]] = -np.inf
            best = np.argpartition(-s, few - 1, axis=1)[:, :few] if few < len(own) else np.broadcast_to(np.arange(few), (len(s), few))
            cosine = 1 + np.take_along_axis(s, best, 1) - away[i : i + 512, None]
            q, j = np.nonzero((cosine >= least - 1e-5) & np.isfinite(cosine))
            r = best[q, j]
            exact = (x[i + q].astype(np.float64) * held[r]).sum(axis=1)
            exact /= np.sqrt((x[i + q].astype(np.float64) ** 2).sum(axis=1) * (held[r].astype(np.float64) ** 2).sum(axis=1))
            o = np.lexsort((own[r], -exact, q))
            q, r, exact = q[o], r[o], exact[o]
            start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            ok = (rank < k) & (exact >= least)
            out.append((ids[i + q[ok]], own[r[ok]], exact[ok]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q": cols[0], "r": cols[1], "cosine": cols[2]})

    return run


def _first(df: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("cosine").desc(), "nb")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(df: DataFrame, row_id: str, vector: str, k: int = 5, dim: int = 72, least: float = -1.0, probes: int = PROBES, cover: float = COVER, target_rows: int = TARGET_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``id, nb, cosine, rank``: of every usable row its k most similar others; only those of cosine ``least`` or more."""
    spark = df.sparkSession
    rows = cut(units(df, row_id, vector, dim).mapInArrow(_keyed, "id long, key binary, v array<float>"), "vectors")
    classes = cut(classes_of(rows, k), "classes")
    routes = routed(classes, dim, probes, cover, target_rows, part_rows)
    groups = joined_parts(classes, routes, dim, k, least)[0] if not routes.where("part <> 0").isEmpty() else {}
    visits = shared_out(visits_of(routes, groups, part_rows), "place", "id", VISITORS * part_rows)
    found = visits.groupBy("place", "share").applyInArrow(_search(dim, k, least), "q long, r long, cosine double")
    found = cut(found, "pairs").select("q", F.col("r").alias("nb"), "cosine").distinct()
    copies = classes.where("n > 1").select(F.col("id").alias("c"), "key", "ids")
    found = _first(found, "q", k).drop("rank").join(copies.select("c", "ids"), F.col("nb") == F.col("c"), "left")
    found = found.select("q", F.explode(F.coalesce("ids", F.array("nb"))).alias("nb"), "cosine")
    found = found.unionByName(copies.select(F.col("c").alias("q"), F.explode("ids").alias("nb"), F.lit(1.0).alias("cosine")))
    found = _first(found, "q", k + 1).drop("rank")
    members = rows.select("id", "key").join(copies.select("c", "key"), "key").select("c", F.col("id").alias("m"))
    found = found.join(members, F.col("q") == F.col("c"), "left").select(F.coalesce("m", "q").alias("id"), "nb", "cosine").where("id <> nb")
    return _first(found, "id", k).select("id", "nb", "cosine", "rank")

"""Clusters and neighbours against all pairs."""

import os

import numpy as np
import pytest

from latentia.llm import clusters, neighbours
from latentia.llm.vectors import units

D = 8
SCHEMA = "id long, v array<float>, n long, piece string, cosine double"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 0.0) for i, v in rows], SCHEMA).repartition(parts)


def data(seed=0, groups=60, hot=400):
    """Tight groups of uneven sizes, a group of copies holding a large part, singles, and unusable vectors."""
    g, rows, k = np.random.default_rng(seed), [], 0
    for size in [*g.integers(1, 12, groups).tolist(), 90]:
        c = g.standard_normal(D)
        for _ in range(size):
            v = c + 0.04 * g.standard_normal(D) * np.linalg.norm(c) / D**0.5
            rows.append((k := k + 1, v * 10.0 ** g.integers(-6, 3)))
    c = g.standard_normal(D)
    rows += [(1000 + i, c) for i in range(hot)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * D), (5003, [float("nan")] * D), (5004, [1.0] * (D - 1)), (5005, [None] + [1.0] * (D - 1)), (5006, [float("inf")] + [1.0] * (D - 1))]
    return rows


def usable(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i < 5000]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    return ids, x / np.linalg.norm(x, axis=1)[:, None]


def components(ids, x, limit=0.9):
    label = dict(zip(ids.tolist(), ids.tolist()))
    s, todo = x @ x.T >= limit, True
    a = np.arange(len(ids))
    lab = ids.copy()
    while todo:
        new = np.array([lab[s[i]].min() for i in a])
        todo = (new != lab).any()
        lab = new
    label.update(zip(ids.tolist(), lab.tolist()))
    return label


@pytest.mark.parametrize("local_rows", [100, 100_000])
def test_clusters(spark, local_rows):
    rows = data()
    df = frame(spark, rows)
    got = {r.id: r.cluster_key for r in clusters.assign(df, "id", "v", dim=D, local_rows=local_rows).collect()}
    assert got == components(*usable(rows))


def test_cluster_report_and_empty(spark):
    rows = data(1, 10, 50)
    df = frame(spark, rows)
    assigned = clusters.assign(df, "id", "v", dim=D)
    rep = {r.cluster_key: r for r in clusters.report(df, "id", "v", assigned, dim=D).collect()}
    assert rep[1000].n_rows == 50 and rep[1000].dispersion == 0 and rep[1000].typical_ids == [1000, 1001, 1002]
    assert sum(r.n_rows for r in rep.values()) == len(usable(rows)[0])
    assert clusters.assign(df.limit(0), "id", "v", dim=D).count() == 0
    assert units(df, "id", "v", D).count() == len(usable(rows)[0])


def brute(ids, x, k):
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(ids)):
        order = np.lexsort((ids, -s[i]))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[i, j]) for j in order if s[i, j] > -2]
    return out


def test_neighbours_with_copies(spark):
    rows = data(2, 40, 60)
    ids, x = usable(rows)
    want = brute(ids, x, 5)
    got = {}
    for r in neighbours.nearest(frame(spark, rows), "id", "v", k=5, dim=D).collect():
        got.setdefault(r.id, []).append((r.rank, r.nb, r.cosine))
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = sorted(got[i])
        assert [c for _, _, c in g] == pytest.approx([c for _, c in w], abs=1e-5) and len({n for _, n, _ in g}) == len(g)
    hot = [n for _, n, _ in sorted(got[1030])]
    assert hot == [1000, 1001, 1002, 1003, 1004]


def test_routed_recall_and_empty(spark):
    g = np.random.default_rng(4)
    centres = g.standard_normal((150, 24))
    x = centres[g.integers(0, 150, 4000)] + 0.2 * g.standard_normal((4000, 24))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, w in brute(np.arange(4000), x, 5).items() for j, _ in w}
    got = {(r.id, r.nb) for r in neighbours.nearest(df, "id", "v", k=5, dim=24, target_rows=250, part_rows=400).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) > 0.95
    assert neighbours.nearest(df.limit(0), "id", "v", dim=24).count() == 0
    assert neighbours.nearest(df.limit(2), "id", "v", dim=24).count() == 2


def test_near_copies_are_searched_whole(spark):
    """A third of the rows differ by noise only: no network can route them, so the parts they fill are joined."""
    g = np.random.default_rng(8)
    c = g.standard_normal((200, 24))
    x = np.vstack([c[g.integers(0, 200, 2600)] + 0.2 * g.standard_normal((2600, 24)), g.standard_normal(24) + 0.001 * g.standard_normal((1400, 24))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:5]}
    got = {(r.id, r.nb) for r in neighbours.nearest(df, "id", "v", k=5, dim=24, target_rows=200, part_rows=300, probes=4).collect()}
    for part in (range(2600), range(2600, 4000)):
        mine = {w for w in want if w[0] in part}
        assert len(mine & got) / len(mine) > 0.95


def test_balanced_parts():
    g = np.random.default_rng(0)
    x = g.standard_normal((1000, 6)).astype(np.float32)
    label = neighbours.balanced_parts(neighbours.graph(x, 10), 8)
    assert set(np.bincount(label)) == {125}


def test_visitors_are_dealt_out(spark):
    rows = [(1, i, True) for i in range(3)] + [(1, 10 + i, False) for i in range(40)] + [(2, 50, True), (3, 60, False)]
    df = spark.createDataFrame(rows, "at int, row long, resident boolean")
    got = [(r.at, r.row, r.resident, r.share) for r in clusters.shared_out(df, "at", "row", 10).collect()]
    assert sorted((a, i, s) for a, i, r, s in got if r) == [(1, i, s) for i in range(3) for s in range(4)] + [(2, 50, 0)]
    assert sorted(i for _, i, r, _ in got if not r) == [*range(10, 50), 60] and {s for a, _, r, s in got if not r and a == 1} <= {0, 1, 2, 3}


def test_seeds_that_are_all_copies(spark):
    """Most rows of a leaf are copies, so that all seeds are: the other rows are no part of their cluster."""
    g = np.random.default_rng(3)
    rows = [(i, [1.0] + [0.0] * (D - 1)) for i in range(3000)]
    rows += [(4000 + i, v) for i, v in enumerate(g.standard_normal((12, D)))]
    ids, x = usable(rows)
    df = frame(spark, rows)
    got = {r.id: r.cluster_key for r in clusters.assign(df, "id", "v", dim=D, local_rows=100).collect()}
    assert got == components(ids, x)
    tree, known = clusters.upper_tree(units(df, "id", "v", D), D, 0.9, 100)
    at = tree.descend(x.astype(np.float32))
    for leaf in known:
        assert known[leaf]["low"] == pytest.approx(float((x[at == leaf] @ tree.centres[leaf]).min()), abs=1e-5)


def test_links_between_leaves_are_exact(spark):
    """Branching clusters, cut at many places and linked by any of their rows; near-copies that no task gathers are among them."""
    x = np.random.default_rng(6).standard_normal((1500, 7))
    x = np.vstack([x, x[0] + 0.01 * np.random.default_rng(7).standard_normal((400, 7))])
    rows = [(i, [*v, 0.0]) for i, v in enumerate(x)]
    got = {r.id: r.cluster_key for r in clusters.assign(frame(spark, rows), "id", "v", dim=D, local_rows=100).collect()}
    assert got == components(*usable(rows))


@pytest.mark.parametrize("group", [150, 100_000])
def test_rounds_of_pieces_and_rows(spark, group):
    """A third of the rows are near-copies cut into large pieces, more than a round takes; the others are cut at many places."""
    g = np.random.default_rng(9)
    c = g.standard_normal(D)
    x = np.vstack([g.standard_normal((900, 7)) @ np.eye(7, D), c + 0.1 * g.standard_normal((450, D))])
    rows = list(enumerate(x))
    got = {r.id: r.cluster_key for r in clusters.assign(frame(spark, rows), "id", "v", dim=D, local_rows=60, group=group).collect()}
    assert got == components(*usable(rows))


def written(spark):
    """Bytes of shuffles so far."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_vectors_stay_where_they_are(spark, monkeypatch):
    """Rows unlike one another have to be compared with nearly every leaf: what is shuffled and written must not grow as their number times the leaves."""
    dim, n = 24, 4000
    g = np.random.default_rng(5)
    x = g.standard_normal((n, dim))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    tables = []
    cut = clusters.cut

    def measured(df, what="step"):
        made = cut(df, what)
        tables.append(sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in made.inputFiles()))
        return made

    monkeypatch.setattr(clusters, "cut", measured)
    before = written(spark)
    got = {r.id: r.cluster_key for r in clusters.assign(df, "id", "v", dim=dim, local_rows=50).collect()}
    assert got == components(np.arange(n), x / np.linalg.norm(x, axis=1)[:, None])
    assert written(spark) - before + sum(tables) < 10 * x.astype(np.float32).nbytes

"""Kernels against enumeration and against one another; invariants of training."""

import itertools

import numpy as np
import pytest

from latentia.operators import chain, decode, em, params as P, treebp

SHAPES = {"chain": [2, 3, 4, 5, 0], "heap": [0, 1, 1, 2, 2], "two roots": [0, 1, 0, 3, 3]}


def model(n=3, m=4, r=1, seed=0):
    return P.random_params(n, m, r, seed)


def enumerate_tree(heads, words, rels, p):
    """Total, node posteriors, edge sums and best states over all assignments."""
    n, N = len(heads), p.n
    at = lambda a, r: a[..., min(r, a.shape[-1] - 1)]
    total, post, edges, best = 0.0, np.zeros((n, N)), np.zeros((N, N, p.T.shape[2])), (-1.0, None)
    for s in itertools.product(range(N), repeat=n):
        v = 1.0
        for i, h in enumerate(heads):
            v *= at(p.E, rels[i])[words[i], s[i]]
            if i + 1 not in heads:
                v *= at(p.pi, rels[i])[s[i]]
            v *= at(p.f, rels[i])[s[i]] if h == 0 else at(p.T, rels[h - 1])[s[h - 1], s[i]]
        total += v
        for i, h in enumerate(heads):
            post[i, s[i]] += v
            if h:
                edges[s[h - 1], s[i], min(rels[h - 1], p.T.shape[2] - 1)] += v
        if v > best[0]:
            best = (v, s)
    return np.log(total), post / total, edges / total, best[1]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("r", [1, 2])
def test_trees_against_enumeration(shape, r):
    heads, words = SHAPES[shape], [0, 3, 1, 2, 0]
    rels, p = [0, 1, 0, 1, 1] if r == 2 else [0] * 5, model(r=r, seed=r)
    fo = treebp.forest([np.array(heads)], [np.array(words)], [np.array(rels)])
    b = treebp.Beliefs(fo, p)
    ll, post, edges, best = enumerate_tree(heads, words, rels, p)
    assert np.isclose(b.ll[0], ll)
    assert np.allclose(b.descend(), post)
    assert np.allclose(b.edge_counts(), edges)
    assert treebp.Beliefs(fo, p, maximum=True).best_states().tolist() == list(best)


def test_omitted_relations_are_the_plain_model():
    heads = [np.array(SHAPES["heap"])]
    words, rels = [np.array([0, 1, 2, 3, 1])], [np.array([0, 1, 1, 0, 1])]
    p = P.random_params(3, 4, 2, 0, omit_class=True, omit_emission=True)
    a, b = treebp.Beliefs(treebp.forest(heads, words, rels), p), treebp.Beliefs(treebp.forest(heads, words), p)
    assert np.allclose(a.ll, b.ll) and np.allclose(a.descend(), b.descend())


def test_chain_is_a_tree_and_batches_do_not_matter():
    p, x = model(), np.array([[0, 3, 1, 2, 0], [1, 1, 1, 1, 1]])
    ll, gamma, xi = chain.posteriors(x, p)
    fo = treebp.forest([np.array(SHAPES["chain"])] * 2, list(x))
    b = treebp.Beliefs(fo, p)
    assert np.allclose(b.ll, ll) and np.allclose(b.descend(), gamma.reshape(-1, 3)) and np.allclose(b.edge_counts()[:, :, 0], xi)
    path, score = chain.viterbi(x, p)
    assert (treebp.Beliefs(fo, p, maximum=True).best_states() == path.ravel()).all()
    with np.errstate(divide="ignore"):
        logs = [np.log(a) for a in chain.plain(p)]
    assert np.allclose(chain.path_score(path, *logs[:3], logs[3][x]), score)
    one = chain.posteriors(x[:1], p)
    assert np.allclose(one[0], ll[:1]) and np.allclose(gamma.sum(2), 1)


def test_cycles_are_refused():
    with pytest.raises(ValueError):
        treebp.forest([np.array([2, 1])], [np.array([0, 0])])


def test_projection_keeps_mass():
    v = np.array([[0.5, 0.1, 0.3, 0.05, 0.05]])
    assert np.allclose(chain.project(v, 2), [[0.625, 0, 0.375, 0, 0]]) and chain.project(v, 0) is v


def corpus(spark, seed=3, n=300, parts=5):
    g = np.random.default_rng(seed)
    rows = [(i, [int(w) for w in g.integers(0, 4, g.integers(1, 9))]) for i in range(n)] + [(n, [])]
    return spark.createDataFrame(rows, "sent_id long, x array<long>").repartition(parts), rows


def test_em(spark):
    data, _ = corpus(spark)
    p, lls = em.em(data, model(), 6)
    assert all(b >= a - 1e-6 for a, b in zip(lls, lls[1:])) and p.sane(1e-9)
    again = em.step(data.coalesce(1), model())[0]
    other = em.step(data.repartition(13), model())[0]
    assert np.allclose(again.T, other.T, atol=1e-9) and np.allclose(again.E, other.E, atol=1e-9)
    emission = spark.createDataFrame([(w, model().E[w, :, 0].tolist()) for w in range(4)], "word_id long, v array<double>")
    q, e, joined = em.em_joined(data, model(), emission, 2)
    assert np.allclose(joined, lls[:2]) and e.count() == 4


def test_online_split_merge(spark):
    data, _ = corpus(spark)
    p, lls = em.online_em(data, model(), 1, 100, seed=1)
    assert p.sane(1e-6) and len(lls) == 4
    p, log = em.split_merge_em(data, model(2), 6, 2)
    assert p.n >= 6 and p.sane(1e-6) and log[0][0] == 2
    with pytest.raises(ValueError):
        em.merge_losses(data.withColumn("head", data.x), p)


def test_decoders(spark):
    data, rows = corpus(spark, n=40)
    p = model()
    got = {r.sent_id: r for r in decode.decode(data, p, "viterbi").collect()}
    for i, x in rows:
        assert got[i].states == (chain.viterbi(np.array([x]), p)[0][0].tolist() if x else [])
    types = {r.word_id: r for r in decode.type_posteriors(data, p).collect()}
    want = defaultdict_mean([(w, v) for _, x in rows if x for w, v in zip(x, chain.posteriors(np.array([x]), p)[1][0])])
    assert all(np.allclose(types[w].rep, v) for w, v in want.items())
    with pytest.raises(ValueError):
        decode.decode(data, p, "unknown")


def defaultdict_mean(pairs):
    out = {}
    for w, v in pairs:
        out.setdefault(w, []).append(v)
    return {w: np.mean(v, axis=0) for w, v in out.items()}


def test_param_tables(spark):
    p = model(4, 5, 2)
    t = P.to_table(spark, p)
    assert P.unbalanced(t).count() == 0
    q = P.from_table(P.merge(P.split(t), spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(4)], "keep long, gone long")))
    keep = slice(0, 8, 2)
    joint = 2 * p.T.sum(0) + p.f  # a split doubles the rows of transitions, not the final probabilities
    assert np.allclose(q.pi[keep], p.pi) and np.allclose(q.T[keep, keep], 2 * p.T / joint) and np.allclose(q.E[:, keep], p.E)
    a = P.split_arrays(p, 0.0)
    b = P.merge_arrays(a, [(2 * i, 2 * i + 1) for i in range(4)])
    assert np.allclose(b.T, 2 * p.T / joint) and np.allclose(b.pi, p.pi) and np.allclose(b.E, p.E) and np.allclose(b.f, p.f / joint)


def test_additive_scores_against_enumeration():
    g = np.random.default_rng(2)
    pi, T, f, e = g.normal(0, 3, 3), g.normal(0, 3, (3, 3)), g.normal(0, 3, 3), g.normal(0, 3, (1, 4, 3))
    scores, post = {}, np.zeros((4, 3))
    for s in itertools.product(range(3), repeat=4):
        scores[s] = chain.path_score(np.array([s]), pi, T, f, e)[0]
    z = np.log(sum(np.exp(v) for v in scores.values()))
    for s, v in scores.items():
        for t, k in enumerate(s):
            post[t, k] += np.exp(v - z)
    ll, gamma = chain.additive_posteriors(pi, T, f, e)
    assert np.isclose(ll[0], z) and np.allclose(gamma[0], post)
    path, best = chain.best_path(pi, T, f, e)
    assert tuple(path[0]) == max(scores, key=scores.get) and np.isclose(best[0], max(scores.values()))


def test_approximation_is_exact_for_few_states():
    p, x = model(7), np.array([[0, 1, 2, 3]])
    assert np.allclose(chain.posteriors(x, p, approx=True)[1], chain.posteriors(x, p)[1])
    q = model(16)
    assert chain.posteriors(x, q, approx=True)[1].shape == (1, 4, 16)


def test_stream_is_restartable(spark, tmp_path):
    """A stream that is stopped goes on from the state its batches wrote, in a new call, and equals one uninterrupted run."""
    import shutil

    from latentia.plans.model_queries import fixed
    from latentia.streaming import online

    rows = [(i, i % 7, online.SYMBOLS[(i * i + i // 7) % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(event_id) ts", "user_id", "event_type")
    for k in range(3):
        df.where(f"event_id % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    src, at = tmp_path / "src", tmp_path / "at"
    src.mkdir()

    def add(k):
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            shutil.copy(f, src / f"e{k}.parquet")

    add(0)
    online.train_stream(spark, str(src), "*.parquet", fixed(), at=f"file://{at}")
    add(1)
    online.train_stream(spark, str(src), "*.parquet", fixed(), at=f"file://{at}")
    add(2)
    p, lls = online.train_stream(spark, str(src), "*.parquet", fixed(), at=f"file://{at}")
    q, want = fixed(), []
    for k in range(3):
        new, ll = em.step(online.sequences(df.where(f"event_id % 3 = {k}")), q)
        q = em.blended(q, new, (k + 4) ** -0.5)
        want.append(ll)
    assert lls == pytest.approx(want) and np.allclose(p.T, q.T) and np.allclose(p.E, q.E)


def test_branching_backward_and_ties():
    from latentia.operators.introspect import _best

    g = np.random.default_rng(1)
    s, i = np.round(g.random((5, 40)), 1), np.broadcast_to(g.permutation(40), (5, 40))
    a, b = _best(s, i, 7)
    for r in range(5):
        order = np.lexsort((i[r], -s[r]))[:7]
        assert (a[r] == s[r][order]).all() and (b[r] == i[r][order]).all()

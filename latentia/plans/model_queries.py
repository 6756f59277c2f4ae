"""Latent-state models: queries and SQL. Fixed parameters are co-prime fractions, so best paths have no exact ties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from latentia.operators import corpus as C, decode as D, em as E, params as P, perceptron as PC, trees
from latentia.plans import model_sql as S
from latentia.plans.corpus_queries import _NODES, nodes, toks
from latentia.plans.rep_queries import TAGS, baseline
from latentia.session import table
from latentia.sources import examples
from latentia.streaming import online

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SYMBOLS = online.SYMBOLS
PI, FINAL = (53, 44), (9, 7)
TRANS = ((41, 31), (47, 59))  # [state][previous state]
EMIT = ((37, 13), (11, 29), (23, 7), (17, 31), (9, 17))  # [symbol][state]
UNIT = 97
LEVELS = 48


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fixed() -> P.Params:
    a = lambda x: np.array(x, np.float64)[..., None] / UNIT
    return P.Params(a(PI), a(TRANS), a(FINAL), a(EMIT))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """One sequence of event types per user, in order of time."""
    return online.sequences(table(spark, d, "events"))


def chain_trees(spark: SparkSession, d: str) -> DataFrame:
    """The same sequences as chain-shaped trees: each token's head is the next, the last one's the root."""
    head = F.transform("x", lambda _, i: F.when(i == F.size("x") - 1, 0).otherwise(i + 2).cast("int"))
    return observations(spark, d).select("sent_id", head.alias("head"), "x", F.transform("x", lambda _: F.lit(0)).alias("rel"))


def real_trees(spark: SparkSession, d: str, with_rel: bool = False) -> DataFrame:
    """Parsed sentences whose heads form a tree; words by the length of their form."""
    n = nodes(spark, d)
    good = trees.acyclic(n).where("acyclic").select("sent_id")
    n = n.join(good, "sent_id", "left_semi").withColumn("word_id", F.length("form") % 5).withColumn("r", F.when(F.col("rel") == "NMOD", 1).when(F.col("rel") == "SBJ", 2).otherwise(0))
    return E.as_trees(n, "word_id", "r" if with_rel else None)


def _l(n: int) -> str:
    return f"ln({n}::DOUBLE / {UNIT}::DOUBLE)"


def _lse(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(exp(({a}) - greatest({a}, {b})) + exp(({b}) - greatest({a}, {b}))))"


_EM = f"em(sym, e0, e1) as (values {', '.join(f'({k}, {_l(a)}, {_l(b)})' for k, (a, b) in enumerate(EMIT))})"
_OBS = f"""obs as (select user_id sent_id, row_number() over w - 1 pos, count(*) over (partition by user_id) len, list_position([{', '.join(f"'{s}'" for s in SYMBOLS)}], event_type) - 1 sym from events window w as (partition by user_id order by ts, event_id)),
{_EM}, o as (select obs.*, e0, e1 from obs join em using (sym))"""
_T = [[_l(v) for v in row] for row in TRANS]
_F = [_l(v) for v in FINAL]
_FWD = f"""fwd(sent_id, pos, len, a0, a1) as (select sent_id, pos, len, e0 + {_l(PI[0])}, e1 + {_l(PI[1])} from o where pos = 0
union all select o.sent_id, o.pos, o.len, e0 + {_lse(f'a0 + {_T[0][0]}', f'a1 + {_T[0][1]}')}, e1 + {_lse(f'a0 + {_T[1][0]}', f'a1 + {_T[1][1]}')} from fwd f join o on o.sent_id = f.sent_id and o.pos = f.pos + 1)"""
_BWD = f"""bwd(sent_id, pos, b0, b1, e0, e1) as (select sent_id, pos, {_F[0]}, {_F[1]}, e0, e1 from o where pos = len - 1
union all select o.sent_id, o.pos, {_lse(f'b0 + b.e0 + {_T[0][0]}', f'b1 + b.e1 + {_T[1][0]}')}, {_lse(f'b0 + b.e0 + {_T[0][1]}', f'b1 + b.e1 + {_T[1][1]}')}, o.e0, o.e1 from bwd b join o on o.sent_id = b.sent_id and o.pos = b.pos - 1)"""
_LL = f"ll as (select sent_id, {_lse(f'a0 + {_F[0]}', f'a1 + {_F[1]}')} ll from fwd where pos = len - 1)"
_HMM = f"with recursive {_OBS}, {_FWD}, {_BWD}, {_LL}"
_GAMMA = "g as (select f.sent_id, f.pos, f.len, exp(a0 + b0 - ll) g0, exp(a1 + b1 - ll) g1 from fwd f join bwd b using (sent_id, pos) join ll using (sent_id))"
_XI = f"""xi as (select i, j, sum(v) v from (select unnest([0, 0, 1, 1]) i, unnest([0, 1, 0, 1]) j, unnest([exp(a0 + {_T[0][0]} + b.e0 + b0 - ll), exp(a1 + {_T[0][1]} + b.e0 + b0 - ll), exp(a0 + {_T[1][0]} + b.e1 + b1 - ll), exp(a1 + {_T[1][1]} + b.e1 + b1 - ll)]) v
from fwd f join bwd b on b.sent_id = f.sent_id and b.pos = f.pos + 1 join ll on ll.sent_id = f.sent_id) group by 1, 2)"""


@query(f"{_HMM} select sent_id, round(ll, 6) ll from ll")
def hmm_forward(spark, d):
    return D.decode(observations(spark, d), fixed(), "posterior").select("sent_id", F.round("score", 6).alias("ll"))


@query(f"{_HMM} select sent_id, round({_lse(f'b0 + e0 + {_l(PI[0])}', f'b1 + e1 + {_l(PI[1])}')}, 6) ll from bwd where pos = 0")
def hmm_backward(spark, d):
    """The log-likelihood from the other end: a backward pass of its own, without a forward pass."""
    return D.backward_scores(observations(spark, d), fixed()).select("sent_id", F.round("score", 6).alias("ll"))


def _reps(df: DataFrame) -> DataFrame:
    return df.select("sent_id", F.posexplode("reps").alias("pos", "r")).select("sent_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("r")[0], 6).alias("p0"), F.round(F.col("r")[1], 6).alias("p1"))


@query(f"{_HMM}, {_GAMMA} select sent_id, pos, round(g0, 6) p0, round(g1, 6) p1 from g")
def hmm_posterior(spark, d):
    return _reps(D.decode(observations(spark, d), fixed(), "posterior_cont"))


@query(f"{_HMM}, {_XI} select i, j, round(v, 4) v from xi")
def hmm_transition_counts(spark, d):
    rows = E.expected_counts(observations(spark, d), fixed()).where("kind = 'trans'")
    return rows.select(F.col("key").cast("int").alias("i"), F.posexplode("vals").alias("j", "v")).select("i", "j", F.round("v", 4).alias("v"))


_VIT = f"""vit(sent_id, pos, len, d0, d1, b0, b1) as (select sent_id, pos, len, e0 + {_l(PI[0])}, e1 + {_l(PI[1])}, 0, 0 from o where pos = 0
union all select o.sent_id, o.pos, o.len, e0 + greatest(d0 + {_T[0][0]}, d1 + {_T[0][1]}), e1 + greatest(d0 + {_T[1][0]}, d1 + {_T[1][1]}), (d1 + {_T[0][1]} > d0 + {_T[0][0]})::INT, (d1 + {_T[1][1]} > d0 + {_T[1][0]})::INT
from vit v join o on o.sent_id = v.sent_id and o.pos = v.pos + 1),
walk(sent_id, pos, state, back) as (select sent_id, pos, (d1 + {_F[1]} > d0 + {_F[0]})::INT, case when d1 + {_F[1]} > d0 + {_F[0]} then b1 else b0 end from vit where pos = len - 1
union all select v.sent_id, v.pos, w.back, case when w.back = 1 then v.b1 else v.b0 end from walk w join vit v on v.sent_id = w.sent_id and v.pos = w.pos - 1)"""


def _states(df: DataFrame) -> DataFrame:
    return df.select("sent_id", F.posexplode("states").alias("pos", "state")).select("sent_id", F.col("pos").cast("long").alias("pos"), "state")


@query(f"with recursive {_OBS}, {_VIT} select sent_id, pos, state from walk")
def hmm_viterbi(spark, d):
    return _states(D.decode(observations(spark, d), fixed(), "viterbi"))


@query(f"with recursive {_OBS}, {_VIT} select sent_id, round(greatest(d0 + {_F[0]}, d1 + {_F[1]}), 6) score from vit where pos = len - 1")
def hmm_viterbi_score(spark, d):
    return D.decode(observations(spark, d), fixed(), "viterbi").select("sent_id", F.round("score", 6).alias("score"))


@query(f"with {_OBS} select sent_id, pos, (e1 > e0)::INT state from o")
def hmm_max_emission(spark, d):
    return _states(D.decode(observations(spark, d), fixed(), "max-emission"))


def _param_rows(spark, p: P.Params) -> DataFrame:
    return P.to_table(spark, p).select("param", "i", "j", F.round("v", 6).alias("v"))


_STEP = f"""{_HMM}, {_GAMMA}, {_XI}, s as (select 1e-8::DOUBLE s),
cnt as (select 'init' param, 0 i, 0 j, sum(g0) v from g where pos = 0 union all select 'init', 1, 0, sum(g1) from g where pos = 0
union all select 'final', 0, 0, sum(g0) from g where pos = len - 1 union all select 'final', 0, 1, sum(g1) from g where pos = len - 1
union all select 'trans', i, j, v from xi
union all select 'emit', sym, 0, sum(g0) from g join obs using (sent_id, pos) group by sym union all select 'emit', sym, 1, sum(g1) from g join obs using (sent_id, pos) group by sym),
grp as (select *, v + s w, case when param in ('trans', 'final') then 'out' else param end q, case when param = 'init' then 0 else j end k from cnt, s)"""


@query(f"{_STEP} select param, i::BIGINT i, j::BIGINT j, round(w / sum(w) over (partition by q, k), 6) v from grp")
def em_one_step(spark, d):
    """One batch step from the fixed parameters; smoothing added once."""
    return _param_rows(spark, E.step(observations(spark, d), fixed())[0])


_OCC = "occ as (select sum(g0) / (sum(g0) + sum(g1)) w from g)"


@query(f"{_HMM}, {_GAMMA}, {_OCC} select 0::INT pair, round(sum(ln((exp(a0 - m) + exp(a1 - m)) * (w * exp(b0 - (ll - m)) + (1 - w) * exp(b1 - (ll - m))))), 4) loss from (select *, greatest(a0, a1) m from fwd) f join bwd b using (sent_id, pos) join ll using (sent_id), occ")
def merge_loss(spark, d):
    losses = E.merge_losses(observations(spark, d), fixed())
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(losses)], "pair int, loss double")


@query(f"{_HMM}, {_GAMMA} select sym::BIGINT word_id, round(avg(g0), 6) p0, round(avg(g1), 6) p1, count(*) n from g join obs using (sent_id, pos) group by sym")
def type_posteriors(spark, d):
    t = D.type_posteriors(observations(spark, d), fixed())
    return t.select("word_id", F.round(F.col("rep")[0], 6).alias("p0"), F.round(F.col("rep")[1], 6).alias("p1"), "n")


@query(f"{_HMM}, {_GAMMA}, t as (select sym, avg(g0) p0, avg(g1) p1 from g join obs using (sent_id, pos) group by sym) select sent_id, pos, round(p0, 6) p0, round(p1, 6) p1 from obs join t using (sym)")
def type_decode(spark, d):
    data = observations(spark, d)
    rows = D.type_decode(data, D.type_posteriors(data, fixed()))
    return rows.select("sent_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("rep")[0], 6).alias("p0"), F.round(F.col("rep")[1], 6).alias("p1"))


@query(f"{_HMM} select sent_id, round(ll, 6) ll from ll")
def tree_chain_ll(spark, d):
    """A chain-shaped tree is a sequence."""
    return D.decode(chain_trees(spark, d), fixed(), "posterior").select("sent_id", F.round("score", 6).alias("ll"))


@query(f"{_HMM}, {_GAMMA} select sent_id, pos, round(g0, 6) p0, round(g1, 6) p1 from g")
def tree_posterior(spark, d):
    return _reps(D.decode(chain_trees(spark, d), fixed(), "posterior_cont"))


@query(f"with recursive {_OBS}, {_VIT} select sent_id, pos, state from walk")
def tree_maxproduct(spark, d):
    return _states(D.decode(chain_trees(spark, d), fixed(), "max-product"))


@query(f"{_STEP} select param, i::BIGINT i, j::BIGINT j, round(w / sum(w) over (partition by q, k), 6) v from grp")
def tree_em_step(spark, d):
    return _param_rows(spark, E.step(chain_trees(spark, d), fixed())[0])


_REACH = f"""{_NODES}, reach(sent_id, idx, depth) as (select sent_id, idx, 1 from nodes where head = 0 union all select n.sent_id, n.idx, depth + 1 from nodes n join reach r on n.sent_id = r.sent_id and n.head = r.idx where depth < {LEVELS}),
full_s as (select sent_id from nodes left join reach using (sent_id, idx) group by sent_id having count(*) = max(idx) and count(depth) = count(*)),
{_EM}, tn as materialized (select n.sent_id, n.idx, n.head, depth, e0, e1 from nodes n join full_s using (sent_id) join reach using (sent_id, idx) join em on em.sym = length(form) % 5)"""


def _levels() -> str:
    parts = [f"u{LEVELS + 1} as (select null::BIGINT sent_id, null::INT parent, 0::DOUBLE m0, 0::DOUBLE m1, 0::DOUBLE t where false)"]
    for k in range(LEVELS, 0, -1):
        parts.append(f"""b{k} as (select n.sent_id, n.head, e0 + coalesce(c0, {_l(PI[0])}) b0, e1 + coalesce(c1, {_l(PI[1])}) b1 from tn n left join (select sent_id, parent, sum(m0) c0, sum(m1) c1 from u{k + 1} group by 1, 2) c on c.sent_id = n.sent_id and c.parent = n.idx where depth = {k}),
u{k} as materialized (select sent_id, head parent, {_lse(f'b0 + {_T[0][0]}', f'b1 + {_T[0][1]}')} m0, {_lse(f'b0 + {_T[1][0]}', f'b1 + {_T[1][1]}')} m1, {_lse(f'b0 + {_F[0]}', f'b1 + {_F[1]}')} t from b{k})""")
    return ", ".join(parts)


@query(f"with recursive {_REACH}, {_levels()} select sent_id, round(sum(t), 6) ll from u1 group by sent_id")
def tree_up_ll(spark, d):
    """Upward pass over the parsed sentences."""
    return D.decode(real_trees(spark, d), fixed(), "posterior").select("sent_id", F.round("score", 6).alias("ll"))


_RNODES = f"""{_NODES}, reach(sent_id, idx, depth) as (select sent_id, idx, 1 from nodes where head = 0 union all select n.sent_id, n.idx, depth + 1 from nodes n join reach r on n.sent_id = r.sent_id and n.head = r.idx where depth < {LEVELS}),
full_s as (select sent_id from nodes left join reach using (sent_id, idx) group by sent_id having count(*) = max(idx) and count(depth) = count(*)),
sn as materialized (select n.sent_id, n.idx, n.head, depth, (length(form) % 5)::INT sym, 0 rel from nodes n join full_s using (sent_id) join reach using (sent_id, idx)),
rn as materialized (select n.sent_id, n.idx, n.head, depth, (length(form) % 5)::INT sym, case n.rel when 'NMOD' then 1 when 'SBJ' then 2 else 0 end rel from nodes n join full_s using (sent_id) join reach using (sent_id, idx))"""


def _of(p: P.Params, table: str, maximum: bool = False) -> str:
    return f"with recursive {_RNODES}, {S.trees(p, table, LEVELS, maximum)}"


@query(f"{_of(fixed(), 'sn')} select sent_id, (idx - 1)::BIGINT pos, round(p0, 6) p0, round(p1, 6) p1 from post")
def branching_posterior(spark, d):
    """Node posteriors of parsed sentences, upward and downward."""
    return _reps(D.decode(real_trees(spark, d), fixed(), "posterior_cont"))


@query(f"{_of(fixed(), 'sn', True)} select sent_id, (idx - 1)::BIGINT pos, state from best")
def branching_maxproduct(spark, d):
    return _states(D.decode(real_trees(spark, d), fixed(), "max_product"))


@query(f"{_of(fixed(), 'sn')}, {S.tree_step(fixed(), 'sn')}")
def branching_em_step(spark, d):
    """One EM step on parsed sentences."""
    return _param_rows(spark, E.step(real_trees(spark, d), fixed())[0])


def relational() -> P.Params:
    g = np.random.default_rng(5)
    return P.normalized_arrays(g.random((2, 3)) + 0.2, g.random((2, 2, 3)) + 0.2, g.random((2, 3)) + 0.2, g.random((5, 2, 3)) + 0.2)


@query(f"{_of(relational(), 'rn')} select sent_id, (idx - 1)::BIGINT pos, round(p0, 6) p0, round(p1, 6) p1 from post")
def reltree_posterior(spark, d):
    return _reps(D.decode(real_trees(spark, d, True), relational(), "posterior_cont"))


@query(f"{_of(relational(), 'rn', True)} select sent_id, (idx - 1)::BIGINT pos, state from best")
def reltree_maxproduct(spark, d):
    return _states(D.decode(real_trees(spark, d, True), relational(), "max_product"))


@query(f"{_of(relational(), 'rn')} select round(sum(ll) / 1000, 6) ll from tot")
def reltree_ll(spark, d):
    """Log-likelihood of all parsed sentences, in thousands."""
    return D.decode(real_trees(spark, d, True), relational(), "posterior").agg(F.round(F.sum("score") / 1000, 6).alias("ll"))


@query(f"{_of(relational(), 'rn')}, t as (select sym, post.rel, p0, p1 from post join rn using (sent_id, idx)) select sym::BIGINT word_id, rel, round(avg(p0), 6) p0, round(avg(p1), 6) p1, count(*) n from t group by 1, 2")
def reltree_types(spark, d):
    """Mean posterior per word and relation."""
    t = D.type_posteriors(real_trees(spark, d, True), relational(), by_rel=True)
    return t.select("word_id", "rel", F.round(F.col("rep")[0], 6).alias("p0"), F.round(F.col("rep")[1], 6).alias("p1"), "n")


@query(f"{_of(relational(), 'rn')}, t as (select sym, p0, p1 from post join rn using (sent_id, idx)) select sym::BIGINT word_id, round(avg(p0), 6) p0, round(avg(p1), 6) p1, count(*) n from t group by 1")
def reltree_types_cumulative(spark, d):
    """Mean posterior per word over all its relations."""
    t = D.type_posteriors(real_trees(spark, d, True), relational())
    return t.select("word_id", F.round(F.col("rep")[0], 6).alias("p0"), F.round(F.col("rep")[1], 6).alias("p1"), "n")


@query(f"{_of(relational(), 'rn')}, t as (select sym, post.rel, avg(p0) p0, avg(p1) p1 from post join rn using (sent_id, idx) group by 1, 2) select sent_id, (idx - 1)::BIGINT pos, round(p0, 6) p0, round(p1, 6) p1 from rn join t using (sym, rel)")
def reltree_type_decode(spark, d):
    """Each node gets the mean of its word and relation."""
    data = real_trees(spark, d, True)
    rows = D.type_decode(data, D.type_posteriors(data, relational(), by_rel=True), by_rel=True)
    return rows.select("sent_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("rep")[0], 6).alias("p0"), F.round(F.col("rep")[1], 6).alias("p1"))


@query(f"{_of(relational(), 'rn')} select post.sent_id, (idx - 1)::BIGINT pos, case when rn.rel <> 1 then (p1 > p0)::INT else -1 end state from post join rn using (sent_id, idx)")
def reltree_ignore(spark, d):
    """States by posterior; nodes of one relation get none (here -1)."""
    return _states(D.decode(real_trees(spark, d, True), relational(), "posterior", ignore_rel=1)).withColumn("state", F.coalesce("state", F.lit(-1)))


def sentences(spark, d) -> tuple[DataFrame, int]:
    """Corpus lines as word ids over the whole vocabulary."""
    t = toks(spark, d)
    vocab = C.ranked(C.frequencies(t))
    return E.as_sequences(C.with_ids(t, vocab)), vocab.count()


_ARRAYS = ([v / UNIT for v in PI], [[v / UNIT for v in r] for r in TRANS], [v / UNIT for v in FINAL], [[v / UNIT for v in r] for r in EMIT])
_SYM = f"obs as materialized (select user_id sent_id, row_number() over w - 1 pos, count(*) over (partition by user_id) len, list_position([{', '.join(f"'{s}'" for s in SYMBOLS)}], event_type) - 1 sym from events window w as (partition by user_id order by ts, event_id))"
_TWO = f"with recursive {_SYM}, {S.parameters(1, *_ARRAYS)}, {S.step(1)}, {S.step(2)}, {S.likelihood(3)}"
_LLS = " union all ".join(f"select {k - 1} as iteration, round(ll, 3) ll from tot{k}" for k in (1, 2, 3))


@query(f"{_TWO} {_LLS}")
def em_steps(spark, d):
    """Log-likelihoods before each of three batch steps."""
    lls = E.em(observations(spark, d), fixed(), 3)[1]
    return _lls(spark, lls).withColumn("ll", F.round("ll", 3))


@query(f"{_TWO} {S.rows_of(3)}")
def em_two_steps(spark, d):
    """Parameters after two batch steps."""
    return _param_rows(spark, E.em(observations(spark, d), fixed(), 2)[0])


@query(f"{_TWO} {_LLS}")
def em_joined_steps(spark, d):
    """The same log-likelihoods with the emissions as a joined table."""
    p = fixed()
    emission = spark.createDataFrame([(w, [float(v) for v in p.E[w, :, 0]]) for w in range(len(EMIT))], "word_id long, v array<double>")
    return _lls(spark, E.em_joined(observations(spark, d), p, emission, 3)[2]).withColumn("ll", F.round("ll", 3))


#: Additive scores of a linear model; no probabilities.
_LINEAR = ([0.5, -0.25], [[0.75, -0.5], [-1.0, 0.25]], [0.125, -0.375], [[1.5, -0.5], [-0.75, 0.5], [0.25, 0.625], [-0.125, 0.875], [0.375, -1.25]])
_EXP = [np.exp(np.array(a)).tolist() for a in _LINEAR]


@query(f"with recursive {_SYM}, {S.parameters(1, *_EXP)}, {S.step(1)} select sent_id, pos, round(g0, 6) p0, round(g1, 6) p1 from g1")
def linear_posteriors(spark, d):
    """Posteriors of a sequence classifier with additive scores."""
    return _reps(D.additive_decode(observations(spark, d), *map(np.array, _LINEAR), "posterior_cont"))


@query(f"with recursive {_SYM}, {S.parameters(1, *_EXP)}, {S.likelihood(1)} select sent_id, round(ll, 6) z from ll1")
def linear_partition(spark, d):
    """Log partition sums of the same classifier."""
    return D.additive_decode(observations(spark, d), *map(np.array, _LINEAR), "posterior_cont").select("sent_id", F.round("score", 6).alias("z"))


@query(f"with recursive {_OBS}, {_VIT} select sent_id, pos, state from walk")
def linear_viterbi(spark, d):
    """Best paths under additive scores, here the logarithms of the fixed parameters."""
    logs = [np.log(np.array(a)) for a in _ARRAYS]
    return _states(D.additive_decode(observations(spark, d), *logs))


# two equal states in the place of one weigh twice against the end of a sequence: the joint sums grow by the transitions
_DOUBLE = f"""{S.parameters(1, *_ARRAYS)}, ds as (select *, 2 * (exp(t00) + exp(t10)) + exp(f0) s0, 2 * (exp(t01) + exp(t11)) + exp(f1) s1 from par1),
par2 as (select pi0, pi1, ln(2 * exp(t00) / s0) t00, ln(2 * exp(t01) / s1) t01, ln(2 * exp(t10) / s0) t10, ln(2 * exp(t11) / s1) t11, ln(exp(f0) / s0) f0, ln(exp(f1) / s1) f1 from ds), em2 as (select * from em1)"""


@query(f"with recursive {_SYM}, {_DOUBLE}, {S.likelihood(2)} select round(ll, 4) ll from tot2")
def split_likelihood(spark, d):
    """The likelihood after every state was split in two equal ones."""
    lls = E.em(observations(spark, d), P.split_arrays(fixed(), 0.0), 1)[1]
    return spark.createDataFrame([(round(float(lls[0]), 4),)], "ll double")


@query(f"with {_DOUBLE} {S.rows_of(2)}")
def split_and_merged(spark, d):
    """Parameters after all states were split and merged again."""
    return _param_rows(spark, P.merge_arrays(P.split_arrays(fixed(), 0.0), [(0, 1), (2, 3)]))


@query("select unnest([0, 1])::INT pair, 0.0::DOUBLE loss")
def merge_losses_split(spark, d):
    """Merging states that are equal loses nothing: one loss for each of two pairs."""
    losses = E.merge_losses(observations(spark, d), P.split_arrays(fixed(), 0.0))
    return spark.createDataFrame([(i, abs(round(float(v), 4))) for i, v in enumerate(losses)], "pair int, loss double")


_TOY = "obs as (select * from (values (1, 0, 4, 0), (1, 1, 4, 0), (1, 2, 4, 1), (1, 3, 4, 2), (2, 0, 4, 0), (2, 1, 4, 0), (2, 2, 4, 1), (2, 3, 4, 2), (3, 0, 4, 0), (3, 1, 4, 1), (3, 2, 4, 1), (3, 3, 4, 2)) t(sent_id, pos, len, sym))"


@query(f"with recursive {_TOY}, {S.parameters(1, *_ARRAYS)}, {S.step(1)} select sent_id::BIGINT sent_id, pos::BIGINT pos, round(g0, 6) p0, round(g1, 6) p1 from g1")
def toy_sequences(spark, d):
    """Posteriors of the toy sequences."""
    toks = examples.sequences(spark).join(examples.vocabulary(spark).withColumnRenamed("id", "word_id"), "word")
    return _reps(D.decode(E.as_sequences(toks), fixed(), "posterior_cont"))


@query(f"with recursive toy as (select * from (values (1, 1, 0, 1, 0, 0), (1, 2, 1, 2, 1, 0), (1, 3, 2, 3, 2, 0), (2, 1, 0, 1, 3, 0), (2, 2, 1, 2, 0, 0), (2, 3, 2, 3, 1, 0)) t(sent_id, idx, head, depth, sym, rel)), {S.trees(fixed(), 'toy', 3)} select sent_id::BIGINT sent_id, (idx - 1)::BIGINT pos, round(p0, 6) p0, round(p1, 6) p1 from post")
def toy_trees(spark, d):
    """Posteriors of the toy trees."""
    words = F.array_position(F.array(*[F.lit(w) for w in ("write", "code", "that", "don't")]), F.col("word")) - 1
    return _reps(D.decode(E.as_trees(examples.trees(spark).withColumn("word_id", words), "word_id"), fixed(), "posterior_cont"))


_BATCH = 64
_ONLINE = f"""with recursive {_SYM}, obs1 as (select * from obs where sent_id // {_BATCH} = (select min(sent_id // {_BATCH}) from obs)),
obs2 as (select * from obs where sent_id // {_BATCH} = (select min(sent_id // {_BATCH}) + 1 from obs)),
{S.parameters(1, *_ARRAYS)}, {S.step(1, 'obs1', P.step_size(0, 4, 0.5))}, {S.likelihood(2, 'obs2')}"""


@query(f"{_ONLINE} select 0 as iteration, round(ll, 4) ll from tot1 union all select 1, round(ll, 4) from tot2 where ll is not null")
def online_steps(spark, d):
    """Log-likelihoods of the first two mini-batches of online training."""
    data = observations(spark, d).withColumn("sent_id", F.col("sent_id") + 1)  # users count from 0
    lls = E.online_em(data, fixed(), batch_size=_BATCH)[1]
    return _lls(spark, lls[:2]).withColumn("ll", F.round("ll", 4))


def _lls(spark, lls) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(lls)], "iteration int, ll double")


@query()
def em_full(spark, d):
    """Batch training of eight states on all lines: log-likelihoods before each step."""
    data, m = sentences(spark, d)
    return _lls(spark, E.em(data, P.random_params(8, m, seed=1), 4)[1])


@query()
def em_emissions_joined(spark, d):
    """The same with the emissions as a joined table."""
    data, m = sentences(spark, d)
    p = P.random_params(4, m, seed=1)
    emission = spark.createDataFrame([(w, [float(v) for v in p.E[w, :, 0]]) for w in range(m)], "word_id long, v array<double>")
    return _lls(spark, E.em_joined(data, p, emission, 2)[2])


@query()
def em_trees(spark, d):
    """Relational trees: batch training on the parsed sentences."""
    return _lls(spark, E.em(real_trees(spark, d, True), relational(), 4)[1])


@query()
def online_em(spark, d):
    data, m = sentences(spark, d)
    n = data.count()
    return _lls(spark, E.online_em(data, P.random_params(8, m, seed=1), batch_size=max(1000, -(-n // 6)))[1])


@query()
def splitmerge(spark, d):
    data, m = sentences(spark, d)
    _, log = E.split_merge_em(data, P.random_params(2, m, seed=1), 8, max_iter=2)
    return spark.createDataFrame([(i, n, float(ll)) for i, (n, ll) in enumerate(log)], "step int, n_states int, ll double")


@query()
def perceptron_ner(spark, d):
    """Averaged perceptron over baseline features: token accuracy and entity accuracy on held-out sentences."""
    f = baseline(spark, d)
    rows = PC.as_sentences(f)
    held_out = F.pmod(F.xxhash64("sent_id"), F.lit(5)) == 0
    w = PC.train(rows.where(~held_out), TAGS, epochs=2)
    got = PC.predict(rows.where(held_out), w, TAGS)
    return got.agg(F.count("*").alias("n_tokens"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("gold") != "O", (F.col("gold") == F.col("pred")).cast("int"))), 6).alias("entity_accuracy"))


@query(f"with recursive {_SYM}, {S.parameters(1, *_ARRAYS)}, {S.step(1, 'obs', P.step_size(0, 4, 0.5))} {S.rows_of(2)}")
def stream_online_em(spark, d):
    """Online training from a file stream of events."""
    return _param_rows(spark, online.train_stream(spark, d, "events.parquet", fixed())[0])


@query("select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') window_start, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def stream_hourly_counts(spark, d):
    """Hourly tumbling counts of an event stream, drained once."""
    return online.hourly_counts(spark, d, "events.parquet")

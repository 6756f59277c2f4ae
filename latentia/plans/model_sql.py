"""SQL of latent-state models: forward and backward passes, EM steps and belief propagation, unrolled by step and level."""

from __future__ import annotations

import numpy as np

_COLS = ("pi0", "pi1", "t00", "t01", "t10", "t11", "f0", "f1")


def lse(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(exp(({a}) - greatest({a}, {b})) + exp(({b}) - greatest({a}, {b}))))"


def parameters(k: int, pi, T, f, E) -> str:
    """Parameters of two states as one row, and emissions by symbol."""
    row = [*pi, *T[0], *T[1], *f]
    return f"""par{k}({', '.join(_COLS)}) as (select {', '.join(f'ln({v!r}::DOUBLE)' for v in row)}),
em{k}(sym, e0, e1) as (values {', '.join(f'({i}, ln({float(a)!r}::DOUBLE), ln({float(b)!r}::DOUBLE))' for i, (a, b) in enumerate(E))})"""


def step(k: int, obs: str = "obs", eta: float = 1.0, smoothing: float = 1e-8) -> str:
    """One EM step on chains ``obs(sent_id, pos, len, sym)``: from par{k}, em{k} to par{k+1}, em{k+1}; tot{k}(ll)."""
    d = f"p{k}, em{k}"
    t = lambda i, j: f"t{i}{j}"
    blend = (lambda old, new: f"ln({new})") if eta == 1 else lambda old, new: f"ln({1 - eta!r}::DOUBLE * exp({old}) + {eta!r}::DOUBLE * ({new}))"
    return f"""p{k} as (select * from par{k}),
o{k} as (select o.sent_id, o.pos, o.len, o.sym, e0, e1 from {obs} o join em{k} using (sym)),
fwd{k}(sent_id, pos, len, a0, a1) as (select sent_id, pos, len, e0 + pi0, e1 + pi1 from o{k}, p{k} where pos = 0
union all select o.sent_id, o.pos, o.len, o.e0 + {lse('a0 + t00', 'a1 + t01')}, o.e1 + {lse('a0 + t10', 'a1 + t11')} from fwd{k} f join o{k} o on o.sent_id = f.sent_id and o.pos = f.pos + 1, p{k}),
bwd{k}(sent_id, pos, b0, b1, e0, e1) as (select sent_id, pos, f0, f1, e0, e1 from o{k}, p{k} where pos = len - 1
union all select o.sent_id, o.pos, {lse('b0 + b.e0 + t00', 'b1 + b.e1 + t10')}, {lse('b0 + b.e0 + t01', 'b1 + b.e1 + t11')}, o.e0, o.e1 from bwd{k} b join o{k} o on o.sent_id = b.sent_id and o.pos = b.pos - 1, p{k}),
ll{k} as (select sent_id, {lse('a0 + f0', 'a1 + f1')} ll from fwd{k}, p{k} where pos = len - 1), tot{k} as (select sum(ll) ll from ll{k}),
g{k} as materialized (select f.sent_id, f.pos, f.len, exp(a0 + b0 - ll) g0, exp(a1 + b1 - ll) g1 from fwd{k} f join bwd{k} b using (sent_id, pos) join ll{k} using (sent_id)),
x{k} as (select {', '.join(f'coalesce(sum(exp(a{j} + {t(i, j)} + b.e{i} + b{i} - ll)), 0) + {smoothing!r}::DOUBLE x{i}{j}' for i in (0, 1) for j in (0, 1))} from fwd{k} f join bwd{k} b on b.sent_id = f.sent_id and b.pos = f.pos + 1 join ll{k} on ll{k}.sent_id = f.sent_id, p{k}),
c{k} as (select sum(case when pos = 0 then g0 else 0 end) + {smoothing!r}::DOUBLE i0, sum(case when pos = 0 then g1 else 0 end) + {smoothing!r}::DOUBLE i1, sum(case when pos = len - 1 then g0 else 0 end) + {smoothing!r}::DOUBLE n0, sum(case when pos = len - 1 then g1 else 0 end) + {smoothing!r}::DOUBLE n1 from g{k}),
par{k + 1}({', '.join(_COLS)}) as materialized (select {blend('pi0', 'i0 / (i0 + i1)')}, {blend('pi1', 'i1 / (i0 + i1)')},
{', '.join(blend(t(i, j), f'x{i}{j} / (x0{j} + x1{j} + n{j})') for i in (0, 1) for j in (0, 1))}, {blend('f0', 'n0 / (x00 + x10 + n0)')}, {blend('f1', 'n1 / (x01 + x11 + n1)')} from c{k}, x{k}, p{k}),
w{k} as (select em{k}.sym, em{k}.e0, em{k}.e1, coalesce(s0, 0) + {smoothing!r}::DOUBLE s0, coalesce(s1, 0) + {smoothing!r}::DOUBLE s1 from em{k} left join (select sym, sum(g0) s0, sum(g1) s1 from g{k} join {obs} using (sent_id, pos) group by sym) c on c.sym = em{k}.sym),
em{k + 1}(sym, e0, e1) as materialized (select sym, {blend('e0', 's0 / (sum(s0) over ())')}, {blend('e1', 's1 / (sum(s1) over ())')} from w{k})"""


def likelihood(k: int, obs: str = "obs") -> str:
    """tot{k} only."""
    s = step(k, obs)
    return s[: s.index(f"\ng{k} as")].rstrip(",")


def rows_of(k: int) -> str:
    """Parameters par{k}, em{k} as long rows."""
    parts = [("init", "0", "0", "pi0"), ("init", "1", "0", "pi1"), *[("trans", i, j, f"t{i}{j}") for i in "01" for j in "01"], ("final", "0", "0", "f0"), ("final", "0", "1", "f1")]
    out = " union all ".join(f"select '{p}' param, {i}::BIGINT i, {j}::BIGINT j, round(exp({v}), 6) v from par{k}" for p, i, j, v in parts)
    return f"{out} union all select 'emit', sym::BIGINT, 0, round(exp(e0), 6) from em{k} union all select 'emit', sym::BIGINT, 1, round(exp(e1), 6) from em{k}"


def _by_rel(values, rel: str) -> str:
    """The log of a parameter by relation."""
    logs = [float(np.log(v)) for v in values]
    return f"({logs[0]!r}::DOUBLE)" if len(logs) == 1 else f"([{', '.join(f'{v!r}::DOUBLE' for v in logs)}][{rel} + 1])"


def trees(p, nodes: str, levels: int, maximum: bool = False) -> str:
    """Belief propagation over ``nodes(sent_id, idx, head, depth, sym, rel)``: upward and downward, one CTE for each level.

    Ends with post(sent_id, idx, p0, p1), edge(i, j, v) and tot(sent_id, ll); with ``maximum`` with best(sent_id, idx, state).
    """
    pi, T, f, E = p.pi, p.T, p.f, p.E
    e = [f"case n.sym {' '.join(f'when {w} then {_by_rel(E[w, s], "n.rel")}' for w in range(E.shape[0]))} end" for s in (0, 1)]
    t = lambda j, i, rel: _by_rel(T[j, i], rel)  # noqa: E731  parent state j, child state i
    over = (lambda a, b: f"greatest({a}, {b})") if maximum else lse
    out = [f"tb as materialized (select n.sent_id, n.idx, n.head, n.depth, n.rel, coalesce(m.rel, 0) prel, {e[0]} e0, {e[1]} e1 from {nodes} n left join {nodes} m on m.sent_id = n.sent_id and m.idx = n.head)"]
    out.append(f"u{levels + 1} as (select null::BIGINT sent_id, null::INT idx, null::INT head, 0 leaf, 0::DOUBLE b0, 0::DOUBLE b1, 0::DOUBLE c0, 0::DOUBLE c1, 0::DOUBLE m0, 0::DOUBLE m1, 0::DOUBLE t, 0 k0, 0 k1, 0 kt where false)")
    for d in range(levels, 0, -1):
        out.append(f"""v{d} as (select n.*, coalesce(c.c0, 0) c0, coalesce(c.c1, 0) c1, n.e0 + coalesce(c.c0, {_by_rel(pi[0], 'n.rel')}) b0, n.e1 + coalesce(c.c1, {_by_rel(pi[1], 'n.rel')}) b1, (c.c0 is null)::INT leaf
from tb n left join (select sent_id, head, sum(m0) c0, sum(m1) c1 from u{d + 1} group by 1, 2) c on c.sent_id = n.sent_id and c.head = n.idx where depth = {d}),
u{d} as materialized (select sent_id, idx, head, leaf, rel, prel, e0, e1, b0, b1, c0, c1, {over(f"b0 + {t(0, 0, 'prel')}", f"b1 + {t(0, 1, 'prel')}")} m0, {over(f"b0 + {t(1, 0, 'prel')}", f"b1 + {t(1, 1, 'prel')}")} m1, {over(f"b0 + {_by_rel(f[0], 'rel')}", f"b1 + {_by_rel(f[1], 'rel')}")} t,
(b1 + {t(0, 1, 'prel')} > b0 + {t(0, 0, 'prel')})::INT k0, (b1 + {t(1, 1, 'prel')} > b0 + {t(1, 0, 'prel')})::INT k1, (b1 + {_by_rel(f[1], 'rel')} > b0 + {_by_rel(f[0], 'rel')})::INT kt from v{d})""")
    out.append("tot as materialized (select sent_id, sum(t) ll from u1 group by 1)")
    if maximum:
        out.append("s1 as materialized (select sent_id, idx, kt state from u1)")
        for d in range(2, levels + 1):
            out.append(f"s{d} as materialized (select u.sent_id, u.idx, case when s.state = 1 then k1 else k0 end state from u{d} u join s{d - 1} s on s.sent_id = u.sent_id and s.idx = u.head)")
        return ", ".join(out) + ", best as (" + " union all ".join(f"select * from s{d}" for d in range(1, levels + 1)) + ")"
    out.append(f"d1 as materialized (select u.sent_id, u.idx, u.e0, u.e1, c0, c1, {_by_rel(f[0], 'rel')} + ll - t d0, {_by_rel(f[1], 'rel')} + ll - t d1, b0, b1, leaf, u.rel, 1 top, ll, 0::DOUBLE x00, 0::DOUBLE x01, 0::DOUBLE x10, 0::DOUBLE x11 from u1 u join tot using (sent_id))")
    for d in range(2, levels + 1):
        edge = ", ".join(f"exp(o{j} + {t(j, i, 'prel')} + b{i} - ll) x{j}{i}" for j in (0, 1) for i in (0, 1))
        out.append(f"""d{d} as materialized (select sent_id, idx, e0, e1, c0, c1, {lse(f"o0 + {t(0, 0, 'prel')}", f"o1 + {t(1, 0, 'prel')}")} d0, {lse(f"o0 + {t(0, 1, 'prel')}", f"o1 + {t(1, 1, 'prel')}")} d1, b0, b1, leaf, rel, 0 top, ll, {edge}
from (select u.sent_id, u.idx, u.e0, u.e1, u.c0, u.c1, u.b0, u.b1, u.leaf, u.rel, u.prel, q.ll, q.d0 + q.c0 - u.m0 + q.e0 o0, q.d1 + q.c1 - u.m1 + q.e1 o1 from u{d} u join d{d - 1} q on q.sent_id = u.sent_id and q.idx = u.head))""")
    every = " union all ".join(f"select sent_id, idx, leaf, top, rel, exp(b0 + d0 - ll) q0, exp(b1 + d1 - ll) q1, x00, x01, x10, x11 from d{d}" for d in range(1, levels + 1))
    return ", ".join(out) + f", every as materialized ({every}), post as materialized (select sent_id, idx, leaf, top, rel, q0 / (q0 + q1) p0, q1 / (q0 + q1) p1, x00, x01, x10, x11 from every)"


def tree_step(p, nodes: str, smoothing: float = 1e-8) -> str:
    """M-step of models without relations from post, as long rows."""
    s = f"{smoothing!r}::DOUBLE"
    return f"""cnt as (select 'init' param, 0 i, 0 j, sum(p0) v from post where leaf = 1 union all select 'init', 1, 0, sum(p1) from post where leaf = 1
union all select 'final', 0, 0, sum(p0) from post where top = 1 union all select 'final', 0, 1, sum(p1) from post where top = 1
{' '.join(f"union all select 'trans', {j}, {i}, sum(x{j}{i}) from post" for j in (0, 1) for i in (0, 1))}
union all select 'emit', sym, 0, sum(p0) from post join {nodes} using (sent_id, idx) group by sym union all select 'emit', sym, 1, sum(p1) from post join {nodes} using (sent_id, idx) group by sym),
grp as (select param, i, j, coalesce(v, 0) + {s} w, case when param in ('trans', 'final') then 'out' else param end q, case when param = 'init' then 0 else j end k from cnt)
select param, i::BIGINT i, j::BIGINT j, round(w / sum(w) over (partition by q, k), 6) v from grp"""

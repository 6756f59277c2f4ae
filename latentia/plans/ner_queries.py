"""Entity recognition pipelines: queries and SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latentia.operators import corpus as C, introspect as I, ner as N, params as P, trees
from latentia.plans import model_queries as MQ, model_sql as S
from latentia.plans.corpus_queries import _NODES, nodes
from latentia.plans.rep_queries import _BROWN, _EP, _NER, TAGS, brown, ner
from latentia.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {_NER} select sent_id, string_agg(word || '/' || tag, ' ' order by pos) text from ner group by sent_id")
def render_tokens(spark, d):
    return N.rendered(ner(spark, d))


@query(f"with {_EP}, {_NER}, w as (select min(id) id, word from vocab where word is not null group by word) select sent_id, pos, round(list_max(v)::DOUBLE * 1e6, 2) top_ppm, v is null missing from ner left join w using (word) left join ue on ue.word_id = w.id")
def token_embeddings(spark, d):
    """Tokens with the vector of their word, by its greatest entry."""
    ids = table(spark, d, "vocab").where("word is not null").groupBy("word").agg(F.min("id").alias("word_id"))
    vectors = I.vectors(table(spark, d, "ep"), "word_id", "ep", 72).join(ids, "word_id").select("word", F.col("v").alias("rep"))
    rows = N.embedded(ner(spark, d), vectors)
    return rows.select("sent_id", "pos", F.round(F.array_max("rep").cast("double") * 1e6, 2).alias("top_ppm"), F.col("rep").isNull().alias("missing"))


@query(f"with {_NODES}, f as (select sent_id, list(form order by idx) w from nodes group by 1), k as (select sent_id, list(lemma order by idx) w from nodes group by 1) select sent_id, f.w[1:least(len(f.w), len(k.w))] = k.w[1:least(len(f.w), len(k.w))] same from f join k using (sent_id)")
def equal_forms(spark, d):
    """Sentences whose forms are their lemmas."""
    held = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda x: x[c])
    per = nodes(spark, d).groupBy("sent_id").agg(held("form").alias("a"), held("lemma").alias("b"))
    return per.select("sent_id", C.equal_prefix(F.col("a"), F.col("b")).alias("same"))


@query(f"with {_NER}, p as (select sent_id, pos, case when (sent_id + pos) % 7 = 0 then 'O' else tag end pred from ner) select sent_id, pos, word, tag gold, pred from ner join p using (sent_id, pos)")
def aligned_predictions(spark, d):
    g = ner(spark, d)
    pred = g.select("sent_id", "pos", F.when((F.col("sent_id") + F.col("pos")) % 7 == 0, "O").otherwise(F.col("tag")).alias("pred"))
    return N.aligned(g, pred).select("sent_id", "pos", "word", "gold", "pred")


def _vocab(spark, d):
    return table(spark, d, "vocab").where("word is not null").groupBy("word").agg(F.min("id").alias("id"))


def _model(vocab):
    """Two states, and the vocabulary with emissions of a word by a rule on its id, normalized over all ids up to the
    greatest; the rule is periodic, so neither their number nor gaps between them matter."""
    m = max(vocab.agg(F.max("id")).first()[0] or 0, 0) + 1
    q, emit = MQ.fixed(), []
    for a, b, k in ((7, 3, 11), (5, 1, 13)):
        period = [(w * a + b) % k + 1 for w in range(k)]
        total = m // k * sum(period) + sum(period[: m % k])
        emit.append(((F.col("id") % k * a + b) % k + 1).cast("double") / F.lit(float(total)))
    return P.Params(q.pi, q.T, q.f, np.zeros((0, q.n, 1))), vocab.withColumn("e", F.when(F.col("id") >= 0, F.array(*emit)))


_KNOWN = f"""{_NER}, vk as (select word, min(id) id from vocab where word is not null group by word),
tk as (select n.sent_id, n.pos, n.word, coalesce(a.id, b.id, u.id) sym from ner n left join vk a on n.word = a.word left join vk b on lower(n.word) = b.word left join vk u on u.word = '*unk*'),
obs as materialized (select sent_id, row_number() over (partition by sent_id order by pos) - 1 pos, count(*) over (partition by sent_id) len, pos place, sym from tk where sym is not null),
rl as (select w, (w * 7 + 3) % 11 + 1 r0, (w * 5 + 1) % 13 + 1 r1 from (select unnest(range((select max(id) + 1 from vk))) w)), rs as (select sum(r0) s0, sum(r1) s1 from rl)"""
_SMALL = S.parameters(1, *MQ._ARRAYS).split("\nem1")[0] + "\nem1(sym, e0, e1) as materialized (select w, ln(r0::DOUBLE / s0), ln(r1::DOUBLE / s1) from rl, rs)"
_REP = f"with recursive {_KNOWN}, {_SMALL}, {S.step(1)}, pr as (select g.sent_id, o.place pos, o.sym, g0 p0, g1 p1 from g1 g join obs o on o.sent_id = g.sent_id and o.pos = g.pos)"


@query(f"{_REP} select t.sent_id, t.pos, t.word, coalesce(round(p0, 6), -1) p0 from tk t left join pr using (sent_id, pos)")
def ner_represented(spark, d):
    """Tokens with state posteriors of a model over the vocabulary; unknown words have none (here -1)."""
    p, vocab = _model(_vocab(spark, d))
    rows = N.represented(ner(spark, d), vocab, p)
    return rows.select("sent_id", "pos", "word", F.coalesce(F.round(F.col("rep")[0], 6), F.lit(-1.0)).alias("p0"))


@query(f"{_REP}, ty as (select sym, avg(p0) p0 from pr group by sym) select t.sent_id, t.pos, coalesce(round(ty.p0, 6), -1) p0 from tk t left join ty using (sym)")
def ner_type_represented(spark, d):
    """Tokens with the mean posterior of their type."""
    p, vocab = _model(_vocab(spark, d))
    rows = N.represented(ner(spark, d), vocab, p, "posterior_cont_type")
    return rows.select("sent_id", "pos", F.coalesce(F.round(F.col("rep")[0], 6), F.lit(-1.0)).alias("p0"))


@query(f"{MQ._of(MQ.relational(), 'rn')} select n.sent_id, (n.idx - 1)::BIGINT pos, case when rn.rel = 1 or p0 is null then -1 else round(p0, 6) end p0 from nodes n left join post using (sent_id, idx) left join rn using (sent_id, idx)")
def ner_tree_represented(spark, d):
    """Tokens of parsed sentences with posteriors of a relational tree model; one relation is ignored, sentences that are no tree have none (here -1)."""
    n = nodes(spark, d)
    toks = n.select("sent_id", (F.col("idx") - 1).alias("pos"), "form")
    good = trees.acyclic(n).where("acyclic").select("sent_id")
    words = n.join(good, "sent_id", "left_semi").withColumn("word", (F.length("form") % 5).cast("string"))
    vocab = spark.createDataFrame([(str(i), i) for i in range(5)], "word string, id long")
    rows = N.tree_represented(toks, words, vocab, MQ.relational(), relations=["OTHER", "NMOD", "SBJ"], ignore_rel="NMOD")
    return rows.select("sent_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.round(F.col("rep")[0], 6), F.lit(-1.0)).alias("p0"))


@query()
def ner_experiment(spark, d):
    """Baseline, cluster and representation features; trained on four fifths of the sentences: chunk scores."""
    p, vocab = _model(_vocab(spark, d))
    toks = cut(N.represented(ner(spark, d), vocab, p), "tokens")  # each kind of features reads them
    held_out = F.pmod(F.xxhash64("sent_id"), F.lit(5)) == 0
    _, scores = N.experiment(toks.where(~held_out), toks.where(held_out), TAGS, brown=brown(spark, d), rep="rep", **N.LANGUAGES["en"])
    return scores


@query(f"with {_NER}, {_BROWN}, j as (select sent_id, pos, coalesce(x.cluster, y.cluster) c from ner n left join brown x on n.word = x.word left join brown y on lower(n.word) = y.word), k as (select unnest([-1, 0, 1]) k) select j.sent_id, (j.pos - k)::INT pos, 'brown' || case k when 0 then '' when 1 then '+1' else '-1' end || '_id:' || c as name from j, k join ner n on n.sent_id = j.sent_id and n.pos = j.pos - k where c is not null")
def brown_window(spark, d):
    """Clusters of the word and of its neighbours."""
    f = N.features(ner(spark, d), brown=brown(spark, d), chosen=("id",), brown_window=(-1, 0, 1), prefixes=())
    return f.where("name like 'brown%'").select("sent_id", "pos", "name")

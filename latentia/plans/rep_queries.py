"""Representations, features and metrics: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from latentia.functions import numeric as X, text as T
from latentia.operators import features as FT, introspect as I, metrics as M, params as P
from latentia.plans.corpus_queries import _NODES, nodes
from latentia.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TAGS = [p + t for p in ("B-", "I-") for t in ("LOC", "MISC", "ORG", "PER")] + ["O"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ep(spark: SparkSession, d: str) -> DataFrame:
    return I.vectors(table(spark, d, "ep"), "word_id", "ep", 72)


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posttypes").where(X.usable(F.col("rep"), 72))


def ner(spark: SparkSession, d: str) -> DataFrame:
    """English tokens without redeliveries and null words."""
    rows = table(spark, d, "ner2003").where("word is not null")
    one = rows.groupBy("sent_id", "pos").agg(F.min_by(F.struct("word", "tag"), "token_id").alias("t"))
    return one.select("sent_id", "pos", "t.word", "t.tag")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Gold tags and deterministic predictions that are partly wrong."""
    s, p = F.col("sent_id"), F.col("pos")
    pred = F.when((s * 7 + p * 3) % 11 == 0, "O").when((s * 3 + p) % 13 == 0, "B-LOC").otherwise(F.col("tag"))
    return ner(spark, d).select("sent_id", "pos", "word", F.col("tag").alias("gold"), pred.alias("pred"))


def brown(spark: SparkSession, d: str) -> DataFrame:
    """Eight clusters with bit-string names, dealt by id."""
    v = table(spark, d, "vocab").where("word is not null")
    return v.select(F.lpad(F.bin(F.col("id") % 8), 3, "0").alias("cluster"), "word", "freq")


_EP = "ue as (select word_id, ep v from ep where ep is not null and len(ep) = 72 and len(list_filter(ep, lambda x: x is null or isnan(x))) = 0 and len(list_filter(ep, lambda x: x <> 0)) > 0)"
_EPX = f"{_EP}, ex as (select word_id, unnest(range(72))::INT state, unnest(v)::DOUBLE p from ue)"
_PT = "pt as (select * from posttypes where rep is not null and len(rep) = 72 and len(list_filter(rep, lambda x: x is null or isnan(x))) = 0 and len(list_filter(rep, lambda x: x <> 0)) > 0)"
_NER = "ner as (select sent_id, pos, word, tag from (select *, row_number() over (partition by sent_id, pos order by token_id) rn from ner2003 where word is not null) where rn = 1)"
_TAGGED = f"{_NER}, tagged as (select sent_id, pos, word, tag gold, case when (sent_id * 7 + pos * 3) % 11 = 0 then 'O' when (sent_id * 3 + pos) % 13 = 0 then 'B-LOC' else tag end pred from ner)"
_BROWN = "brown as (select lpad(bin(id % 8), 3, '0') cluster, word, freq from vocab where word is not null)"


@query(f"with {_BROWN}, w as (select v.id word_id, s.state, case when v.id % 8 = s.state then 1000.0::DOUBLE else 1.0::DOUBLE end w from vocab v, (select unnest(range(8))::INT state) s where v.word is not null), t as (select state, sum(w) s from w group by state) select word_id, state, round(w / s, 12) v from w join t using (state)")
def brown_init(spark, d):
    v = table(spark, d, "vocab").where("word is not null")
    return P.brown_emission(v, brown(spark, d)).select("word_id", "state", F.round("v", 12).alias("v"))


_BIGRAMS = f"""with {_NODES}, c as (select 'trans' param, h.pos i, n.pos j, n.rel r, count(*)::DOUBLE v from nodes n join nodes h on n.sent_id = h.sent_id and n.head = h.idx group by 2, 3, 4
union all select 'final', '', pos, rel, count(*)::DOUBLE from nodes where head = 0 group by 3, 4)"""


def _pos_counts(spark, d):
    """Transition and final counts between part-of-speech tags per relation, as a parameter table with names as keys."""
    n = nodes(spark, d)
    h = n.select(F.col("sent_id").alias("_s"), F.col("idx").alias("_i"), F.col("pos").alias("i"))
    pair = n.join(h, (F.col("sent_id") == F.col("_s")) & (F.col("head") == F.col("_i")))
    trans = pair.groupBy("i", F.col("pos").alias("j"), F.col("rel").alias("r")).agg(F.count("*").cast("double").alias("v"))
    final = n.where("head = 0").groupBy(F.col("pos").alias("j"), F.col("rel").alias("r")).agg(F.count("*").cast("double").alias("v"))
    return trans.withColumn("param", F.lit("trans")).unionByName(final.select(F.lit("final").alias("param"), F.lit("").alias("i"), "j", "r", "v"))


@query(f"{_BIGRAMS}, s as (select j, r, sum(v) s from c group by 1, 2) select param, i, j, r, round(v / s, 9) v from c join s using (j, r)")
def normalize_params(spark, d):
    """Joint normalization of transitions and final probabilities per previous state and relation."""
    return P.normalized(_pos_counts(spark, d)).select("param", "i", "j", "r", F.round("v", 9).alias("v"))


@query(f"{_BIGRAMS} select 'out' g, j k, r, sum(v) s from c group by j, r having abs(sum(v) - 1) > 0.01")
def unbalanced_params(spark, d):
    """Groups of counts that do not sum to one, as a check of parameters would list them."""
    return P.unbalanced(_pos_counts(spark, d)).select("g", "k", "r", "s")


@query("select 0::BIGINT n_unbalanced, true sane")
def random_params(spark, d):
    """Random parameters sum to one, for states and relations."""
    p = P.random_params(4, 30, 3, seed=7)
    n = P.unbalanced(P.to_table(spark, p), 1e-9).count()
    return spark.createDataFrame([(n, p.sane(1e-9))], "n_unbalanced long, sane boolean")


_ETA = P.step_size(3, 4, 0.5)


@query(f"{_BIGRAMS}, s as (select j, r, sum(v) s, count(*) k from c group by 1, 2) select param, i, j, r, round((1 - {_ETA!r}::DOUBLE) * (1.0::DOUBLE / k) + {_ETA!r}::DOUBLE * (v / s), 9) v from c join s using (j, r)")
def online_update(spark, d):
    """Step 3 of online learning, from uniform parameters towards those of a batch."""
    c = _pos_counts(spark, d)
    return P.interpolated(P.normalized(c.withColumn("v", F.lit(1.0))), P.normalized(c), _ETA).select("param", "i", "j", "r", F.round("v", 9).alias("v"))


_SMALL = "e as (select 'emit' param, word_id i, state::BIGINT j, p from ex), n as (select param, i, j, p / sum(p) over (partition by j) v from e)"


@query(f"with {_EPX}, {_SMALL} select i, unnest([2 * j, 2 * j + 1]) j, round(v * 1e6, 3) v from n")
def state_split(spark, d):
    """Every state becomes two with the same emissions (no noise)."""
    t = I.exploded(ep(spark, d)).select(F.lit("emit").alias("param"), F.col("word_id").alias("i"), F.col("state").cast("long").alias("j"), F.lit(0).cast("long").alias("r"), F.col("p").alias("v"))
    return P.split(t).select("i", "j", F.round(F.col("v") * 1e6, 3).alias("v"))


@query(f"with {_EPX}, {_SMALL} select i, j // 2 * 2 j, round(avg(v) * 1e6, 3) v from n group by 1, 2")
def state_merge(spark, d):
    """States 2k and 2k + 1 become one."""
    t = I.exploded(ep(spark, d)).select(F.lit("emit").alias("param"), F.col("word_id").alias("i"), F.col("state").cast("long").alias("j"), F.lit(0).cast("long").alias("r"), F.col("p").alias("v"))
    pairs = spark.range(36).select((2 * F.col("id")).alias("keep"), (2 * F.col("id") + 1).alias("gone"))
    return P.merge(P.normalized(t), pairs).select("i", "j", F.round(F.col("v") * 1e6, 3).alias("v"))


@query(f"with {_EPX} select word_id, arg_max(state, (p, -state))::INT state from ex group by 1")
def max_emission(spark, d):
    return I.max_emission(ep(spark, d))


@query(f"with {_EPX} select word_id, state, round(p * 1e9, 3) p_ppb, rank::INT rank from (select *, row_number() over (partition by word_id order by p desc, state) rank from ex where p > 0.00001::DOUBLE) where rank <= 5")
def best_clusters(spark, d):
    return I.best_states(ep(spark, d)).select("word_id", "state", F.round(F.col("p") * 1e9, 3).alias("p_ppb"), "rank")


@query(f"with {_EPX} select state, word_id, row_number() over (partition by state order by p desc, word_id) place from ex where p > 0.0001::DOUBLE")
def cluster_words(spark, d):
    return I.state_words(ep(spark, d), 1e-4).select("state", "word_id", F.col("place").cast("long").alias("place"))


@query(f"""with {_EPX}, b as (select word_id, state, p, row_number() over (partition by word_id order by p desc, state) k from ex where p > 0.00001::DOUBLE), c as (select *, count(*) over (partition by word_id) n from b where k <= 5)
select state, case when n > 1 then word_id || '__' || k else word_id::VARCHAR end label from c""")
def clusters_by_word(spark, d):
    return I.clusters_by_word(ep(spark, d)).select("state", "label")


_TOPK = """, q as (select * from ue where word_id % 50 = 0), s as (select q.word_id query_id, u.word_id, {m} score from q, ue u),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, word_id) rank from s)
select query_id, word_id, round(score, 6) score, rank::INT rank from r where rank <= 10"""


@query(f"with {_EP}" + _TOPK.format(m="list_inner_product(q.v::DOUBLE[], u.v::DOUBLE[]) / sqrt(list_inner_product(q.v::DOUBLE[], q.v::DOUBLE[]) * list_inner_product(u.v::DOUBLE[], u.v::DOUBLE[]))"))
def cosine_topk(spark, d):
    v = ep(spark, d)
    return I.most_similar(v, v.where("word_id % 50 = 0"), 10, "cosine")


@query(f"with {_EP}" + _TOPK.format(m="1 - sqrt(greatest(list_sum(q.v::DOUBLE[]) + list_sum(u.v::DOUBLE[]) - 2 * list_inner_product(list_transform(q.v, lambda x: sqrt(x::DOUBLE)), list_transform(u.v, lambda x: sqrt(x::DOUBLE))), 0)) / sqrt(2)"))
def hellinger_topk(spark, d):
    v = ep(spark, d)
    return I.most_similar(v, v.where("word_id % 50 = 0"), 10, "hellinger")


@query(f"with {_EPX} select state, round(stddev_pop(p) * 1e6, 3) std_ppm, round(stddev_pop(p) / avg(p), 6) cv from ex group by state")
def sparsity_cv(spark, d):
    return I.sparsity(ep(spark, d))


@query("select a.vec_id a, b.vec_id b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))), 6) distance from embeddings a, embeddings b where a.vec_id % 50 = 0")
def euclid_pairs(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("v"))
    return I.distances(v, v.where("word_id % 50 = 0"))


@query()
def mds(spark, d):
    """Two-dimensional map of the ten first labels' first vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("v"), "label")
    targets = v.groupBy("label").agg(F.min("word_id").alias("word_id"))
    return I.planar_map(v.drop("label"), targets)


@query("select distinct label, true recovered from embeddings")
def mds_planar(spark, d):
    """Points that lie in a plane are laid out by their distances: of each, whether all its distances are met to a twentieth of the longest."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"), F.slice("embedding", 1, 2).alias("v"), "label")
    targets = v.groupBy("label").agg(F.min("word_id").alias("word_id"))
    points = v.join(targets.select("word_id"), "word_id")
    xy = I.planar_map(v.drop("label"), targets)
    a, b = (xy.select(F.col("word_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "ab")
    pairs = I.distances(points, points).join(a, "a").join(b, "b")  # a bounded list of targets
    off = F.abs(F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2) - F.col("distance"))
    worst = pairs.groupBy(F.col("a").alias("word_id")).agg(F.max(off).alias("off"), F.max("distance").alias("far"))
    most = worst.agg(F.max("far")).first()[0]
    return worst.join(targets, "word_id").select("label", (F.col("off") <= most / 20).alias("recovered"))


@query(f"with {_PT}, x as (select word_id, unnest(range(72))::INT state, unnest(rep)::DOUBLE p from pt) select word_id, state, round(avg(p), 6) p from x group by 1, 2")
def type_mean_rep(spark, d):
    """Mean representation per word type: sums inside one aggregate, exploded only after it."""
    means = posts(spark, d).groupBy("word_id").agg(F.array(*[F.round(F.avg(F.col("rep")[i].cast("double")), 6) for i in range(72)]).alias("r"))
    return means.select("word_id", F.posexplode("r").alias("state", "p"))


@query(f"with {_PT} select word_id, coalesce(rel, '?') rel, count(*) n, round(avg(list_sum(rep::DOUBLE[])), 6) mass from pt group by 1, 2")
def type_rel_mass(spark, d):
    """Per word and relation: representations and their mean sum."""
    return posts(spark, d).groupBy("word_id", F.coalesce("rel", F.lit("?")).alias("rel")).agg(F.count("*").alias("n"), F.round(F.avg(X.total(F.col("rep"))), 6).alias("mass"))


@query(f"""with {_PT}, l as (select rep_id, list_transform(rep, lambda x: case when x > 0 then ln(x::DOUBLE) else -1000.0::DOUBLE end) v from pt),
t as (select rep_id, v, list_reverse_sort(v)[9] floor from l), k as (select rep_id, v, floor, list_sum(list_transform(v, lambda x: exp(x))) a, list_sum(list_transform(list_filter(v, lambda x: x >= floor), lambda x: exp(x))) b from t)
select rep_id, len(list_filter(v, lambda x: x >= floor)) kept, round(ln(a) - ln(b), 6) shift, round(list_max(v) + ln(a) - ln(b), 6) top from k""")
def kbest_project(spark, d):
    """Projection on the N/8 best log scores: entries kept, the shift that keeps the mass, and the new maximum."""
    logs = F.transform("rep", lambda x: F.when(x > 0, F.ln(x.cast("double"))).otherwise(F.lit(-1000.0)))
    rows = posts(spark, d).select("rep_id", logs.alias("v")).withColumn("k", X.kbest(F.col("v"), 9))
    shift = F.array_max("k") - F.array_max("v")
    return rows.select("rep_id", F.size(F.filter("k", lambda x: x > X.ZERO)).cast("long").alias("kept"), F.round(shift, 6).alias("shift"), F.round(F.array_max("k"), 6).alias("top"))


_CAP = "case when {w} is null then '-' when regexp_matches({w}, '^\\p{{Lu}}') then 'C' else 'N' end"
_WIN = f"""win as (select sent_id, pos, word, tag, {', '.join(f"coalesce(lag(word, {k}) over w, 'out-of-seq-left') m{k}, coalesce(lead(word, {k}) over w, 'out-of-seq-right') p{k}" for k in (1, 2))},
{' || '.join(_CAP.format(w=w) for w in ('(lag(word, 2) over w)', '(lag(word, 1) over w)', 'word', '(lead(word, 1) over w)', '(lead(word, 2) over w)'))} cappattern from ner window w as (partition by sent_id order by pos))"""
_TITLE = r"(regexp_matches(word, '[\p{Lu}\p{Lt}]') and not regexp_matches(word, '[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]') and not regexp_matches(word, '(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}'))"
_UPPER = r"(regexp_matches(word, '\p{Lu}') and not regexp_matches(word, '[\p{Ll}\p{Lt}]'))"


@query(f"with {_NER}, {_WIN} select sent_id, pos, m2, m1, p1, p2, cappattern, {_TITLE} title, {_UPPER} upper, contains(word, '-') hyphen from win")
def window_features(spark, d):
    w = FT.windowed(ner(spark, d))
    c = F.col("word")
    return w.select("sent_id", "pos", F.col("`w-2`").alias("m2"), F.col("`w-1`").alias("m1"), F.col("`w+1`").alias("p1"), F.col("`w+2`").alias("p2"), "cappattern", T.is_title(c).alias("title"), T.is_upper(c).alias("upper"), T.has_hyphen(c).alias("hyphen"))


@query("with k as (select unnest([1, 2, 3]) k), w as (select distinct word from ner2003 where word is not null) select word, k::INT k, word[1:k] prefix, right(word, k) suffix from w, k where length(word) > k")
def affixes(spark, d):
    w = table(spark, d, "ner2003").where("word is not null").select("word").distinct()
    return w.select("word", F.posexplode(F.arrays_zip(T.prefixes(F.col("word")).alias("p"), T.suffixes(F.col("word")).alias("s"))).alias("i", "t")).select("word", (F.col("i") + 1).alias("k"), F.col("t.p").alias("prefix"), F.col("t.s").alias("suffix"))


@query(f"with {_NER}, b as (select lpad(bin(id % 16384), 14, '0') cluster, word from vocab where word is not null), j as (select sent_id, pos, coalesce(x.cluster, y.cluster) c from ner n left join b x on n.word = x.word left join b y on lower(n.word) = y.word) select sent_id, pos, c[1:4] p4, c[1:6] p6, c[1:10] p10, c[1:20] p20 from j where c is not null")
def brown_prefix(spark, d):
    v = table(spark, d, "vocab").where("word is not null").select(F.lpad(F.bin(F.col("id") % 16384), 14, "0").alias("cluster"), "word")
    rows = FT.with_brown(ner(spark, d), v).where("cluster is not null").withColumn("p", FT.brown_prefixes(F.col("cluster")))
    return rows.select("sent_id", "pos", *[F.col("p")[i].alias(f"p{k}") for i, k in enumerate(FT.PREFIX_LENGTHS)])


@query(f"with {_NER} select sent_id, pos, lag(tag) over (partition by sent_id order by pos) prev_tag from ner")
def prev_tag(spark, d):
    return FT.previous_tag(ner(spark, d)).select("sent_id", "pos", "prev_tag")


_FEATS = f"""{_NER}, {_WIN}, feats as (select sent_id, pos, tag, unnest(list_concat(['id:' || word, 'id-2:' || m2, 'id-1:' || m1, 'id+1:' || p1, 'id+2:' || p2, 'cappattern:' || cappattern],
case when {_TITLE} then ['capitalized'] else [] end, case when {_UPPER} then ['uppercased'] else [] end, case when contains(word, '-') then ['hyphen'] else [] end,
list_transform(list_filter([1, 2, 3], lambda k: length(word) > k), lambda k: 'prefix:' || word[1:k]), list_transform(list_filter([1, 2, 3], lambda k: length(word) > k), lambda k: 'suffix:' || right(word, k)))) name from win)"""


def baseline(spark, d):
    return FT.emission(FT.windowed(ner(spark, d)))


@query(f"with {_FEATS}, c as (select name || '::' || tag name, count(*) n from feats group by 1) select row_number() over (order by n desc, name) - 1 id, name, n from c")
def feature_dict(spark, d):
    return FT.dictionary(baseline(spark, d))


@query(f"""with {_FEATS}, t as (select unnest([{', '.join(f"'{t}'" for t in TAGS)}]) y) select sent_id, pos, y, round(sum((length(name) * 7 + length(y) * 5 + ascii(y[3:3])) % 13 - 6), 6)::DOUBLE score from feats, t group by 1, 2, 3""")
def linear_scores(spark, d):
    """Scores of all tags from feature weights given by a rule."""
    f = baseline(spark, d)
    tags = F.explode(F.array(*[F.lit(t) for t in TAGS]))
    rule = ((F.length("name") * 7 + F.length("tag") * 5 + F.ascii(F.substring("tag", 3, 1))) % 13 - 6).cast("double")
    w = f.select("name").distinct().select("name", tags.alias("tag")).withColumn("weight", rule)
    return FT.scores(f.drop("tag"), w, TAGS)


_CONF = "count(*) filter (where gold <> 'O' and gold = pred) tp, count(*) filter (where pred <> 'O' and gold <> pred) fp, count(*) filter (where gold = 'O' and gold = pred) tn, count(*) filter (where gold <> 'O' and gold <> pred) fn"


@query(f"with {_TAGGED} select {_CONF} from tagged")
def confusion(spark, d):
    return M.confusion(tagged(spark, d))


_PRF = f"""c as (select word, {_CONF} from tagged group by word), p as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end pr, case when tp + fn = 0 then 0 else tp / (tp + fn) end re from c),
prf as (select word, round(pr, 6) "precision", round(re, 6) recall, round(case when pr + re = 0 then 0 else 2 * pr * re / (pr + re) end, 6) fscore, case when tp + fn > 0 then round(tp / (tp + fn), 6) end accuracy from p)"""


@query(f"with {_TAGGED}, {_PRF} select * from prf")
def type_prf(spark, d):
    return M.type_scores(tagged(spark, d))


@query(f"with {_TAGGED}, {_PRF} select round(avg(fscore), 6) fscore, round(avg(fscore) filter (where fscore > 0), 6) fscore_nonzero, round(avg(accuracy), 6) accuracy from prf")
def macro_prf(spark, d):
    return M.macro_scores(tagged(spark, d))


@query(f"with {_TAGGED} select round(avg((gold = pred)::INT), 6) accuracy, count(*) n_tokens from tagged")
def token_accuracy(spark, d):
    return M.token_accuracy(tagged(spark, d))


def _chunk_sql(c: str) -> str:
    return f"""{c}1 as (select sent_id, pos, split_part({c}, '-', 1) k, case when contains({c}, '-') then substr({c}, instr({c}, '-') + 1) else '' end t from tagged),
{c}2 as (select *, lag(k, 1, 'O') over w pk, lag(t, 1, '') over w pt from {c}1 window w as (partition by sent_id order by pos)),
{c}3 as (select *, sum((k not in ('O', '.') and (pk || k in ('BB','IB','OB','OI','EE','EI','OE') or pt <> t or k in ('[', ']') or pk in ('.', '[', ']')))::INT) over (partition by sent_id order by pos) c from {c}2),
{c}_chunks as (select sent_id, min(pos) s, max(pos) e, arg_min(t, pos) t from {c}3 where k not in ('O', '.') group by sent_id, c)"""


@query(f"""with {_TAGGED}, {_chunk_sql('gold')}, {_chunk_sql('pred')}, b as (select sent_id, s, e, t, max(g) g, max(p) p from (select *, 1 g, 0 p from gold_chunks union all select *, 0, 1 from pred_chunks) group by 1, 2, 3, 4),
r as (select t, sum(g)::BIGINT n_gold, sum(p)::BIGINT n_pred, sum(g * p)::BIGINT n_correct from b group by rollup(t))
select t "type", n_gold, n_pred, n_correct, round(100 * case when n_pred = 0 then 0 else n_correct / n_pred end, 4) "precision", round(100 * case when n_gold = 0 then 0 else n_correct / n_gold end, 4) recall,
round(100 * case when n_correct = 0 then 0 else 2 * (n_correct / n_pred) * (n_correct / n_gold) / (n_correct / n_pred + n_correct / n_gold) end, 4) fb1 from r""")
def chunk_eval(spark, d):
    return M.chunk_scores(tagged(spark, d))


@query("select count(*) n_rows, count(word) n_words, count(distinct word) n_types, count(distinct sent_id) n_sentences from ner2002")
def ner2002_counts(spark, d):
    t = table(spark, d, "ner2002")
    per = t.groupBy("word").agg(F.count("*").alias("c"))
    words = per.agg(F.sum("c").alias("n_rows"), F.sum(F.when(F.col("word").isNotNull(), F.col("c"))).alias("n_words"), F.count("word").alias("n_types")).withColumn("k", F.lit(1))
    return words.join(t.groupBy("sent_id").agg(F.lit(1).alias("o")).agg(F.count("sent_id").alias("n_sentences")).withColumn("k", F.lit(1)), "k").drop("k")

"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from latentia.llm import clusters, encoding, leaks, mixing, neighbours, packing, spans, terms
from latentia.session import cut, table


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = terms.term_counts(table(spark, sf_dir, "bllip_file"), "line").withColumn("field", F.lit("line"))
    word = terms.term_counts(table(spark, sf_dir, "ner2003"), "word", record="sent_id").withColumn("field", F.lit("word"))
    return terms.mark_terms(line.unionByName(word)).select("field", "term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with the share of the item's windows that the line contains."""
    found = leaks.leaked(table(spark, sf_dir, "bllip_file"), "line_id", "line", table(spark, sf_dir, "ptb_file"), "ptb_id", "line")
    return found.select("line_id", F.col("item_id").alias("ptb_id"), "shared", F.round(F.col("shared") / F.col("item_windows"), 6).alias("containment"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_leaks(spark, sf_dir).select("line_id", "ptb_id")


def p3_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items, short ones too, of whose distinct five-word shingles a line contains 80 % or more."""
    found = leaks.leaked(table(spark, sf_dir, "bllip_file"), "line_id", "line", table(spark, sf_dir, "ptb_file"), "ptb_id", "line", window=leaks.SHINGLE)
    kept = found.where(F.col("shared") * 10 >= F.col("item_windows") * 8)
    return kept.select("line_id", F.col("item_id").alias("ptb_id"), F.round(F.col("shared") / F.col("item_windows"), 6).alias("containment"))


def _word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.assign(table(spark, sf_dir, "ep"), "word_id", "ep")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _word_clusters(spark, sf_dir)
    several = clusters.sizes(rows).where("n_rows > 1").select("cluster_key")
    return rows.join(several, "cluster_key", "left_semi").select(F.col("id").alias("word_id"), "cluster_key")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster by size, dispersion and its most typical words."""
    ep, vocab = table(spark, sf_dir, "ep"), table(spark, sf_dir, "vocab").select(F.col("id").alias("word_id"), "word")
    found = clusters.report(ep, "word_id", "ep", _word_clusters(spark, sf_dir))
    words = found.select("cluster_key", F.posexplode("typical_ids").alias("rank", "word_id")).join(vocab, "word_id", "left")
    words = words.groupBy("cluster_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: F.coalesce(w["word"], F.lit("?"))), " ").alias("typical_words"))
    return found.drop("typical_ids").join(words, "cluster_key")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf_dir, "posttypes"), "rep_id", "rep", least=0.9)
    return near.select(F.least("id", "nb").alias("rep_a"), F.greatest("id", "nb").alias("rep_b")).distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf_dir, "posttypes"), "rep_id", "rep", probes=24, cover=1.0)
    return near.select(F.col("id").alias("rep_id"), F.col("nb").alias("neighbour_id"), F.round("cosine", 3).alias("cosine"), "rank")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_rows(table(spark, sf_dir, "ner2002"), "token_id", "word").select(F.col("row_id").alias("token_id"), "restored")


def p6_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled words with the channel and, where letters were lost, the likeliest reading."""
    return encoding.garbled_words(table(spark, sf_dir, "ner2002"), "word")


def p6_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with lost characters, and whether a whole word is guessed for each."""
    rows = encoding.garbled_rows(table(spark, sf_dir, "ner2002"), "token_id", "word").where(F.col("word").contains(encoding.LOST))
    return rows.select(F.col("row_id").alias("token_id"), "restored", (F.length("guess") > 0).alias("guessed"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf_dir))


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document in a container: its pieces follow one another without gap, and only one beyond the capacity is split, into full pieces and a rest."""
    each = Window.partitionBy("doc_id").orderBy("piece")
    rows = p7_containers(spark, sf_dir).withColumn("end", F.sum("n_tokens").over(each)).withColumn("next", F.lead("piece").over(each))
    good = (F.col("end") - F.col("n_tokens") == F.col("first_token")) & (F.col("n_tokens") > 0) & (F.col("next").isNull() | ((F.col("n_tokens") == 2048) & (F.col("next") == F.col("piece") + 1)))
    return rows.groupBy("doc_id").agg((F.bool_and(good) & (F.min("piece") == 0)).alias("whole"))


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: whether no container exceeds the capacity, and whether there are at most 2 % and one more than the volume needs."""
    r = p7_fill(spark, sf_dir)
    return r.select((F.col("fullest") <= 2048).alias("within_capacity"), (F.col("containers") <= F.col("least_containers") * 1.02 + 1).alias("near_least"))


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.uses(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(p8_uses(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_uses(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: whether it is used within its source's cap, and not at all without a target."""
    cap = table(spark, sf_dir, "mix_targets").where("source is not null").select("source", "max_repeats")
    used = p8_uses(spark, sf_dir).join(F.broadcast(cap), "source", "left")  # one row per target
    return used.select("doc_id", F.col("uses").between(0, F.coalesce("max_repeats", F.lit(0))).alias("within_cap"))


def p8_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target source with documents: whether its share is met to within two documents."""
    used = cut(p8_uses(spark, sf_dir), "uses")
    rows = mixing.shares(used, table(spark, sf_dir, "mix_targets")).where("target_share > 0 and tokens > 0 and max_repeats > 0")
    all_shares, all_tokens = rows.agg(F.sum("target_share"), F.sum("mixed_tokens")).first()
    longest = used.agg(F.max("n_tokens")).first()[0] or 0
    off = F.abs(F.col("mixed_tokens") - F.col("target_share") * ((all_tokens or 0) / (all_shares or 1)))
    return rows.select("source", (off <= 2 * longest).alias("met"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p9_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans.shared_amounts(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_leaks, p3_contained, p4_found, p4_clusters, p5_found, p5_neighbours, p6_found, p6_repairs, p6_lost, p7_containers, p7_fill, p7_cover, p7_limits, p8_uses, p8_mixture, p8_shares, p8_limits, p8_met, p9_found, p9_amounts)}

_P1 = """
with t as (
  select line_id r, unnest(string_split_regex(line, '[ \\t\\x{A0}]+')) term from bllip_file
), f as (
  select 'line' field, r, term from t where term <> ''
  union all select 'word', sent_id, word from ner2003 where word is not null
), n as (select field, count(distinct r) n from f group by field),
c as (select field, term, count(*) occurrences, count(distinct r) records from f group by field, term)
select field, term, occurrences, records, case when occurrences < 5 or records < 3 then 'rare' when records * 100 > n * 5 then 'common' end mark
from c join n using (field)
"""

_P3 = """
with w as (
  select line_id id, 0 k, list_filter(regexp_split_to_array(lower(line), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') ws from bllip_file
  union all select ptb_id, 1, list_filter(regexp_split_to_array(lower(line), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') from ptb_file
), g as (
  select distinct id, k, array_to_string(ws[i:i+9], ' ') g from (select id, k, ws, unnest(range(1, len(ws) - 8)) i from w where len(ws) >= 10)
), m as (select id, count(*) n from g where k = 1 group by id)
select a.id line_id, b.id ptb_id, count(*) shared, round(count(*) / n, 6) containment
from g a join g b using (g) join m on m.id = b.id where a.k = 0 and b.k = 1 group by a.id, b.id, n
"""

_UNIT = """
w as (select {id} id, {v} v from {t} where {v} is not null and len({v}) = 72 and len(list_filter({v}, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter({v}, lambda x: x <> 0)) > 0),
o as (select id, list_transform(v, lambda x: x::DOUBLE / list_max(list_transform(v, lambda y: abs(y::DOUBLE)))) v from w),
u as (select id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v from o)"""
_P4 = f"""
with recursive {_UNIT.format(id="word_id", v="ep", t="ep")},
e as materialized (select a.id a, b.id b from u a join u b on a.id <> b.id where list_inner_product(a.v, b.v) >= 0.9),
r(id, key) as (select id, id from u union select e.b, r.key from r join e on e.a = r.id where r.key < e.b),
k as (select id, min(key) cluster_key from r group by id)"""
_P5 = f"""
with {_UNIT.format(id="rep_id", v="rep", t="posttypes")},
c as (select a.id, b.id nb, list_inner_product(a.v, b.v) cosine from u a join u b on a.id <> b.id),
f as (select *, row_number() over (partition by id order by round(cosine, 7) desc, nb) rank from c)"""
_P9 = """
with s as (select doc_id, p, hash(substr(text, p + 1, 200)) h from (select doc_id, text, unnest(range(length(text) - 199)) p from documents where length(text) >= 200)),
k as (select h from s group by h having min(doc_id) <> max(doc_id)),
m as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 200 then 0 else 1 end first from s semi join k using (h)),
g as (select doc_id, p, sum(first) over (partition by doc_id order by p) g from m),
f as (select doc_id, min(p)::INT span_start, max(p)::INT + 200 span_end from g group by doc_id, g)"""
ORACLES = {
    "p1_terms": _P1,
    "p1_found": f"select field, term, mark from ({_P1}) where mark is not null",
    "p3_leaks": _P3,
    "p3_found": f"select line_id, ptb_id from ({_P3})",
    "p3_contained": f"select line_id, ptb_id, containment from ({_P3.replace('i:i+9', 'i:i+4').replace('len(ws) - 8', 'len(ws) - 3').replace('len(ws) >= 10', 'len(ws) >= 5').replace('count(*) shared', 'count(*) * 10 >= n * 8 enough')}) where enough",
    "p4_found": f"{_P4} select id word_id, cluster_key from k where cluster_key in (select cluster_key from k group by 1 having count(*) > 1)",
    "p4_clusters": f"""{_P4}, m as (select cluster_key, id, v from k join u using (id)),
x as (select cluster_key, unnest(v) x, unnest(range(72)) i from m), s as (select cluster_key, i, sum(x) s from x group by 1, 2), c as (select cluster_key, list(s order by i) c from s group by 1),
d as (select cluster_key, id, list_inner_product(v, c) / sqrt(list_inner_product(c, c)) cosine from m join c using (cluster_key)),
t as (select *, row_number() over (partition by cluster_key order by round(cosine, 4) desc, id) r from d)
select cluster_key, count(*) n_rows, abs(round(avg(1 - cosine), 4)) dispersion, string_agg(coalesce(word, '?'), ' ' order by r) filter (where r <= 3) typical_words from t left join vocab on vocab.id = t.id group by 1""",
    "p5_found": f"{_P5} select distinct least(id, nb) rep_a, greatest(id, nb) rep_b from f where rank <= 5 and cosine >= 0.9",
    "p5_neighbours": f"{_P5} select id rep_id, nb neighbour_id, round(cosine, 3) cosine, rank::INT rank from f where rank <= 5",
    "p6_lost": "select token_id, '' restored, true guessed from ner2002 where contains(word, chr(65533))",
    "p7_cover": "select doc_id, true whole from documents where length(text) > 0",
    "p7_limits": "select true within_capacity, true near_least",
    "p8_limits": "select doc_id, true within_cap from documents",
    "p8_met": "select source, true met from mix_targets where target_share > 0 and max_repeats > 0 and source in (select source from documents where length(text) > 0)",
    "p9_found": f"{_P9} select * from f",
    "p9_amounts": f"""{_P9}, t as (select doc_id, sum(span_end - span_start) c from f group by doc_id)
select d.doc_id, coalesce(length(text), 0) n_chars, coalesce(c, 0)::BIGINT shared_chars, case when length(text) > 0 then round(coalesce(c, 0) / length(text), 6) end shared_share from documents d left join t on t.doc_id = d.doc_id""",
}

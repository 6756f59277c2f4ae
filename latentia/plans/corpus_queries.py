"""Corpus preparation: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from latentia.functions import text as T
from latentia.operators import corpus as C, trees
from latentia.session import table

THRESHOLD = 5
SPECIAL = ["NMOD", "SBJ", "OBJ"]
NOUNS = ["NN", "NNS", "NNP", "NNPS"]


def sents(spark: SparkSession, d: str) -> DataFrame:
    return C.sentences(table(spark, d, "bllip_file"), "line_id", "line")


def toks(spark: SparkSession, d: str) -> DataFrame:
    return C.tokens(sents(spark, d))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.parsed_nodes(table(spark, d, "documents"))


_SENTS = r"""
sents as (select line_id sent_id, string_split(regexp_replace(line, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), ' ') words from bllip_file where line is not null),
toks as (select sent_id, (unnest(range(len(words))))::INT pos, unnest(words) word from sents),
freqs as (select word, count(*) freq from toks group by word)"""
_NODES = r"""
blocks as (select doc_id, string_split_regex(replace(text, chr(13), ''), '\n\n+') bs from documents where contains(text, chr(9))),
block as (select doc_id * 1000000 + unnest(range(len(bs))) sent_id, unnest(bs) b from blocks),
rowset as (select sent_id, list_transform(list_filter(string_split(b, chr(10)), lambda x: x <> ''), lambda x: string_split(x, chr(9))) rs from block),
good as (select * from rowset where len(rs) > 0 and len(list_filter(rs, lambda r: not (len(r) = 10 and regexp_full_match(r[1], '[0-9]{1,9}') and regexp_full_match(r[7], '[0-9]{1,9}')))) = 0),
each_row as (select sent_id, unnest(rs) r from good),
nodes as (select sent_id, r[1]::INT idx, r[2] form, r[3] lemma, r[4] cpos, r[5] pos, r[6] feats, r[7]::INT head, r[8] rel from each_row)"""
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""
with w as (select doc_id, lower(lang) lang, unnest(string_split_regex(text, '[ \t\n\r]+')) word from documents),
t as (select * from w where word <> ''), f as (select word, count(*) freq from t group by word)
select lang, count(*) n_tokens, count(distinct t.word) n_types, round(count(*) filter (where freq <= 5) / count(*), 6) unk_rate
from t join f using (word) group by lang""")
def unk_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per language: tokens, types and the share of tokens that rare-word replacement would hit."""
    docs = table(spark, d, "documents")
    words = docs.select(F.lower("lang").alias("lang"), F.explode(F.split("text", r"[ \t\n\r]+")).alias("word")).where("word <> ''")
    # one row per language and type, then frequencies over types: no token is shuffled twice
    types = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    freqs = types.groupBy("word").agg(F.sum("n").alias("freq"))
    return types.join(freqs, "word").groupBy("lang").agg(
        F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), F.round(F.sum(F.when(F.col("freq") <= THRESHOLD, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("unk_rate")
    )


@query(f"with {_SENTS} select word, freq from freqs")
def token_freq(spark, d):
    return C.frequencies(toks(spark, d))


@query(f"with {_SENTS} select row_number() over (order by freq desc, word) - 1 id, word, freq from freqs")
def vocab_ids(spark, d):
    return C.ranked(C.frequencies(toks(spark, d)))


@query(f"with {_SENTS} select row_number() over (order by freq desc, word) - 1 id, word, freq from freqs where freq > 5")
def vocab_min_freq(spark, d):
    return C.ranked(C.min_frequency(C.frequencies(toks(spark, d)), THRESHOLD))


@query(f"""with {_SENTS}, r as (select sent_id, pos, case when freq <= 5 then '*unk*' else word end w from toks join freqs using (word))
select sent_id, string_agg(w, ' ' order by pos) line from r group by sent_id""")
def unk_text(spark, d):
    t = toks(spark, d)
    return C.reassembled(C.replace_rare(t, C.frequencies(t), THRESHOLD))


@query(f"""with {_NODES}, f as (select lemma, count(*) n from nodes group by lemma)
select sent_id, idx, case when n <= 5 then '*unk*' else lemma end lemma, head, rel from nodes join f using (lemma)""")
def unk_conll(spark, d):
    n = nodes(spark, d)
    counted = n.groupBy(F.col("lemma").alias("word")).agg(F.count("*").alias("freq"))
    return C.replace_rare(n, counted, THRESHOLD, word="lemma").select("sent_id", "idx", "lemma", "head", "rel")


@query(f"with {_SENTS} select sent_id, len(words)::INT n from sents where len(words) > 4 and len(words) < 40")
def len_filter(spark, d):
    return C.length_between(sents(spark, d), 4, 40).select("sent_id", F.size("words").alias("n"))


@query(f"""with {_SENTS}, r as (select sent_id, pos, case when freq < 5 then '*unk*' else word end w from toks join freqs using (word))
select sent_id, string_agg(w, ' ' order by pos) line from r group by sent_id having count(*) > 4 and count(*) < 40""")
def filter_sents(spark, d):
    return C.filter_sentences(sents(spark, d), 4, 40, 5)


@query(f"with {_SENTS} select sent_id, len(words)::INT n from sents where sent_id <= 1000")
def first_n(spark, d):
    return C.first_sentences(sents(spark, d), 1000).select("sent_id", F.size("words").alias("n"))


@query(f"with {_SENTS} select sent_id from sents where list_contains(words, 'report')")
def contains_word(spark, d):
    return C.containing(sents(spark, d), "words", "report").select("sent_id")


@query(f"with {_NODES} select sent_id, string_agg(lemma, ' ' order by idx) words from nodes where pos in ('NN','NNS','NNP','NNPS') group by sent_id")
def pos_filter(spark, d):
    return C.words_of_pos(nodes(spark, d), NOUNS)


@query(r"select line_id from bllip_file b where line is not null and not exists (select 1 from ptb_file p where p.line = b.line)")
def anti_benchmark(spark, d):
    lines = table(spark, d, "bllip_file").where("line is not null").select("line_id", "line")
    return C.without_known(lines, table(spark, d, "ptb_file").where("line is not null"), "line").select("line_id")


@query("""with k as (select distinct word from vocab where word is not null)
select token_id, coalesce(a.word, b.word, '*unk*') norm from ner2003 n left join k a on n.word = a.word left join k b on lower(n.word) = b.word where n.word is not null""")
def normalize_word(spark, d):
    known = table(spark, d, "vocab").where("word is not null")
    return C.normalized(table(spark, d, "ner2003").where("word is not null").select("token_id", "word"), known).select("token_id", "norm")


@query(r"""with t as (select line_id sent_id, list_filter(string_split(line, ' '), lambda x: x <> '') ts from bllip_tagged where line is not null),
e as (select sent_id, (unnest(range(len(ts))) + 1)::INT idx, unnest(ts) t from t)
select sent_id, idx, regexp_extract(t, '(?s)^(.*)/[^/]*$', 1) form, regexp_extract(t, '(?s)^.*/([^/]*)$', 1) tag from e where regexp_full_match(t, '(?s).+/[^/]+')""")
def rsplit_tags(spark, d):
    return C.tagged_nodes(table(spark, d, "bllip_tagged"), "line_id", "line")


@query("select line_id, replace(line, '#', '-') line from bllip_file where line is not null")
def replace_hash(spark, d):
    return table(spark, d, "bllip_file").where("line is not null").select("line_id", T.without_hash(F.col("line")).alias("line"))


@query(f"with {_NODES} select sent_id, idx, form, lemma, cpos, pos, feats, head, rel from nodes")
def conll_nodes(spark, d):
    return nodes(spark, d)


@query(f"with {_NODES} select n.form dep_word, h.form head_word, count(*) n from nodes n join nodes h on n.sent_id = h.sent_id and n.head = h.idx group by 1, 2")
def head_pairs(spark, d):
    return C.head_pairs(nodes(spark, d))


@query(f"with {_NODES} select n.form dep_word, h.form head_word, count(*) n from nodes n join nodes h on n.sent_id = h.sent_id and n.head = h.idx where n.sent_id <= 500000000 group by 1, 2")
def head_pairs_first_k(spark, d):
    """Over the first sentences, by ordinal."""
    return C.head_pairs(C.first_sentences(nodes(spark, d), 500_000_000))


_TRIPLES = f"""with {_NODES}, tr as (
select n.sent_id, n.rel, replace(case when n.head = 0 then '<root-LEMMA>' else h.lemma end, ' ', '') h, replace(n.lemma, ' ', '') d, count(*) n
from nodes n left join nodes h on n.sent_id = h.sent_id and n.head = h.idx where n.head = 0 or h.lemma is not null group by 1, 2, 3, 4)"""


@query(f"{_TRIPLES} select * from tr")
def triples(spark, d):
    return C.triples(nodes(spark, d))


@query(f"""{_TRIPLES} select rel, h, d, sum(n)::BIGINT n from tr group by 1, 2, 3
union all select rel, h, null, count(*) from tr group by 1, 2 union all select rel, null, d, count(*) from tr group by 1, 3""")
def triples_marginals(spark, d):
    return C.triple_marginals(C.triples(nodes(spark, d)))


@query(f"with {_NODES} select sent_id, idx, case when head > idx then 'left' else 'right' end side from nodes")
def lr_relation(spark, d):
    return C.with_side(nodes(spark, d)).select("sent_id", "idx", "side")


@query(f"with {_NODES} select case when rel in ('NMOD','SBJ','OBJ') then rel else 'OTHER' end bucket, count(*) n from nodes group by 1")
def rel_bucket(spark, d):
    return nodes(spark, d).groupBy(T.bucketed(F.col("rel"), SPECIAL).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {_NODES} select distinct rel from nodes")
def relations_distinct(spark, d):
    return C.relations(nodes(spark, d))


@query(f"with {_NODES} select distinct rel from nodes where rel not in ('NMOD','SBJ','OBJ')")
def relations_difference(spark, d):
    listed = spark.createDataFrame([(r,) for r in SPECIAL], "rel string")
    return C.relations(nodes(spark, d)).exceptAll(listed)


@query(f"""with {_NODES}, x as (select distinct sent_id, idx from nodes),
c as (select distinct a.sent_id from nodes a join nodes b on a.sent_id = b.sent_id and a.head = b.idx and b.head = a.idx)
select n.sent_id, count(*) n, count(*) filter (where head = 0) roots, count(*) filter (where head <> 0 and x.idx is null) dangling,
  n.sent_id not in (select sent_id from c) no_short_cycle
from nodes n left join x on n.sent_id = x.sent_id and n.head = x.idx group by n.sent_id""")
def tree_valid(spark, d):
    return trees.validity(nodes(spark, d))


@query(f"""with recursive {_NODES}, reach(sent_id, idx) as (
select sent_id, idx from nodes where head = 0 union select n.sent_id, n.idx from nodes n join reach r on n.sent_id = r.sent_id and n.head = r.idx),
k as (select sent_id, count(*) c from reach group by sent_id)
select n.sent_id, (count(*) = max(idx) and count(*) = coalesce(any_value(c), 0)) acyclic, count(*) filter (where head = 0) = 1 connected
from nodes n left join k using (sent_id) group by n.sent_id""")
def tree_acyclic(spark, d):
    return trees.acyclic(nodes(spark, d))


@query(f"""with recursive {_NODES}, reach(sent_id, idx, depth) as (
select sent_id, idx, 1 from nodes where head = 0 union all select n.sent_id, n.idx, depth + 1 from nodes n join reach r on n.sent_id = r.sent_id and n.head = r.idx)
select sent_id, idx, depth::INT depth from reach""")
def tree_depths(spark, d):
    return trees.depths(nodes(spark, d))


@query(f"""with {_NODES} select sent_id, idx, case when not exists (select 1 from nodes m where m.sent_id = n.sent_id and m.head = n.idx) then 'leaf' else 'root' end kind
from nodes n where head = 0 or not exists (select 1 from nodes m where m.sent_id = n.sent_id and m.head = n.idx)""")
def leaves_roots(spark, d):
    n = nodes(spark, d)
    leaf = trees.leaves(n).select("sent_id", "idx", F.lit("leaf").alias("kind"))
    inner = trees.roots(n).select("sent_id", "idx").join(leaf.select("sent_id", "idx"), ["sent_id", "idx"], "left_anti")
    return leaf.unionByName(inner.withColumn("kind", F.lit("root")))


@query(f"with {_NODES} select sent_id, head parent, count(*) children from nodes where head <> 0 group by 1, 2")
def tree_edges(spark, d):
    return trees.fan_out(nodes(spark, d))


@query("select line_id, ((line_id - 1) // 1000)::BIGINT batch from bllip_file")
def minibatch_ids(spark, d):
    return C.minibatches(table(spark, d, "bllip_file").select("line_id"), 1000, F.col("line_id"))


@query(f"""with {_SENTS} select (select count(*) from (select distinct sent_id from toks)) n_sentences, count(*) n_tokens, count(distinct word) n_types,
(select max(len(words)) from sents) longest from toks""")
def corpus_counts(spark, d):
    return C.counts(toks(spark, d))


@query(f"with {_NODES} select lemma word, count(*) freq from nodes group by lemma union all select '*root*', count(distinct sent_id) from nodes")
def lemma_freq_root(spark, d):
    t = nodes(spark, d).select("sent_id", F.col("lemma").alias("word"))
    return C.frequencies(t).unionByName(C.root_frequency(t))


@query(r"""with l as (select line_id, file_name, sum(case when regexp_full_match(toks, '[ \t]*') or starts_with(toks, '-DOCSTART') then 1 else 0 end) over (partition by file_name order by line_id) s,
regexp_full_match(toks, '[ \t]*') or starts_with(toks, '-DOCSTART') b from ner2003_raw where toks is not null)
select file_name, s::BIGINT segment, count(*) n_lines, min(line_id) first_line from l where not b group by 1, 2""")
def segment_lines(spark, d):
    """Sentences of raw lines between blank lines and document headers."""
    from latentia.sources.readers import segments

    rows = table(spark, d, "ner2003_raw").where("toks is not null")
    boundary = F.col("toks").rlike(r"\A[ \t]*\z") | F.col("toks").startswith("-DOCSTART")
    return segments(rows, boundary, "file_name", "line_id").groupBy("file_name", "segment").agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_line"))

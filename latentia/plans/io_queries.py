"""Files: every format is written by its writer, read again by its reader, and compared with the tables it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from latentia.operators import corpus as C, introspect as I, ner as N, params as P
from latentia.plans.corpus_queries import _NODES, _SENTS, nodes, sents
from latentia.plans.rep_queries import _BROWN, _EP, _EPX, _NER, _TAGGED, brown, ep, ner, tagged
from latentia.session import table, work_dir
from latentia.sources import readers as R, writers as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession, what: str) -> str:
    return f"{work_dir(spark)}/files-{what}-{uuid.uuid4().hex}"


def ascii_only(c: str):
    """Words without blanks and signs that a format cannot hold."""
    return F.regexp_replace(c, r"[^\x21-\x7E]", "?")


_ASCII = r"regexp_replace({}, '[^\x21-\x7E]', '?', 'g')"
_ASCII_NER = f"{_NER}, a as (select dense_rank() over (order by sent_id) sent_id, (row_number() over (partition by sent_id order by pos) - 1)::INT pos, {_ASCII.format('word')} word, tag from ner where word <> '')"


def plain_ner(spark: SparkSession, d: str) -> DataFrame:
    return ner(spark, d).where("word <> ''").select("sent_id", "pos", ascii_only("word").alias("word"), "tag")


@query(f"with {_SENTS} select row_number() over (order by sent_id) sent_id, words from sents")
def io_text(spark, d):
    """Lines in several files come back with one numbering."""
    at = folder(spark, "text")
    W.sentences(sents(spark, d).select("sent_id", F.array_join("words", " ").alias("line")), at)
    return R.text_corpus(spark, at)


@query(f"with {_SENTS} select row_number() over (order by sent_id) sent_id, len(words)::INT n from sents qualify row_number() over (order by sent_id) <= 500")
def io_text_first(spark, d):
    """The first 500 sentences of a corpus of several files."""
    at = folder(spark, "text")
    W.sentences(sents(spark, d).select("sent_id", F.array_join("words", " ").alias("line")), at)
    return R.text_corpus(spark, at, 500).select("sent_id", F.size("words").alias("n"))


@query(f"with {_SENTS}, l as (select row_number() over (order by sent_id) - 1 line_id, array_to_string(words, ' ') line from sents) select line_id, line from l")
def io_lines(spark, d):
    at = folder(spark, "lines")
    W.sentences(sents(spark, d).select("sent_id", F.array_join("words", " ").alias("line")), at)
    return R.numbered_lines(spark, at).select("line_id", "line")


@query(f"with {_NODES} select dense_rank() over (order by sent_id) sent_id, idx, form, lemma, cpos, pos, feats, head, rel from nodes")
def io_conll(spark, d):
    at = folder(spark, "conll")
    W.conll(nodes(spark, d), at)
    return R.conll_corpus(spark, at).select("sent_id", "idx", "form", "lemma", "cpos", "pos", "feats", "head", "rel")


@query(f"with {_NODES} select sent_id, string_agg(form, ' ' order by idx) forms, string_agg(lemma, ' ' order by idx) lemmas from nodes group by sent_id")
def conll_strings(spark, d):
    n = nodes(spark, d)
    return C.strings(n, "form").withColumnRenamed("line", "forms").join(C.strings(n, "lemma").withColumnRenamed("line", "lemmas"), "sent_id")


@query(f"with {_ASCII_NER} select sent_id, pos, word, 'N' pos_tag, tag from a")
def io_ner2002(spark, d):
    at = folder(spark, "ner2002")
    W.lemmatized(plain_ner(spark, d).withColumn("pos_tag", F.lit("N")), at)
    return R.ner2002(spark, at).select("sent_id", "pos", "word", "pos_tag", "tag")


@query(f"with {_ASCII_NER}, n as (select sent_id from a group by 1 having count(*) < 12) select sent_id, pos, word, tag from a where sent_id <= 200 and sent_id in (select sent_id from n)")
def io_ner2002_limits(spark, d):
    """Only the first 200 sentences, and of them those of fewer than 12 words."""
    at = folder(spark, "ner2002")
    W.lemmatized(plain_ner(spark, d).withColumn("pos_tag", F.lit("N")), at)
    return R.ner2002(spark, at, first=200, longest=12).select("sent_id", "pos", "word", "tag")


@query(f"with {_ASCII_NER}, n as (select distinct sent_id s0, dense_rank() over (order by sent_id) sent_id from ner where word <> '') select sent_id, s0 % 7 = 0 header from n")
def io_docstarts(spark, d):
    """Document headers are written before every seventh sentence and found again."""
    at = folder(spark, "docs")
    rows = plain_ner(spark, d).withColumn("pos_tag", F.lit("N"))
    W.lemmatized(rows, at, rows.where("sent_id % 7 = 0").select("sent_id"))
    heads = R.docstarts(spark, at).withColumn("h", F.lit(True))
    return R.ner2002(spark, at).select("sent_id").distinct().join(heads, "sent_id", "left").select("sent_id", F.col("h").isNotNull().alias("header"))


@query(f"with {_ASCII_NER} select sent_id, pos, word, tag from a")
def io_ner2003(spark, d):
    at = folder(spark, "ner2003")
    rows = plain_ner(spark, d).select("sent_id", "pos", F.concat_ws("\t", "tag", F.lit("0\t0\tX\tN"), "word", F.lit("x\tx\t0")).alias("l"))
    blocks = rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "l"))).alias("a"))
    W.sentences(blocks.select("sent_id", F.concat(F.array_join(F.transform("a", lambda x: x["l"]), "\n"), F.lit("\n")).alias("line")), at)
    return R.ner2003(spark, at).select("sent_id", "pos", "word", "tag")


@query(f"with {_ASCII_NER}, k as (select distinct word from vocab where word is not null) select sent_id, pos, coalesce(k.word, '*unk*') word from a left join k using (word)")
def io_ner_words(spark, d):
    """Words without tags, unknown ones replaced."""
    at = folder(spark, "words")
    W.lemmatized(plain_ner(spark, d).withColumn("pos_tag", F.lit("N")), at)
    return R.ner_words(spark, at, table(spark, d, "vocab").where("word is not null")).select("sent_id", "pos", "word")


_PRED = f"{_TAGGED}, a as (select dense_rank() over (order by sent_id) sent_id, (row_number() over (partition by sent_id order by pos) - 1)::INT pos, {_ASCII.format('word')} word, gold, pred from tagged where word <> '')"


def _predicted(spark, d):
    return tagged(spark, d).where("word <> ''").withColumn("word", ascii_only("word"))


@query(f"with {_PRED} select sent_id, pos, word, gold, pred from a")
def io_predictions(spark, d):
    at = folder(spark, "pred")
    W.predictions(_predicted(spark, d), at)
    return R.predictions(spark, at).select("sent_id", "pos", "word", "gold", "pred")


@query(f"with {_PRED} select sent_id, pos, word, gold, case when contains(pred, 'MISC') then 'O' else pred end pred from a")
def io_predictions_muc(spark, d):
    at = folder(spark, "muc")
    W.predictions(_predicted(spark, d), at, muc=True)
    return R.predictions(spark, at).select("sent_id", "pos", "word", "gold", "pred")


@query(f"with {_SENTS} select word, freq from freqs where freq > 3 and word <> ''")
def io_vocabulary(spark, d):
    """Vocabulary file; the reader keeps the more frequent words."""
    at = folder(spark, "vocab")
    W.vocabulary(C.frequencies(C.tokens(sents(spark, d))).where("word <> '' and instr(word, '\t') = 0"), at)
    return R.vocabulary(spark, at, more_than=3)


@query(f"with {_NODES} select distinct rel from nodes")
def io_relations(spark, d):
    at = folder(spark, "rel")
    W.relations(C.relations(nodes(spark, d)), at)
    return spark.read.text(at).select(F.col("value").alias("rel"))


@query(f"with {_NODES} select n.form || chr(9) || h.form || chr(9) || count(*) line from nodes n join nodes h on n.sent_id = h.sent_id and n.head = h.idx group by n.form, h.form")
def io_triples(spark, d):
    at = folder(spark, "triples")
    W.triples(C.head_pairs(nodes(spark, d)).select("dep_word", "head_word", "n"), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query(f"with {_BROWN} select cluster, word, freq from brown where freq is not null")
def io_brown(spark, d):
    at = folder(spark, "brown")
    W.triples(brown(spark, d).where("freq is not null").select("cluster", "word", "freq"), at)
    return R.brown(spark, at)


@query(f"with {_BROWN} select cluster, count(distinct word) n_words from brown where freq is not null group by 1")
def io_brown_words(spark, d):
    at = folder(spark, "brown")
    W.triples(brown(spark, d).where("freq is not null").select("cluster", "word", "freq"), at)
    return R.brown_words(R.brown(spark, at)).select("cluster", F.size("words").cast("long").alias("n_words"))


@query(f"with {_BROWN}, k as (select distinct cluster from brown), n as (select cluster, row_number() over (order by cluster) - 1 k, count(*) over () m from k) select word || chr(9) || array_to_string(list_transform(range(m), lambda i: case when i = k then '1' else '0' end), ' ') line from brown join n using (cluster)")
def io_brown_map(spark, d):
    """Clusters as one-hot vectors."""
    at = folder(spark, "map")
    W.brown_map(brown(spark, d), at, hot=True)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query(f"with {_EP} select 'w' || word_id word, len(v)::INT n, round(list_sum(list_transform(v, lambda x: x::DOUBLE)) * 1e6, 1) total_ppm from ue")
def io_embeddings(spark, d):
    at = folder(spark, "emb")
    W.embeddings(ep(spark, d).select(F.concat(F.lit("w"), F.col("word_id").cast("string")).alias("word"), F.transform("v", lambda x: x.cast("double")).alias("rep")), at, header=False)
    total = F.aggregate("rep", F.lit(0.0), lambda s, x: s + x)
    return R.embeddings(spark, at).select("word", F.size("rep").alias("n"), F.round(total * 1e6, 1).alias("total_ppm"))


@query(f"with {_EP} select count(*) n_vectors, count(*) filter (where word_id % 2 = 0) n_known from ue")
def io_embeddings_vocab(spark, d):
    """Words and vectors apart, in the same order; the reader restricted to a vocabulary."""
    at = folder(spark, "emb")
    rows = ep(spark, d).select(F.concat(F.lit("w"), F.col("word_id").cast("string")).alias("word"), F.transform("v", lambda x: x.cast("double")).alias("rep"))
    W.embeddings_apart(rows, f"{at}/words", f"{at}/vectors")
    W.embeddings(rows, f"{at}/both", header=False)
    apart = R.numbered_lines(spark, f"{at}/words").select("line_id", "line").join(R.numbered_lines(spark, f"{at}/vectors").select("line_id", F.col("line").alias("v")), "line_id")
    known = R.embeddings(spark, f"{at}/both", ep(spark, d).where("word_id % 2 = 0").select(F.concat(F.lit("w"), F.col("word_id").cast("string")).alias("word")))
    same = R.embeddings(spark, f"{at}/both").select(F.col("word").alias("line"), W.numbers(F.col("rep")).alias("v"))
    n = apart.join(same, ["line", "v"]).agg(F.count("*").alias("n_vectors")).withColumn("k", F.lit(1))
    return n.join(known.agg(F.count("*").alias("n_known")).withColumn("k", F.lit(1)), "k").drop("k")


@query(f"with {_EP}, k as (select word_id, v from ue where word_id % 3 = 0) select 'w' || word_id word, count(*) n from (select word_id from ue union all select word_id from k) group by 1")
def io_in_context(spark, d):
    """Token vectors of a file appended to type vectors."""
    at = folder(spark, "incontext")
    rows = ep(spark, d).select("word_id", F.concat(F.lit("w"), F.col("word_id").cast("string")).alias("word"), F.transform("v", lambda x: x.cast("double")).alias("rep"))
    W.token_representations(rows.where("word_id % 3 = 0").select(F.col("word_id").alias("sent_id"), F.lit(0).alias("pos"), "word", "rep"), at)
    return R.with_in_context(rows, spark, at).groupBy("word").agg(F.count("*").alias("n"))


@query(f"with {_EPX}, m as (select word_id, arg_max(state, (p, -state))::INT state from ex group by 1) select state || chr(9) || string_agg('w' || word_id, ' ' order by 'w' || word_id) line from m group by state")
def io_clusters(spark, d):
    at = folder(spark, "clusters")
    W.clusters(I.max_emission(ep(spark, d)).select("state", F.concat(F.lit("w"), F.col("word_id").cast("string")).alias("label")), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("select rep_id || '+' || coalesce(rel, '?') word, len(rep)::INT n from posttypes where rep is not null and len(list_filter(rep, lambda x: isnan(x))) = 0 and len(rep) > 1")
def io_type_representations(spark, d):
    """Keys of word and relation; vectors with NaN are left out."""
    at = folder(spark, "types")
    rows = table(spark, d, "posttypes").where("rep is not null and size(rep) > 1").select(F.col("rep_id").cast("string").alias("word"), F.coalesce("rel", F.lit("?")).alias("rel"), F.transform("rep", lambda x: F.coalesce(x, F.lit(0.0)).cast("double")).alias("rep"))
    W.type_representations(rows, at)
    return R.embeddings(spark, at).select("word", F.size("rep").alias("n"))


@query("select 'init' param, unnest([0, 1])::BIGINT i, 0::BIGINT j, unnest([0.546392, 0.453608])::DOUBLE v union all select 'final', 0, unnest([0, 1]), unnest([0.092784, 0.072165])")
def io_params(spark, d):
    """Parameters of one stage among several, to arrays and back."""
    from latentia.plans.model_queries import fixed

    at = folder(spark, "params")
    W.params(P.split_arrays(fixed(), 0.1), spark, at, "split1")
    W.params(fixed(), spark, at)
    back = P.to_table(spark, P.from_table(R.parameters(spark, at)))
    return back.where("param in ('init', 'final')").select("param", "i", "j", F.round("v", 6).alias("v"))


@query("select 30 n_states, 'x.txt' corpus_file, true omit_class_cond, 2 n_lls")
def io_settings(spark, d):
    """Typed settings out of a text file; the log-likelihoods of each iteration."""
    at = folder(spark, "settings")
    lines = ["Number of states: 30", "Name of the corpus file: x.txt", "Omit class conditioning: True", "", "Likelihood per iteration:", "-3.5"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(at)
    W.settings(spark, {"N": 30}, [-3.5, -3.25], f"{at}-run")
    s, n = R.experiment(spark, at), spark.read.parquet(f"{at}-run/lls").count()
    return spark.createDataFrame([(s["n_states"], s["corpus_file"], s["omit_class_cond"], n)], "n_states int, corpus_file string, omit_class_cond boolean, n_lls int")


@query(f"with {_NER} select 'w' || tag name, count(*)::DOUBLE w from ner group by 1")
def io_weights(spark, d):
    """Weights of a tagger, saved and loaded."""
    at = folder(spark, "weights")
    W.weights(ner(spark, d).groupBy("tag").agg(F.count("*").alias("n")).select(F.concat(F.lit("w"), "tag").alias("name"), F.array(F.col("n").cast("double")).alias("w")), at)
    return R.weights(spark, at).select("name", F.col("w")[0].alias("w"))


@query(f"with {_NER} select sent_id, count(*) n_tokens, string_agg(tag, ' ' order by pos) tags from ner group by sent_id")
def io_sequences(spark, d):
    """Labelled sequences, saved and loaded."""
    at = folder(spark, "sequences")
    held = F.array_sort(F.collect_list(F.struct("pos", "word", "tag")))
    W.sequences(ner(spark, d).groupBy("sent_id").agg(held.alias("a")), at)
    return R.sequences(spark, at).select("sent_id", F.size("a").cast("long").alias("n_tokens"), F.array_join(F.transform("a", lambda x: x["tag"]), " ").alias("tags"))


@query(f"with {_NER}, k as (select sent_id, pos, 'L' || pos lemma from ner where sent_id % 2 = 0) select sent_id, pos, coalesce(lemma, word) word from ner left join k using (sent_id, pos)")
def ner_lemmas(spark, d):
    """Words replaced by the lemmas of their sentence's parse where there is one."""
    toks = ner(spark, d)
    parses = toks.where("sent_id % 2 = 0").select("sent_id", (F.col("pos") + 1).alias("idx"), F.concat(F.lit("L"), F.col("pos").cast("string")).alias("lemma"))
    return W.with_lemmas(toks, parses).select("sent_id", "pos", "word")


@query("select file_no, row_number() over (order by file_no)::INT position from (select distinct line_id % 40 file_no from bllip_file)")
def io_parsed_index(spark, d):
    """Positions of files by the number in their name."""
    at = folder(spark, "index")
    rows = table(spark, d, "bllip_file").select(F.coalesce("line", F.lit("")).alias("value"), (F.col("line_id") % 40).alias("n"))
    rows.repartition("n").write.partitionBy("n").mode("overwrite").text(at)
    return R.parsed_index(spark, at, r"/n=(\d+)/[^/]*$").select("file_no", "position").distinct()


@query("select 'f' || n label, 1::BIGINT files from (select unnest(range(1, 4)) n) where n <> 2")
def io_listing(spark, d):
    """Files of a folder by a part of their path."""
    at = folder(spark, "list")
    for n in (1, 2, 3):
        spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.text(f"{at}/f{n}")
    got = R.listing(spark, at, "part-").select(F.regexp_extract("file", r"/(f\d)/", 1).alias("label"))
    return got.where("label <> 'f2'").groupBy("label").agg(F.count("*").alias("files"))


@query(f"with {_NODES} select sent_id, bool_or(rel = 'SBJ') has_sbj, bool_or(pos = 'VB') has_verb from nodes group by 1")
def contains_node(spark, d):
    """Sentences with a relation, and with a part of speech."""
    n = nodes(spark, d)
    sbj, verb = C.sentences_with(n, "rel", "SBJ").withColumn("a", F.lit(True)), C.sentences_with(n, "pos", "VB").withColumn("b", F.lit(True))
    return n.select("sent_id").distinct().join(sbj, "sent_id", "left").join(verb, "sent_id", "left").select("sent_id", F.col("a").isNotNull().alias("has_sbj"), F.col("b").isNotNull().alias("has_verb"))


_EQUAL = f"""{_NODES}, l as (select sent_id, list(head order by idx) h, list(rel order by idx) r from nodes group by 1),
m as (select sent_id, list(case when sent_id % 3 = 0 and idx = 1 then head + 1 else head end order by idx) h, list(case when sent_id % 2 = 0 and idx = 1 then 'X' else rel end order by idx) r from nodes group by 1)"""


@query(f"with {_EQUAL} select sent_id, l.h = m.h heads, l.r = m.r labels, l.h = m.h and l.r = m.r as both from l join m using (sent_id)")
def equal_trees(spark, d):
    """Equality of heads, of labels and of both with a corpus that differs in places."""
    n = nodes(spark, d)
    changed = n.withColumn("head", F.when((F.col("sent_id") % 3 == 0) & (F.col("idx") == 1), F.col("head") + 1).otherwise(F.col("head"))).withColumn("rel", F.when((F.col("sent_id") % 2 == 0) & (F.col("idx") == 1), "X").otherwise(F.col("rel")))
    out = C.equal_in(n, changed, ["head"]).withColumnRenamed("same", "heads")
    return out.join(C.equal_in(n, changed, ["rel"]).withColumnRenamed("same", "labels"), "sent_id").join(C.equal_in(n, changed, ["head", "rel"]).withColumnRenamed("same", "both"), "sent_id")


@query(f"with {_NODES}, k as (select distinct word from vocab where word is not null) select sent_id, idx, coalesce(a.word, b.word, '*unk*') norm from nodes n left join k a on n.form = a.word left join k b on lower(n.form) = b.word")
def normalize_tree(spark, d):
    """Node words by exact, lower-cased or unknown form."""
    known = table(spark, d, "vocab").where("word is not null")
    return C.normalized(nodes(spark, d).select("sent_id", "idx", F.col("form").alias("word")), known).select("sent_id", "idx", "norm")


@query(f"with {_NER}, s as (select distinct sent_id from ner), p as (select sent_id, idx, lemma from (select sent_id * 2 sent_id, pos + 1 idx, 'P' || word lemma from ner)) select s.sent_id, count(p.idx) n_nodes, p.sent_id is null as missing from s left join p using (sent_id) group by s.sent_id, p.sent_id is null")
def ner_parses(spark, d):
    """Sentences with their parse, by file number; those without one are kept."""
    toks = ner(spark, d)
    parses = toks.select((F.col("sent_id")).alias("sent_id"), (F.col("pos") + 1).alias("idx"))
    index = toks.select("sent_id").distinct().select((F.col("sent_id") * 2).alias("file_no"), F.col("sent_id").alias("position"))
    got = N.with_parses(toks, parses, index).groupBy("sent_id").agg(F.count("*").alias("n_nodes"))
    return toks.select("sent_id").distinct().join(got, "sent_id", "left").select("sent_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.col("n_nodes").isNull().alias("missing"))


@query("select word, case when regexp_full_match(word, '[+-]?\\p{Nd}[\\p{Nd}.,:/-]*') then '*num*' else word end masked, regexp_full_match(word, '[\\p{L}\\p{N}]+') alnum, regexp_full_match(word, '\\p{Nd}+') digit from (select distinct word from ner2003 where word is not null)")
def number_masks(spark, d):
    from latentia.functions import text as T

    w = table(spark, d, "ner2003").where("word is not null").select("word").distinct()
    return w.select("word", T.number_masked(F.col("word")).alias("masked"), T.is_alnum(F.col("word")).alias("alnum"), T.is_digit(F.col("word")).alias("digit"))


@query("select line_id, ((line_id - 1) // ((select count(*) from bllip_file) // 8 + 1))::BIGINT chunk from bllip_file")
def equal_chunks(spark, d):
    """Eight runs of lines of equal size."""
    return C.chunks(table(spark, d, "bllip_file").select("line_id"), 8, "line_id")


@query(f"""with {_EPX}, b as (select word_id, state, p, row_number() over (partition by word_id order by p desc, state) k from ex where p > 0.00001::DOUBLE)
select state, word_id || '__' || k as label from b where k <= 5""")
def clusters_by_word_always(spark, d):
    """The same clusters with every label numbered."""
    return I.clusters_by_word(ep(spark, d), always=True).select("state", "label")

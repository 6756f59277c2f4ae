"""Corpus preparation: vocabularies, rare words, filters, head-dependent counts, decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from latentia.functions.text import ROOT, UNK, side_of_head, tagged_parts, words
from latentia.session import cut


KEPT_LIMIT = 32_000_000


def sentences(df: DataFrame, sent_id: str, line: str) -> DataFrame:
    """``sent_id, words`` of every non-null line."""
    return df.where(F.col(line).isNotNull()).select(F.col(sent_id).alias("sent_id"), words(F.col(line)).alias("words"))


def tokens(sents: DataFrame) -> DataFrame:
    """``sent_id, pos, word``."""
    return sents.select("sent_id", F.posexplode("words").alias("pos", "word"))


def first_sentences(df: DataFrame, n: int, order: str = "sent_id") -> DataFrame:
    """The first n by their ordinal; deterministic, and pushed into the scan."""
    return df.where(F.col(order) <= n)


def frequencies(toks: DataFrame, word: str = "word") -> DataFrame:
    return toks.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("freq"))


def root_frequency(toks: DataFrame) -> DataFrame:
    """The artificial root occurs once per sentence."""
    return toks.agg(F.count_distinct("sent_id").alias("freq")).select(F.lit(ROOT).alias("word"), "freq")


def ranked(counts: DataFrame) -> DataFrame:
    """``id, word, freq``: 0-based ids by falling frequency, then by word.

    A global order without one task holding all rows: rows are numbered within ranges of the order, and each range is
    shifted by the rows before it; only one count per range is gathered.
    """
    by = [F.col("freq").desc(), F.col("word").asc()]
    # ranges are drawn from a sample: both uses below must see the same ones
    parts = cut(counts.select("word", "freq").repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    local = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*by)))
    # ranges are disjoint in (freq, word): their order is that of their first row
    heads = local.groupBy("part").agg(F.count("*").alias("n"), F.max_by(F.struct((-F.col("freq")).alias("f"), "word"), -F.col("r")).alias("head"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = heads.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "shift")
    return local.join(F.broadcast(shift), "part").select((F.col("r") - 1 + F.col("shift")).cast("long").alias("id"), "word", "freq")


def min_frequency(vocab: DataFrame, least: int) -> DataFrame:
    """Strictly more frequent words."""
    return vocab.where(F.col("freq") > least)


def replace_rare(toks: DataFrame, counts: DataFrame, threshold: int, strict: bool = False, word: str = "word") -> DataFrame:
    """Words of frequency <= threshold (``strict``: <) become ``*unk*``.

    Kept words are broadcast where they hold at most ``KEPT_LIMIT`` characters, so that no token is shuffled and no
    frequent word is one task; beyond that they are joined by a shuffle.
    """
    rare = F.col("freq") < threshold if strict else F.col("freq") <= threshold
    kept = cut(counts.where(~rare).select(F.col("word").alias("_kept")), "kept")
    size = kept.agg(F.sum(F.length("_kept") + 16)).first()[0] or 0
    kept = F.broadcast(kept) if size <= KEPT_LIMIT else kept
    return toks.join(kept, F.col(word) == F.col("_kept"), "left").withColumn(word, F.coalesce("_kept", F.lit(UNK))).drop("_kept")


def with_ids(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``sent_id, pos, word_id``; a vocabulary of at most ``KEPT_LIMIT`` characters is broadcast, so that frequent words are no hot keys."""
    ids = cut(vocab.select("word", F.col("id").alias("word_id")), "ids")
    size = ids.agg(F.sum(F.length("word") + 24)).first()[0] or 0
    return toks.join(F.broadcast(ids) if size <= KEPT_LIMIT else ids, "word").select("sent_id", "pos", "word_id")


def reassembled(toks: DataFrame) -> DataFrame:
    """Tokens back to lines."""
    return toks.groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda t: t["word"]), " ").alias("line"))


def length_between(sents: DataFrame, least: int, most: int) -> DataFrame:
    """Exclusive at both ends."""
    return sents.where((F.size("words") > least) & (F.size("words") < most))


def filter_sentences(sents: DataFrame, least: int, most: int, freq: int | None = None) -> DataFrame:
    """Length filter, then rare-word replacement (strict) by the frequencies of the whole corpus."""
    kept = length_between(sents, least, most)
    return reassembled(replace_rare(tokens(kept), frequencies(tokens(sents)), freq, strict=True) if freq else tokens(kept))


def normalized(toks: DataFrame, known: DataFrame) -> DataFrame:
    """Exact match, else lower-cased match, else ``*unk*``; adds ``norm``."""
    k = known.select("word").distinct()
    exact, lower = k.select(F.col("word").alias("_a")), k.select(F.col("word").alias("_b"))
    joined = toks.join(exact, F.col("word") == F.col("_a"), "left").join(lower, F.lower("word") == F.col("_b"), "left")
    return joined.withColumn("norm", F.coalesce("_a", "_b", F.lit(UNK))).drop("_a", "_b")


def without_known(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left anti join that keeps the duplicates of the left side."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def parsed_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ten-column dependency sentences inside texts: ``sent_id, idx, form, lemma, cpos, pos, feats, head, rel``.

    Blank lines separate sentences; a block is a sentence only if all its lines have ten columns, numeric ids and
    heads; carriage returns are dropped. sent_id = doc_id * 1,000,000 + block.
    """
    clean = F.replace(F.col(text), F.lit("\r"), F.lit(""))
    blocks = docs.where(F.col(text).contains("\t")).select(F.col(doc_id).alias("d"), F.posexplode(F.split(clean, r"\n\n+")).alias("b", "block"))
    number_of = F.when(F.col("b") < 1_000_000, F.col("d") * 1_000_000 + F.col("b")).otherwise(F.raise_error(F.lit("a text of more than a million blocks")).cast("long"))
    blocks = blocks.select(number_of.alias("sent_id"), F.transform(F.filter(F.split("block", r"\n"), lambda x: x != ""), lambda x: F.split(x, "\t", -1)).alias("rows"))
    number = lambda c: c.rlike("^[0-9]{1,9}$")
    good = blocks.where((F.size("rows") > 0) & F.forall("rows", lambda r: (F.size(r) == 10) & number(r[0]) & number(r[6])))
    r = F.col("r")
    return good.select("sent_id", F.explode("rows").alias("r")).select(
        "sent_id", r[0].cast("int").alias("idx"), r[1].alias("form"), r[2].alias("lemma"), r[3].alias("cpos"), r[4].alias("pos"), r[5].alias("feats"), r[6].cast("int").alias("head"), r[7].alias("rel")
    )


def tagged_nodes(df: DataFrame, line_id: str, line: str) -> DataFrame:
    """``word/tag`` lines as tokens: ``sent_id, idx, form, tag``; bad tokens are skipped, the index goes on."""
    toks = df.where(F.col(line).isNotNull()).select(F.col(line_id).alias("sent_id"), F.posexplode(F.filter(F.split(line, " "), lambda t: t != "")).alias("p", "t"))
    word, tag = tagged_parts(F.col("t"))
    return toks.where(F.col("t").rlike("(?s)^.+/[^/]+$")).select("sent_id", (F.col("p") + 1).alias("idx"), word.alias("form"), tag.alias("tag"))


def with_heads(nodes: DataFrame, form: str = "form") -> DataFrame:
    """Head self-join inside the sentence; ``head_word`` is null at the root."""
    heads = nodes.select(F.col("sent_id").alias("_s"), F.col("idx").alias("_i"), F.col(form).alias("head_word"))
    return nodes.join(heads, (F.col("sent_id") == F.col("_s")) & (F.col("head") == F.col("_i")), "left").drop("_s", "_i")


def head_pairs(nodes: DataFrame, form: str = "form") -> DataFrame:
    """How often each (dependent, head) occurs in the corpus; the root's dependents are skipped."""
    return with_heads(nodes, form).where("head_word is not null").groupBy(F.col(form).alias("dep_word"), "head_word").agg(F.count("*").alias("n"))


def triples(nodes: DataFrame, form: str = "lemma") -> DataFrame:
    """Per sentence counts of (rel, head, dependent); ``<root-LEMMA>`` for head 0; spaces removed."""
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    head = F.when(F.col("head") == 0, F.lit("<root-LEMMA>")).otherwise(F.col("head_word"))
    return (
        with_heads(nodes, form).withColumn("h", squeezed(head)).withColumn("d", squeezed(F.col(form))).where("h is not null")
        .groupBy("sent_id", "rel", "h", "d").agg(F.count("*").alias("n"))
    )


def triple_marginals(per_sentence: DataFrame) -> DataFrame:
    """Corpus counts at three granularities; the marginals count distinct triples of a sentence, not tokens."""
    full = per_sentence.groupBy("rel", "h", "d").agg(F.sum("n").alias("n"))
    by = per_sentence.groupingSets([[F.col("rel"), F.col("h")], [F.col("rel"), F.col("d")]], F.col("rel"), F.col("h"), F.col("d")).agg(F.count("*").alias("n"))
    return full.unionByName(by)


def relations(nodes: DataFrame) -> DataFrame:
    return nodes.select("rel").distinct()


def with_side(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("side", side_of_head(F.col("idx"), F.col("head")))


def containing(sents: DataFrame, column: str, value: str) -> DataFrame:
    """Sentences whose array column holds the value."""
    return sents.where(F.array_contains(column, value))


def words_of_pos(nodes: DataFrame, tags: list[str], keep: str = "lemma") -> DataFrame:
    """Per sentence the kept column of tokens whose tag is listed, in order."""
    held = nodes.where(F.col("pos").isin(tags)).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", keep))).alias("w"))
    return held.select("sent_id", F.array_join(F.transform("w", lambda x: x[keep]), " ").alias("words"))


def equal_prefix(a: Column, b: Column) -> Column:
    """Whether two arrays agree up to the shorter one's end."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n) == F.slice(b, 1, n)


def equal_in(nodes: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """``sent_id, same``: whether sentences of two corpora agree in these columns, up to the shorter one's end."""
    held = lambda df, p: df.groupBy("sent_id").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(c).alias("v")))), lambda x: x["v"]).alias(f"{p}{i}") for i, c in enumerate(columns)])
    both = held(nodes, "_a").join(held(other, "_b"), "sent_id")
    same = F.lit(True)
    for i in range(len(columns)):
        same = same & equal_prefix(F.col(f"_a{i}"), F.col(f"_b{i}"))
    return both.select("sent_id", same.alias("same"))


def sentences_with(nodes: DataFrame, column: str, value: str) -> DataFrame:
    """``sent_id`` of sentences one of whose nodes has the value."""
    return nodes.where(F.col(column) == value).select("sent_id").distinct()


def strings(nodes: DataFrame, column: str = "form") -> DataFrame:
    """``sent_id, line``: forms or lemmas of each sentence in order."""
    return reassembled(nodes.select("sent_id", F.col("idx").alias("pos"), F.col(column).alias("word")))


def chunks(df: DataFrame, n: int, order: str) -> DataFrame:
    """Adds ``chunk``: n runs of rows of equal size (the last ones may be shorter or missing), by an ordinal from 1."""
    size = df.count() // n + 1
    return df.withColumn("chunk", F.floor((F.col(order) - 1) / size).cast("long"))


def minibatches(df: DataFrame, size: int, order: Column) -> DataFrame:
    """Count-based tumbling chunks of sequences in the given order (an unique ordinal from 1): adds ``batch``."""
    return df.withColumn("batch", F.floor((order - 1) / size).cast("long"))


def counts(toks: DataFrame) -> DataFrame:
    """One row: sentences, tokens, types, longest sentence."""
    per = toks.groupBy("sent_id").agg(F.count("*").alias("n"))
    types = toks.groupBy("word").agg(F.count("*").alias("c")).agg(F.count("*").alias("n_types"), F.sum("c").alias("n_tokens"))
    return per.agg(F.count("*").alias("n_sentences"), F.max("n").alias("longest")).withColumn("k", F.lit(1)).join(types.withColumn("k", F.lit(1)), "k").drop("k")

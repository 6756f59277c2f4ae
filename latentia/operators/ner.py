"""Entity recognition with word representations: apply a model to tagged tokens, featurize, train, decode, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latentia.operators import corpus as C, decode as D, em as E, features as FT, metrics as M, perceptron as PC
from latentia.operators.params import Params


def word_ids(toks: DataFrame, vocab: DataFrame, unk: str = "*unk*") -> DataFrame:
    """Adds ``word_id``: of the word, else of its lower-cased form, else of ``*unk*``; tokens without any are dropped
    by none: their id is null. Emission rows ``e`` of a vocabulary come along."""
    norm = C.normalized(toks, vocab)
    ids = vocab.select(F.col("word").alias("norm"), F.col("id").alias("word_id"), *[c for c in ("e",) if c in vocab.columns])
    return norm.join(ids, "norm", "left").drop("norm")


def represented(toks: DataFrame, vocab: DataFrame, p: Params, method: str = "posterior_cont", approx: bool = False) -> DataFrame:
    """Tokens with ``rep`` (a vector) or ``state`` by any chain decoder, or by type averages (``posterior_cont_type``).

    A vocabulary too large for its emissions to be broadcast holds them as ``e array<double>``, by state; p.E is not used
    then, and sentences with a known word without emissions get nothing.
    """
    known = word_ids(toks, vocab).where("word_id is not null")
    given = "e" in vocab.columns
    data = E.as_sequences(known, emissions=given)
    if given:
        data = data.where(~F.exists("e", lambda v: v.isNull()))
    # positions of a sentence's known tokens, in order, to put decoded values back
    places = known.groupBy("sent_id").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    method = method.replace("-", "_")
    if method == "posterior_cont_type":
        got = D.type_decode(data, D.type_posteriors(data, p, approx)).withColumnRenamed("pos", "k")
    else:
        column = "reps" if method == "posterior_cont" else "states"
        got = D.decode(data, p, method, approx).select("sent_id", F.posexplode(column).alias("k", "rep" if column == "reps" else "state"))
    at = got.join(places, "sent_id").withColumn("pos", F.col("places")[F.col("k")]).drop("places", "k")
    return toks.join(at, ["sent_id", "pos"], "left")


def tree_represented(toks: DataFrame, parses: DataFrame, vocab: DataFrame, p: Params, method: str = "posterior_cont", relations: list[str] | None = None, ignore_rel: str | None = None, approx: bool = False) -> DataFrame:
    """Tokens with ``rep`` or ``state`` from the parses of their sentences, by any tree decoder or by type averages.

    ``parses``: ``sent_id, idx, head, rel, word``, joined by sentence and position (idx - 1); a sentence without a parse
    keeps null. Node words are normalized like tokens (exact, lower-cased, ``*unk*``). ``relations``: the names of the
    model's relations in their order; others count as ``OTHER`` if it has that, else as the first. Nodes of
    ``ignore_rel`` get nothing. Trees with a word that even ``*unk*`` does not cover, or with gaps, get nothing.
    """
    names = relations or []
    other = names.index("OTHER") + 1 if "OTHER" in names else 1
    number = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("rel")), F.lit(0)), F.lit(other)) - 1 if names else F.lit(0)
    known = word_ids(parses.select("sent_id", "idx", "head", "rel", "word"), vocab)
    whole = known.groupBy("sent_id").agg(F.bool_and(F.col("word_id").isNotNull()).alias("all")).where("all").select("sent_id")
    data = E.as_trees(known.join(whole, "sent_id", "left_semi").withColumn("r", number.cast("int")), "word_id", "r")
    skipped = parses.where(F.col("rel") == ignore_rel).select("sent_id", (F.col("idx") - 1).alias("pos")) if ignore_rel is not None else None
    method = method.replace("-", "_")
    if method == "posterior_cont_type":
        by_rel = p.r > 1
        at = D.type_decode(data, D.type_posteriors(data, p, approx, by_rel), by_rel)
    else:
        column = "reps" if method == "posterior_cont" else "states"
        at = D.decode(data, p, method, approx).select("sent_id", F.posexplode(column).alias("pos", "rep" if column == "reps" else "state"))
    if skipped is not None:
        at = at.join(skipped, ["sent_id", "pos"], "left_anti")
    return toks.join(at, ["sent_id", "pos"], "left")


def with_parses(toks: DataFrame, parses: DataFrame, index: DataFrame) -> DataFrame:
    """Parses renumbered to the tokens' sentences: the n-th parse belongs to the sentence that the n-th file number names.

    ``index``: ``file_no, position``. Sentences without a file have no parse.
    """
    at = index.select(F.col("position").cast("long").alias("sent_id"), F.col("file_no").alias("_s"))
    return parses.join(at, "sent_id").drop("sent_id").withColumnRenamed("_s", "sent_id").join(toks.select("sent_id").distinct(), "sent_id", "left_semi")


def embedded(toks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return D.token_embeddings(toks, embeddings)


def aligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold and predicted tags by position; raises where the numbers of tokens differ."""
    both = gold.select("sent_id", "pos", "word", F.col("tag").alias("gold")).join(pred.select("sent_id", "pos", "pred"), ["sent_id", "pos"], "full")
    checked = F.when(F.col("gold").isNull() | F.col("pred").isNull(), F.raise_error(F.lit("gold and predictions have different tokens"))).otherwise(F.col("gold"))
    return both.withColumn("gold", checked)


#: Where each language takes features from: offsets of clusters and of representations, and lengths of cluster prefixes.
LANGUAGES = {
    "en": {"brown_window": (-2, -1, 0, 1, 2), "prefixes": FT.PREFIX_LENGTHS, "window": (0,)},
    "nl": {"brown_window": (-2, -1, 0, 1, 2), "prefixes": (), "window": (0, 1)},
}


def features(
    toks: DataFrame, brown: DataFrame | None = None, rep: str | None = None, chosen: tuple[str, ...] = FT.BASELINE, window: tuple[int, ...] = (0,), brown_window: tuple[int, ...] = (0,), prefixes: tuple[int, ...] = FT.PREFIX_LENGTHS,
    rep_name: str = "rep",
) -> DataFrame:
    """Baseline features, clusters with their prefixes and representation features (named ``rep_name``) at the given offsets."""
    out = FT.emission(FT.windowed(toks), chosen)
    if brown is not None:
        held = FT.with_brown(toks, brown)
        for k in brown_window:
            at = held if not k else toks.select("sent_id", "pos", "tag").join(held.select("sent_id", (F.col("pos") - k).alias("pos"), "cluster"), ["sent_id", "pos"])
            out = out.unionByName(FT.brown_emission(at, prefixes, f"brown{k:+d}" if k else "brown"))
    if rep is not None:
        for k in window:
            moved = toks.select("sent_id", (F.col("pos") - k).alias("pos"), F.col(rep).alias("r"))
            at = toks.select("sent_id", "pos", "tag").join(moved, ["sent_id", "pos"])
            out = out.unionByName(FT.representation(at, "r", f"{rep_name}{k:+d}" if k else rep_name, continuous=rep == "rep"))
    return out


def experiment(train: DataFrame | None, test: DataFrame, tags: list[str], epochs: int = 2, shards: int | None = None, weights: DataFrame | None = None, keep=None, **chosen) -> tuple[DataFrame, DataFrame]:
    """Trains on one set of tokens (or takes trained weights), decodes the other: predictions ``sent_id, pos, gold, pred`` and chunk scores.

    ``keep``: called with the weights.
    """
    w = PC.train(PC.as_sentences(features(train, **chosen)), tags, epochs, shards) if weights is None else weights
    if keep is not None:
        keep(w)
    pred = PC.predict(PC.as_sentences(features(test, **chosen)), w, tags)
    return pred, M.chunk_scores(pred)


def rendered(toks: DataFrame) -> DataFrame:
    """``sent_id, text``: tokens as ``word/tag`` (``-state`` where there is one)."""
    state = F.when(F.col("state").isNotNull(), F.concat(F.lit("-"), F.col("state").cast("string"))).otherwise("") if "state" in toks.columns else F.lit("")
    one = F.concat("word", F.lit("/"), "tag", state)
    held = toks.select("sent_id", "pos", one.alias("t")).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("a"))
    return held.select("sent_id", F.array_join(F.transform("a", lambda x: x["t"]), " ").alias("text"))

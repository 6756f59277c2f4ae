"""Windowed features of tagged tokens for a linear sequence classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from latentia.functions import text as T

LEFT, RIGHT = "out-of-seq-left", "out-of-seq-right"
BASELINE = ("id", "id-1", "id-2", "id+1", "id+2", "capitalized", "uppercased", "cappattern", "hyphen", "prefix", "suffix")
PREFIX_LENGTHS = (4, 6, 10, 20)


def windowed(toks: DataFrame, reach: int = 2, word: str = "word") -> DataFrame:
    """Adds the words at -reach to +reach, with sentinels beyond the sentence, and the capitalization pattern."""
    w = Window.partitionBy("sent_id").orderBy("pos")
    around = {-k: F.lag(word, k).over(w) for k in range(1, reach + 1)} | {k: F.lead(word, k).over(w) for k in range(1, reach + 1)}
    out = toks.select("*", *[c.alias(f"_w{k:+d}") for k, c in around.items()])
    marks = [T.capital_mark(F.col(f"_w{k:+d}")) if k else T.capital_mark(F.col(word)) for k in range(-reach, reach + 1)]
    out = out.withColumn("cappattern", F.concat(*marks))
    for k in around:
        out = out.withColumn(f"w{k:+d}", F.coalesce(f"_w{k:+d}", F.lit(LEFT if k < 0 else RIGHT))).drop(f"_w{k:+d}")
    return out


def previous_tag(toks: DataFrame, tag: str = "tag") -> DataFrame:
    return toks.withColumn("prev_tag", F.lag(tag, 1).over(Window.partitionBy("sent_id").orderBy("pos")))


def brown_prefixes(cluster: Column, lengths: tuple[int, ...] = PREFIX_LENGTHS) -> Column:
    return F.transform(F.array(*[F.lit(k) for k in lengths]), lambda k: F.substring(cluster, F.lit(1), k))


def with_brown(toks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of the word, else of its lower-cased form."""
    a = clusters.select(F.col("word").alias("_a"), F.col("cluster").alias("_ca"))
    b = clusters.select(F.col("word").alias("_b"), F.col("cluster").alias("_cb"))
    return toks.join(a, F.col("word") == F.col("_a"), "left").join(b, F.lower("word") == F.col("_b"), "left").withColumn("cluster", F.coalesce("_ca", "_cb")).drop("_a", "_b", "_ca", "_cb")


def _named(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), value)


def emission(windows: DataFrame, chosen: tuple[str, ...] = BASELINE, keep: tuple[str, ...] = ("sent_id", "pos", "tag")) -> DataFrame:
    """Adds nothing but rows: one per active feature, ``name`` and ``value``; names do not hold the tag."""
    one = lambda c: F.array(c)
    flag = lambda c, n: F.when(c, F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    word = F.col("word")
    parts = {
        "id": one(_named("id", word)), **{f"id{k:+d}": one(_named(f"id{k:+d}", F.col(f"w{k:+d}"))) for k in (-2, -1, 1, 2)},
        "capitalized": flag(T.is_title(word), "capitalized"), "uppercased": flag(T.is_upper(word), "uppercased"), "cappattern": one(_named("cappattern", F.col("cappattern"))),
        "hyphen": flag(T.has_hyphen(word), "hyphen"), "digit": flag(T.is_digit(word), "digit"), "alnum": flag(T.is_alnum(word), "alnum"),
        "prefix": F.transform(T.prefixes(word), lambda p: _named("prefix", p)), "suffix": F.transform(T.suffixes(word), lambda p: _named("suffix", p)),
    }
    return windows.select(*keep, F.explode(F.concat(*[parts[c] for c in chosen])).alias("name")).withColumn("value", F.lit(1.0))


def brown_emission(toks: DataFrame, lengths: tuple[int, ...] = PREFIX_LENGTHS, name: str = "brown", keep: tuple[str, ...] = ("sent_id", "pos", "tag")) -> DataFrame:
    """Whole cluster and its prefixes; tokens without a cluster have none."""
    whole = F.array(_named(f"{name}_id", F.col("cluster")))
    ids = whole if not lengths else F.concat(whole, F.transform(F.array(*[F.lit(k) for k in lengths]), lambda k: F.concat(F.lit(f"{name}_prefix"), k.cast("string"), F.lit(":"), F.substring(F.col("cluster"), F.lit(1), k))))
    return toks.where("cluster is not null").select(*keep, F.explode(ids).alias("name")).withColumn("value", F.lit(1.0))


def representation(toks: DataFrame, column: str, name: str = "rep", keep: tuple[str, ...] = ("sent_id", "pos", "tag"), continuous: bool = True) -> DataFrame:
    """One real-valued feature per dimension, or one named after a discrete state; missing ones are skipped."""
    rows = toks.where(F.col(column).isNotNull())
    if not continuous:
        return rows.select(*keep, _named(name, F.col(column).cast("string")).alias("name"), F.lit(1.0).alias("value"))
    return rows.select(*keep, F.posexplode(column).alias("d", "value")).select(*keep, F.concat(F.lit(f"{name}:"), F.col("d").cast("string")).alias("name"), F.col("value").cast("double").alias("value"))


def transitions(toks: DataFrame, tag: str = "tag") -> DataFrame:
    """Initial, bigram and final features of a tag sequence: ``sent_id, pos, name``."""
    w = Window.partitionBy("sent_id").orderBy("pos")
    t = toks.select("sent_id", "pos", F.col(tag).alias("y"), F.lag(tag).over(w).alias("p"), F.lead(tag).over(w).alias("n"))
    first = t.where("p is null").select("sent_id", "pos", F.concat(F.lit("init_tag:"), "y").alias("name"))
    pair = t.where("p is not null").select("sent_id", "pos", F.concat(F.lit("prev_tag:"), "p", F.lit("::"), "y").alias("name"))
    last = t.where("n is null").select("sent_id", "pos", F.concat(F.lit("final_prev_tag:"), "y").alias("name"))
    return first.unionByName(pair).unionByName(last)


def dictionary(features: DataFrame) -> DataFrame:
    """``id, name, n``: ids by falling frequency, then by name; a name holds its tag."""
    from latentia.operators.corpus import ranked

    counts = features.select(F.concat("name", F.lit("::"), "tag").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return ranked(counts).select("id", F.col("word").alias("name"), F.col("freq").alias("n"))


def scores(features: DataFrame, weights: DataFrame, tags: list[str]) -> DataFrame:
    """``sent_id, pos, y, score``: sums of value x weight of (name, tag) for every tag; unseen features count 0.

    The tag set is closed; weights are joined by name only, one row per name, so features are not multiplied by tags.
    """
    per_name = weights.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("tag", "weight"))).alias("w"))
    joined = features.join(per_name, "name", "left")
    each = [F.round(F.sum(F.col("value") * F.coalesce(F.try_element_at("w", F.lit(t)), F.lit(0.0))), 6).alias(f"_{i}") for i, t in enumerate(tags)]
    wide = joined.groupBy("sent_id", "pos").agg(*each)
    return wide.select("sent_id", "pos", F.explode(F.array(*[F.struct(F.lit(t).alias("y"), F.col(f"_{i}").alias("score")) for i, t in enumerate(tags)])).alias("s")).select("sent_id", "pos", "s.y", "s.score")

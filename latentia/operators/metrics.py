"""Evaluation of predicted tags: tokens, word types, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OUT = "O"


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and their harmonic mean; 0 where a denominator is 0."""
    p, r = _div(tp, tp + fp), _div(tp, tp + fn)
    return p, r, _div(2 * p * r, p + r)


def _confusion(out: str) -> list[Column]:
    gold, pred = F.col("gold") != out, F.col("pred") != out
    right = F.col("gold") == F.col("pred")
    return [
        F.count_if(gold & right).alias("tp"), F.count_if(pred & ~right).alias("fp"),
        F.count_if(~gold & right).alias("tn"), F.count_if(gold & ~right).alias("fn"),
    ]


def confusion(tagged: DataFrame, out: str = OUT) -> DataFrame:
    """One row: tp, fp, tn, fn over tokens."""
    return tagged.agg(*_confusion(out))


def confusion_by_type(tagged: DataFrame, out: str = OUT) -> DataFrame:
    """The same per word."""
    return tagged.groupBy("word").agg(*_confusion(out))


def type_scores(tagged: DataFrame, out: str = OUT) -> DataFrame:
    """Per word: precision, recall, fscore, and accuracy over its tokens with a gold entity (null without one)."""
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    entity = F.col("tp") + F.col("fn")
    return confusion_by_type(tagged, out).select("word", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("fscore"), F.when(entity > 0, F.round(F.col("tp") / entity, 6)).alias("accuracy"))


def macro_scores(tagged: DataFrame, out: str = OUT) -> DataFrame:
    """Means over word types, with and without zero F-scores."""
    s = type_scores(tagged, out)
    return s.agg(F.round(F.avg("fscore"), 6).alias("fscore"), F.round(F.avg(F.when(F.col("fscore") > 0, F.col("fscore"))), 6).alias("fscore_nonzero"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


def token_accuracy(tagged: DataFrame) -> DataFrame:
    return tagged.agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n_tokens"))


def tag_part(tag: Column) -> Column:
    """Letter before the first hyphen, or the whole tag."""
    return F.when(tag.contains("-"), F.substring_index(tag, "-", 1)).otherwise(tag)


def type_part(tag: Column) -> Column:
    return F.when(tag.contains("-"), F.expr("substring(`_t`, instr(`_t`, '-') + 1)")).otherwise("")


def chunks(tagged: DataFrame, column: str, raw: bool = False, out: str = OUT) -> DataFrame:
    """``sent_id, start, end, type`` of the chunks of a tag column (IOB, IOE or bracket tags).

    ``raw``: tags without a prefix; each becomes ``B-tag``. A chunk starts at the pairs BB IB OB OI EE EI OE, where the
    type changes, or at a bracket; between two tags inside chunks the end rule names the same pairs.
    """
    tag = F.when(F.col(column) == out, F.col(column)).otherwise(F.concat(F.lit("B-"), F.col(column))) if raw else F.col(column)
    rows = tagged.select("sent_id", "pos", tag.alias("_t")).withColumn("k", tag_part(F.col("_t"))).withColumn("type", type_part(F.col("_t")))
    w = Window.partitionBy("sent_id").orderBy("pos")
    rows = rows.withColumn("pk", F.lag("k", 1, "O").over(w)).withColumn("pt", F.lag("type", 1, "").over(w))
    pair = F.concat("pk", "k")
    inside = ~F.col("k").isin("O", ".")
    start = inside & (pair.isin("BB", "IB", "OB", "OI", "EE", "EI", "OE") | (F.col("pt") != F.col("type")) | F.col("k").isin("[", "]") | F.col("pk").isin(".", "[", "]"))
    numbered = rows.withColumn("inside", inside).withColumn("c", F.sum(start.cast("int")).over(w))
    return numbered.where("inside").groupBy("sent_id", "c").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.min_by("type", "pos").alias("type")).drop("c")


def chunk_scores(tagged: DataFrame, raw: bool = False, out: str = OUT) -> DataFrame:
    """Per type and overall (type null): gold, predicted and correct chunks, precision, recall, FB1 in percent."""
    gold, pred = chunks(tagged, "gold", raw, out), chunks(tagged, "pred", raw, out)
    # one hash aggregate instead of a join: a chunk found on both sides is correct
    both = gold.withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(pred.withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    one = both.groupBy("sent_id", "start", "end", "type").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    per = one.rollup("type").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("n_correct"), F.grouping("type").alias("overall"))
    p, r, f = prf(F.col("n_correct"), F.col("n_pred") - F.col("n_correct"), F.col("n_gold") - F.col("n_correct"))
    return per.select("type", "n_gold", "n_pred", "n_correct", F.round(100 * p, 4).alias("precision"), F.round(100 * r, 4).alias("recall"), F.round(100 * f, 4).alias("fb1"))

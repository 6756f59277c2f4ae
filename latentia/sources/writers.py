"""Writers of the text formats. Sentence-shaped outputs keep their order inside sorted files; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from latentia.functions.numeric import one_hot
from latentia.operators.params import Params, to_table


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    """Range-partitioned and sorted: the files in order of name hold the rows in order."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def vocabulary(vocab: DataFrame, path: str) -> None:
    """``word\\tfreq`` lines, by id where there is one."""
    rows = _ordered(vocab, "id") if "id" in vocab.columns else vocab
    rows.select(F.concat_ws("\t", "word", F.col("freq").cast("string")).alias("value")).write.mode("overwrite").text(path)


def relations(names: DataFrame, path: str) -> None:
    names.select(F.col("rel").alias("value")).write.mode("overwrite").text(path)


def sentences(lines: DataFrame, path: str) -> None:
    """``sent_id, line`` as one line per sentence."""
    _ordered(lines, "sent_id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def conll(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ten-column sentences, each followed by a blank line."""
    late = [F.col(c) if c in nodes.columns else F.lit("_") for c in ("phead", "prel")]
    row = F.concat_ws("\t", F.col("idx").cast("string"), "form", "lemma", "cpos", "pos", "feats", F.col("head").cast("string"), "rel", *late)
    blocks = nodes.select("sent_id", "idx", row.alias("row")).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "row"))).alias("a"))
    _ordered(blocks, "sent_id").select(F.concat(F.array_join(F.transform("a", lambda x: x["row"]), "\n"), F.lit("\n")).alias("value")).write.mode(mode).text(path)


def triples(counts: DataFrame, path: str) -> None:
    counts.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in counts.columns]).alias("value")).write.mode("overwrite").text(path)


def params(p: Params, spark, path: str, stage: str = "final") -> None:
    """Long parameter rows, one folder per stage (initial, each split, final)."""
    to_table(spark, p).write.mode("overwrite").parquet(f"{path}/stage={stage}")


def settings(spark, values: dict, lls: list[float], path: str) -> None:
    """One row of settings as JSON, and the log-likelihood of each iteration."""
    spark.createDataFrame([({k: str(v) for k, v in values.items()},)], "settings map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(lls)], "iteration int, ll double").coalesce(1).write.mode("overwrite").parquet(f"{path}/lls")


def predictions(rows: DataFrame, path: str, sep: str = " ", muc: bool = False) -> None:
    """``word gold pred`` lines with a blank line after each sentence; ``muc``: predicted MISC becomes O."""
    pred = F.when(F.col("pred").contains("MISC"), "O").otherwise(F.col("pred")) if muc else F.col("pred")
    line = F.concat_ws(sep, "word", "gold", pred)
    blocks = rows.select("sent_id", "pos", line.alias("l")).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "l"))).alias("a"))
    _ordered(blocks, "sent_id").select(F.concat(F.array_join(F.transform("a", lambda x: x["l"]), "\n"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def numbers(a: Column) -> Column:
    """An array of numbers as text."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


def embeddings(rows: DataFrame, path: str, header: bool = True) -> None:
    """``word v1 v2 ...``; the header ``m n`` is a file of its own that sorts first."""
    rows.select(F.concat_ws(" ", "word", numbers(F.col("rep"))).alias("value")).write.mode("overwrite").text(f"{path}/rows" if header else path)
    if header:
        size = rows.agg(F.count("*").alias("m"), F.max(F.size("rep")).alias("n"))
        size.select(F.concat_ws(" ", F.col("m").cast("string"), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/header")


def embeddings_apart(rows: DataFrame, words_path: str, vectors_path: str) -> None:
    """Words and vectors in separate files, in the same order."""
    held = _ordered(rows, "word")
    held.select(F.col("word").alias("value")).write.mode("overwrite").text(words_path)
    held.select(numbers(F.col("rep")).alias("value")).write.mode("overwrite").text(vectors_path)


def brown_map(clusters: DataFrame, path: str, as_numbers: bool = True, hot: bool = False) -> None:
    """``word rep``: cluster names, consecutive integers, or one-hot vectors."""
    names = clusters.select("cluster").distinct().withColumn("k", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("int"))
    n = names.count()
    rows = clusters.join(F.broadcast(names), "cluster")
    rep = numbers(one_hot(F.col("k"), n)) if hot else F.col("k").cast("string") if as_numbers else F.col("cluster")
    rows.select(F.concat_ws("\t", "word", rep).alias("value")).write.mode("overwrite").text(path)


def clusters(rows: DataFrame, path: str, layout: str = "wide") -> None:
    """``state, label``: one line per state (``wide``), ``state\\tlabel`` lines (``long``), or labels only (``plain``)."""
    if layout == "long":
        out = rows.select(F.concat_ws("\t", F.col("state").cast("string"), "label").alias("value"))
    else:
        held = rows.groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("label")), " ").alias("l"))
        out = held.select((F.col("l") if layout == "plain" else F.concat_ws("\t", F.col("state").cast("string"), "l")).alias("value"))
    out.write.mode("overwrite").text(path)


def type_representations(rows: DataFrame, path: str) -> None:
    """``word v1 ...``, with relations ``word+rel``; representations with NaN are skipped."""
    key = F.concat_ws("+", "word", "rel") if "rel" in rows.columns else F.col("word")
    kept = rows.where(~F.exists("rep", F.isnan))
    kept.select(F.concat_ws(" ", key, numbers(F.col("rep"))).alias("value")).write.mode("overwrite").text(path)


def token_representations(rows: DataFrame, path: str) -> None:
    """``sent_id, pos, word, rep``: in-context vectors, one token per line."""
    _ordered(rows, "sent_id", "pos").select(F.concat_ws(" ", "word", numbers(F.col("rep"))).alias("value")).write.mode("overwrite").text(path)


def planar_map(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", F.col("word_id").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")).alias("value")).write.mode("overwrite").text(path)


def weights(w: DataFrame, path: str) -> None:
    """Weights of a tagger: ``name, w``."""
    w.select("name", "w").write.mode("overwrite").parquet(path)


def sequences(rows: DataFrame, path: str) -> None:
    """Indexed sequences, to be read again as they are."""
    rows.write.mode("overwrite").parquet(path)


def lemmatized(toks: DataFrame, path: str, docstarts: DataFrame | None = None, header: str = "-DOCSTART- -DOCSTART- O") -> None:
    """``word pos_tag tag`` lines with a blank line after each sentence; a header line before the sentences of ``docstarts(sent_id)``."""
    line = F.concat_ws(" ", "word", "pos_tag", "tag")
    blocks = toks.select("sent_id", "pos", line.alias("l")).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "l"))).alias("a"))
    head = F.lit("")
    if docstarts is not None:
        blocks = blocks.join(docstarts.select("sent_id").distinct().withColumn("_d", F.lit(True)), "sent_id", "left")
        head = F.when(F.col("_d"), header + "\n").otherwise("")
    _ordered(blocks, "sent_id").select(F.concat(head, F.array_join(F.transform("a", lambda x: x["l"]), "\n"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def with_lemmas(toks: DataFrame, parses: DataFrame) -> DataFrame:
    """Words replaced by the lemmas of their parse where there is one (by sentence and position)."""
    lemmas = parses.select("sent_id", (F.col("idx") - 1).alias("pos"), "lemma")
    return toks.join(lemmas, ["sent_id", "pos"], "left").withColumn("word", F.coalesce("lemma", "word")).drop("lemma")

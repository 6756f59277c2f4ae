"""Readers of the text formats. All are lazy DataFrames; files are read once and split by Spark.

Line order matters for sentence boundaries, so lines are numbered within their file: by byte position of the split and
the order in it, never by a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from latentia.functions.text import UNK, words
from latentia.operators.corpus import parsed_nodes
from latentia.session import cut


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """``file``, ``line_no`` (from 0 within the file), ``line_id`` (from 0 over all files in order of name), ``line``.

    The first ``skip`` lines of each file are left out. Lines keep their order inside a split, and a split's number
    orders the splits of a file, so only one count per split is exchanged to number them; files are numbered through by
    one count per split too.
    """
    raw = spark.read.text(path).select("value", "_metadata")
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ASCII"):  # lines are kept as bytes until they are decoded
        raw = raw.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    rows = raw.select(F.coalesce("value", F.lit("")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    local = rows.withColumn("r", F.row_number().over(Window.partitionBy("file", "at").orderBy("m")))
    sizes = local.groupBy("file", "at").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("file", "at", before(Window.partitionBy("file").orderBy("at")).alias("shift"), before(Window.orderBy("file", "at")).alias("total"))  # one row per split
    out = local.join(shift, ["file", "at"]).select("file", (F.col("r") - 1 + F.col("shift")).alias("line_no"), (F.col("r") - 1 + F.col("total")).alias("line_id"), "line")
    return out.where(F.col("line_no") >= skip) if skip else out


def segments(rows: DataFrame, boundary: Column, by: str, order: str) -> DataFrame:
    """Rows between boundary rows, with ``segment``: the number of boundaries before them in their file.

    A file of any length stays distributed: boundaries are counted within ranges of the order, and ranges are shifted
    by the boundaries before them.
    """
    placed = rows.withColumn("_b", boundary.cast("int")).repartitionByRange(by, order).withColumn("_p", F.spark_partition_id())
    placed = cut(placed, "ranges")  # ranges are drawn from a sample: both uses below must see the same ones
    w = Window.partitionBy(by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_c", F.sum("_b").over(w))
    sums = placed.groupBy(by, "_p").agg(F.sum("_b").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sums.select(F.col(by).alias("_f"), F.col("_p").alias("_q"), before.alias("_s"))
    joined = local.join(shift, F.col(by).eqNullSafe(F.col("_f")) & (F.col("_p") == F.col("_q")))
    return joined.where("_b = 0").withColumn("segment", (F.col("_c") + F.col("_s")).cast("long")).drop("_b", "_p", "_c", "_f", "_q", "_s")


def sentences(rows: DataFrame, boundary: Column, by: str = "file", order: str = "line_no", marks: Column | None = None) -> DataFrame:
    """Rows between boundary rows, with ``sent_id``: sentences are numbered from 1 over all files, in order of name.

    With ``marks`` the boundary rows that it holds for, with the number of the next sentence.

    Several boundaries are one, a file's end is one. A file of any length stays distributed: sentences begin at rows
    without a row before them in the sentence; those are counted within ranges of the order, and ranges are shifted by
    the beginnings before them. Only a range's first row needs the range before it.
    """
    placed = rows.withColumn("_b", boundary).repartitionByRange(by, order).withColumn("_p", F.spark_partition_id())
    placed = cut(placed, "ranges")  # ranges are drawn from a sample: both uses below must see the same ones
    w = Window.partitionBy(by, "_p").orderBy(order)
    flagged = placed.withColumn("_l", F.lag("_b").over(w))
    begins = (~F.col("_b") & F.coalesce("_l", F.lit(False))).cast("int")  # a range's first row is judged below
    local = flagged.withColumn("_c", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(by, "_p").agg(F.max("_c").alias("_n"), F.min_by("_b", order).alias("_first"), F.max_by("_b", order).alias("_last"))
    opens = (~F.col("_first") & F.coalesce(F.lag("_last").over(Window.partitionBy(by).orderBy("_p")), F.lit(True))).cast("int")
    ends = ends.withColumn("_o", opens)
    before = F.coalesce(F.sum(F.col("_n") + F.col("_o")).over(Window.orderBy(by, "_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    shift = ends.select(F.col(by).alias("_f"), F.col("_p").alias("_q"), (before + F.col("_o")).alias("_s"))
    wanted = ~F.col("_b") if marks is None else F.col("_b") & marks
    joined = local.where(wanted).join(shift, F.col(by).eqNullSafe(F.col("_f")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("sent_id", (F.col("_c") + F.col("_s") + int(marks is not None)).cast("long")).drop("_b", "_p", "_l", "_c", "_f", "_q", "_s")


def text_corpus(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``sent_id`` (from 1 over all files), ``words``: one sentence per line; only the first ``first`` if given."""
    lines = numbered_lines(spark, path).select((F.col("line_id") + 1).alias("sent_id"), words(F.col("line")).alias("words"))
    return lines if first is None else lines.where(F.col("sent_id") <= first)


def conll_corpus(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Dependency tokens of CoNLL files with 8, 10 or 12 and more columns, sniffed per sentence.

    ``file, sent_id`` (from 1 over all files), ``idx, form, lemma, cpos, pos, feats, head, rel, phead, prel``. A sentence
    of another column count raises. Blank lines separate sentences; a last sentence needs none after it.
    """
    lines = sentences(numbered_lines(spark, path), F.trim("line") == "")
    r = F.split("line", "\t", -1)
    n = F.size(r)
    at = lambda ten, nine: F.when(n >= 12, r[nine]).when((n == 10) | (n == 8), r[ten]).otherwise(F.raise_error(F.concat(F.lit("unknown number of columns in: "), F.col("line"))))
    late = lambda ten, nine: F.when(n >= 12, r[nine]).when(n == 10, r[ten]).otherwise("_")
    cols = {"idx": (0, 0), "form": (1, 1), "lemma": (2, 2), "cpos": (3, 5), "pos": (4, 4), "feats": (5, 6), "head": (6, 8), "rel": (7, 10)}
    ints = ("idx", "head")
    out = lines.select("file", "sent_id", *[at(a, b).cast("int" if c in ints else "string").alias(c) for c, (a, b) in cols.items()], late(8, 9).alias("phead"), late(9, 11).alias("prel"))
    return out if first is None else out.where(F.col("sent_id") <= first)


def parsed_texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The same tokens out of a text column."""
    return parsed_nodes(df, doc_id, text)


def _ner(spark: SparkSession, path: str, encoding: str, sep: str, word: int, tag: int | None, pos: int | None, least: int, first: int | None, longest: int | None = None) -> DataFrame:
    cells = F.split(F.trim("line") if sep == r"\s+" else F.col("line"), sep, -1)
    lines = numbered_lines(spark, path, encoding).withColumn("cells", cells)
    boundary = F.col("line").startswith("-DOCSTART") | (F.size("cells") < least) | (F.trim("line") == "")
    rows = sentences(lines, boundary)
    in_order = Window.partitionBy("sent_id").orderBy("line_no")
    kept = [F.col("cells")[word].alias("word"), *([F.col("cells")[pos].alias("pos_tag")] if pos is not None else []), *([F.col("cells")[tag].alias("tag")] if tag is not None else [])]
    out = rows.select("file", "sent_id", (F.row_number().over(in_order) - 1).cast("int").alias("pos"), *kept)
    if longest is not None:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("sent_id"))).where(F.col("_n") < longest).drop("_n")
    return out if first is None else out.where(F.col("sent_id") <= first)


def ner2002(spark: SparkSession, path: str, first: int | None = None, longest: int | None = None) -> DataFrame:
    """``file, sent_id, pos, word, pos_tag, tag``: white-space columns in latin-1; the last sentence counts too.

    Only the ``first`` sentences, and of them those shorter than ``longest``, if given.
    """
    return _ner(spark, path, "ISO-8859-1", r"\s+", 0, 2, 1, 3, first, longest)


def ner2003(spark: SparkSession, path: str, first: int | None = None, longest: int | None = None) -> DataFrame:
    """``file, sent_id, pos, word, tag``: nine tab-separated columns, tag first, word sixth."""
    return _ner(spark, path, "UTF-8", "\t", 5, 0, None, 9, first, longest)


def docstarts(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id`` of the sentences that follow a document header in files that ``ner2002`` reads."""
    lines = numbered_lines(spark, path, "ISO-8859-1")
    boundary = F.col("line").startswith("-DOCSTART") | (F.size(F.split(F.trim("line"), r"\s+", -1)) < 3)
    return sentences(lines, boundary, marks=F.col("line").startswith("-DOCSTART")).select("sent_id").distinct()


def ner_words(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """NER words without tags, unknown ones as ``*unk*``."""
    known = vocab.select(F.col("word").alias("_k")).distinct()
    rows = _ner(spark, path, "ISO-8859-1", r"\s+", 0, None, None, 1, None)
    return rows.join(known, F.col("word") == F.col("_k"), "left").withColumn("word", F.coalesce("_k", F.lit(UNK))).drop("_k")


def predictions(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """``file, sent_id, pos, word, gold, pred`` of a prediction file."""
    lines = numbered_lines(spark, path).withColumn("cells", F.split("line", sep, -1))
    rows = sentences(lines, F.size("cells") < 3)
    place = (F.row_number().over(Window.partitionBy("sent_id").orderBy("line_no")) - 1).cast("int").alias("pos")
    return rows.select("file", "sent_id", place, *[F.col("cells")[i].alias(c) for i, c in enumerate(("word", "gold", "pred"))])


def vocabulary(spark: SparkSession, path: str, more_than: int | None = None) -> DataFrame:
    """``word, freq`` of a tab-separated file, of a frequency above ``more_than``."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("word string, freq long").csv(path)
    return rows if more_than is None else rows.where(F.col("freq") > more_than)


def brown(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, word, freq``; clusters are bit strings."""
    return spark.read.option("sep", "\t").option("quote", "").schema("cluster string, word string, freq long").csv(path)


def brown_words(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.array_sort(F.collect_set("word")).alias("words"))


def embeddings(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """``word, rep`` of a text file with a header ``m n`` (or none); with a vocabulary only its words.

    A cell that is no number raises.
    """
    cells = F.split("value", " ", -1)
    rows = spark.read.text(path).select(cells.alias("c")).where(F.size("c") > 2)
    number = lambda x: F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("no number in an embedding: "), x)).cast("double"))
    held = F.when(F.element_at("c", -1) == "", F.slice("c", 2, F.size("c") - 2)).otherwise(F.slice("c", 2, F.size("c") - 1))  # a trailing space
    out = rows.select(F.col("c")[0].alias("word"), F.transform(held, number).alias("rep"))
    return out if vocab is None else out.join(vocab.select("word").distinct(), "word", "left_semi")


def in_context(spark: SparkSession, path: str) -> DataFrame:
    """``word, rep`` of token representations, one occurrence a line; a word may have many, and NaN raises."""
    checked = F.transform("rep", lambda x: F.when(F.isnan(x), F.raise_error(F.concat(F.lit("NaN in a representation of "), F.col("word"))).cast("double")).otherwise(x))
    return embeddings(spark, path).select("word", checked.alias("rep"))


def with_in_context(types: DataFrame, spark: SparkSession, path: str | None) -> DataFrame:
    """Type vectors with the in-context vectors of a file, if there is one, appended."""
    return types.select("word", "rep") if path is None else types.select("word", "rep").unionByName(in_context(spark, path))


SETTINGS_LIMIT = 10_000


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """``Key: value`` lines of a settings file; typed casts are the caller's."""
    rows = spark.read.text(path).where(F.col("value").contains(":")).limit(SETTINGS_LIMIT + 1).collect()
    if len(rows) > SETTINGS_LIMIT:
        raise ValueError(f"{path} is no settings file: it has more than {SETTINGS_LIMIT} keys")
    return {k.strip(): v.strip() for k, v in (r.value.split(":", 1) for r in rows)}


def settings_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """The settings that a training wrote."""
    return dict(spark.read.schema("settings map<string,string>").json(f"{folder}/settings").first().settings)


def experiment(spark: SparkSession, path: str) -> dict:
    """Typed fields of a settings file: counts by their keys, whether relations condition classes and emissions."""
    s = settings(spark, path)
    number = lambda k: int(s[k].split()[-1]) if k in s and s[k].split()[-1].isdigit() else None
    flag = lambda k: {"True": True, "False": False}.get(s.get(k, ""))
    return {
        "n_states": number("Number of states"), "n_obs": number("Number of observation symbols"), "n_sent": number("Number of sentences"), "n_toks": number("Number of tokens"),
        "corpus_file": s.get("Name of the corpus file"), "omit_class_cond": flag("Omit class conditioning"), "omit_emis_cond": flag("Omit emis conditioning"),
    }


def parsed_index(spark: SparkSession, path: str, pattern: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """``file, file_no, position``: files of a directory by the number in their name, with their 1-based position.

    The set of ids is the column ``file_no``; the mapping is read in both directions.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    numbered = files.withColumn("file_no", F.expr(f"try_cast(regexp_extract(file, r'{pattern}', 1) as bigint)")).where("file_no is not null")
    by = [F.col("file_no"), F.col("file")]
    parts = cut(numbered.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ranges")
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*by)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # one row per range
    return local.join(F.broadcast(shift), "_p").select("file", "file_no", (F.col("_r") + F.col("_s")).cast("int").alias("position"))


def weights(spark: SparkSession, path: str) -> DataFrame:
    """``name, w``: written weights of a tagger."""
    return spark.read.schema("name string, w array<double>").parquet(path)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """Indexed sequences as they were written."""
    return spark.read.parquet(path)


def parameters(spark: SparkSession, path: str, stage: str = "final") -> DataFrame:
    """Long parameter rows of one stage."""
    return spark.read.parquet(f"{path}/stage={stage}")


def listing(spark: SparkSession, path: str, containing: str = "", recursive: bool = True) -> DataFrame:
    """``file, length`` of the files whose path holds a substring."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select(F.col("path").alias("file"), "length")
    return files.where(F.col("file").contains(containing)) if containing else files

"""Toy corpora for tests and first steps: three sequences over four words, of which one never occurs, and two small trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VOCABULARY = ("walk", "shop", "clean", "tennis")
SEQUENCES = ("walk walk shop clean", "walk walk shop clean", "walk shop shop clean")
#: Words with the index of their head (from 1; 0 is the artificial root).
TREES = ((("write", 0), ("code", 1), ("that", 2)), (("don't", 0), ("write", 1), ("code", 2)))


def vocabulary(spark: SparkSession) -> DataFrame:
    """``id, word``."""
    return spark.createDataFrame(list(enumerate(VOCABULARY)), "id long, word string")


def sequences(spark: SparkSession) -> DataFrame:
    """``sent_id, pos, word``."""
    return spark.createDataFrame([(i, k, w) for i, s in enumerate(SEQUENCES, 1) for k, w in enumerate(s.split())], "sent_id long, pos int, word string")


def trees(spark: SparkSession) -> DataFrame:
    """``sent_id, idx, head, word``."""
    return spark.createDataFrame([(i, k, h, w) for i, t in enumerate(TREES, 1) for k, (w, h) in enumerate(t, 1)], "sent_id long, idx int, head int, word string")

"""Spark plug-ins: a Python data source for CoNLL files and a table function that tokenizes."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ConllReader(DataSourceReader):
    """One partition per file, so sentences are never cut; a file is streamed, not held."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        files = sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.basename(p)[0] not in "._") if os.path.isdir(path) else sorted(glob.glob(path))
        return [FilePartition(p) for p in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        sent, empty = 1, True
        with open(partition.path, encoding=self.options.get("encoding", "utf-8")) as lines:
            for line in lines:
                c = line.rstrip("\r\n").split("\t")
                if len(c) == 1 and not c[0].strip():
                    sent, empty = sent + (not empty), True
                    continue
                empty = False
                if len(c) >= 12:
                    kept = (c[1], c[2], c[5], c[4], c[6], int(c[8]), c[10])
                elif len(c) in (8, 10):
                    kept = (*c[1:6], int(c[6]), c[7])
                else:
                    raise ValueError(f"unknown number of columns in {partition.path}: {len(c)}")
                yield (partition.path, sent, int(c[0]), *kept)


class ConllDataSource(DataSource):
    """``spark.read.format("conll").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "conll"

    def schema(self) -> str:
        return "file string, sent_id long, idx int, form string, lemma string, cpos string, pos string, feats string, head int, rel string"

    def reader(self, schema) -> DataSourceReader:
        return ConllReader(self.options)


class Tokenize:
    """``select * from tokenize(line)``: position and word of the single-space split of a stripped line."""

    def eval(self, line: str):
        if line is not None:
            for i, w in enumerate(line.strip().split(" ")):
                yield i, w


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConllDataSource)
    spark.udtf.register("tokenize", udtf(Tokenize, returnType="pos int, word string"))

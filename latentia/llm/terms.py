"""Frequency of every distinct term: heavy-light aggregation.

Pass 1 keeps a Misra-Gries summary per partition over *all* terms; their merge names the heavy terms, at most
``HEAVY_SLOTS`` of them and none longer than ``HEAVY_BYTES``, so what is broadcast has a fixed bound. Pass 2 counts
heavy terms exactly in local counter arrays and combines the others per batch; an array leaves its partition once,
so the exchange carries only the light terms plus one bounded row set per partition, and the union of both is summed.
Whether a term is found heavy changes only what is shuffled, never a count. Where rows are grouped into records, the
records of heavy terms are found from one set of slots per record and batch, so that a heavy term is not shuffled once
for each of its records.

Defined cases: null texts and texts without a term are no records; a repeated row counts again; an empty table gives
no rows; other columns of the input, whatever their names, are ignored; a null record id is one record of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from latentia.session import cut, ship

HEAVY_SLOTS = 2048
HEAVY_BYTES = 256
SUMMARY_SLOTS = 4 * HEAVY_SLOTS


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms between runs of spaces, tabs and no-break spaces, with the row each came from."""
    texts = pc.cast(texts, pa.large_string())
    texts = pc.replace_substring(pc.replace_substring(texts, "\t", " "), "\u00a0", " ")
    lists = pc.split_pattern(texts, " ")
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False)


def _batch(batch: pa.RecordBatch, split: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """Distinct terms of a batch, their occurrences and records, and the number of records."""
    texts = batch.column("text")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if split:
        flat, rows = split_terms(texts)
        weight = np.ones(len(flat), np.int64)
    else:
        here = pc.is_valid(texts)
        flat = pc.cast(texts.filter(here), pa.large_string())
        weight = np.ones(len(flat), np.int64)
        rows = np.arange(len(flat))
    if not len(flat):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    coded = pc.dictionary_encode(flat)
    codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    occ = np.bincount(codes, weight, n).astype(np.int64)
    pairs = np.unique(rows.astype(np.int64) * n + codes) if split else codes
    rec = np.bincount(pairs % n, minlength=n)
    return coded.dictionary, occ, rec, len(np.unique(rows)) if split else 0


def _summaries(split: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        records = 0
        for batch in batches:
            terms, occ, _, n = _batch(batch, split)
            records += n
            short = pc.less_equal(pc.binary_length(terms), HEAVY_BYTES).to_numpy(zero_copy_only=False)
            for t, c in zip(terms.filter(pa.array(short)).to_pylist(), occ[short].tolist()):
                held[t] = held.get(t, 0) + c
            if len(held) > SUMMARY_SLOTS:
                cutoff = int(np.partition(np.fromiter(held.values(), np.int64), -SUMMARY_SLOTS - 1)[-SUMMARY_SLOTS - 1])
                held = {t: c - cutoff for t, c in held.items() if c > cutoff}
        rows = sorted(held.items(), key=lambda x: -x[1])[:SUMMARY_SLOTS]
        yield pa.RecordBatch.from_arrays([pa.array([None, *[t for t, _ in rows]], pa.string()), pa.array([records, *[c for _, c in rows]], pa.int64())], ["term", "c"])

    return run


def _counts(split: bool, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy.value, pa.large_string())
        occ_of, rec_of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            terms, occ, rec, _ = _batch(batch, split)
            slot = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy(zero_copy_only=False)
            is_heavy = slot >= 0
            occ_of[slot[is_heavy]] += occ[is_heavy]
            rec_of[slot[is_heavy]] += rec[is_heavy]
            light = ~is_heavy
            if light.any():
                yield pa.RecordBatch.from_arrays([pc.cast(terms.filter(pa.array(light)), pa.string()), pa.array(occ[light]), pa.array(rec[light])], ["term", "occ", "rec"])
        seen = occ_of > 0
        yield pa.RecordBatch.from_arrays([pc.cast(names.filter(pa.array(seen)), pa.string()), pa.array(occ_of[seen]), pa.array(rec_of[seen])], ["term", "occ", "rec"])

    return run


def _grouped(heavy):
    """Rows of records: light terms by record (kind 0), the set of heavy slots of a record (1), totals of heavy terms (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy.value, pa.large_string())
        total, kind_of_r = np.zeros(len(names), np.int64), None

        def out(r: pa.Array, kind: int, term, occ, slots) -> pa.RecordBatch:
            n = len(r)
            none = lambda t: pa.nulls(n, t)
            cols = [r, pa.array(np.full(n, kind, np.int32)), none(pa.string()) if term is None else pc.cast(term, pa.string()), pa.array(np.zeros(n, np.int64) if occ is None else occ), none(pa.list_(pa.int32())) if slots is None else slots]
            return pa.RecordBatch.from_arrays(cols, ["r", "kind", "term", "occ", "slots"])

        for batch in batches:
            kind_of_r = batch.column("r").type
            record, coded = batch.column("r").dictionary_encode(null_encoding="encode"), pc.dictionary_encode(pc.cast(batch.column("text"), pa.large_string()))
            if not batch.num_rows:
                continue
            slot = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False)
            n = len(slot)
            pair, occ = np.unique(record.indices.to_numpy().astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
            r, t = pair // n, pair % n
            big = slot[t] >= 0
            np.add.at(total, slot[t[big]], occ[big])
            yield out(record.dictionary.take(pa.array(r[~big])), 0, coded.dictionary.take(pa.array(t[~big])), occ[~big].astype(np.int64), None)
            r, t = r[big], t[big]  # sorted by record
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
            slots = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)).astype(np.int32)), pa.array(slot[t].astype(np.int32)))
            yield out(record.dictionary.take(pa.array(r[first])), 1, None, None, slots)
        if kind_of_r is not None:
            seen = np.flatnonzero(total)
            yield out(pa.nulls(len(seen), kind_of_r), 2, names.take(pa.array(seen)), total[seen], None)

    return run


def term_counts(df: DataFrame, text: str, record: str | None = None) -> DataFrame:
    """``term, occurrences, records, n_records`` of every distinct term of ``df[text]``.

    Without ``record`` each row is a record whose terms are split at white space; with it the value is the term and
    rows with equal ``record`` form one record.
    """
    spark, split = df.sparkSession, record is None
    ship(spark)
    rows = df.select(F.col(text).alias("text")) if split else df.where(F.col(text).isNotNull()).select(F.col(record).alias("r"), F.col(text).alias("text"))
    top = (
        rows.mapInArrow(_summaries(split), "term string, c long")
        .groupBy("term").agg(F.sum("c").alias("c"))
        .orderBy(F.col("term").isNull().desc(), F.col("c").desc(), "term").limit(HEAVY_SLOTS + 1).collect()
    )
    listed = [r.term for r in top if r.term is not None]
    heavy = spark.sparkContext.broadcast(listed)
    if split:
        n_records = next((r.c for r in top if r.term is None), 0)
        counted = rows.mapInArrow(_counts(split, heavy), "term string, occ long, rec long").groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum("rec").alias("records"))
    else:
        kind = df.schema[record].dataType.simpleString()
        parts = cut(rows.mapInArrow(_grouped(heavy), f"r {kind}, kind int, term string, occ long, slots array<int>"), "parts")
        n_records = parts.where("kind < 2").groupBy("r").agg(F.lit(1).alias("x")).count()
        light = parts.where("kind = 0").groupBy("r", "term").agg(F.sum("occ").alias("occ")).groupBy("term").agg(F.sum("occ").alias("occurrences"), F.count("*").alias("records"))
        sets = parts.where("kind = 1").groupBy("r").agg(F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
        names = spark.createDataFrame(list(enumerate(listed)), "slot int, term string")
        records = sets.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("records")).join(F.broadcast(names), "slot")
        totals = parts.where("kind = 2").groupBy("term").agg(F.sum("occ").alias("occurrences"))
        counted = light.unionByName(totals.join(F.broadcast(records), "term").select("term", "occurrences", "records"))  # at most HEAVY_SLOTS rows
    return counted.withColumn("n_records", F.lit(n_records).cast("long"))


def mark_terms(counts: DataFrame, min_occurrences: int = 5, min_records: int = 3, common_percent: int = 5) -> DataFrame:
    """Adds ``mark``: ``rare``, else ``common``, else null."""
    return counts.withColumn(
        "mark",
        F.when((F.col("occurrences") < min_occurrences) | (F.col("records") < min_records), "rare")
        .when(F.col("records") * 100 > F.col("n_records") * common_percent, "common"),
    )

"""Held-out passages inside training text: MinHash containment search by window size, then an exact check.

An item leaks where one of its windows of ``window`` consecutive words lies in a line. Every window is a set of
five-word shingles; its signature is made of the least of their hashes under ``PERMUTATIONS`` permutations. A signature of
a whole line would find a passage only with some probability, the lower the longer the line. Therefore the search is
partitioned by size: items of ``window`` words or more form one partition, items of fewer words one partition for each
number of words (``short_items``), and in each partition lines are cut into windows of its size. A window that a line
contains has the *same* minima there, so no leak is missed however long the line. All partitions are searched in one
pass over the lines, whose words are split once.
Item sketches up to ``SKETCH_LIMIT`` hashes are broadcast and lines without a common minimum never leave their task;
beyond that the sketches are joined by a shuffle. Candidates are verified by equality of the window's words.

Defined cases: null and empty lines or items match nothing; repeated items and redelivered lines each count; the
words of a text are its lower-cased runs of letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from latentia.session import cut

SHINGLE = 5
PERMUTATIONS = 2
SKETCH_LIMIT = 2_000_000
WINDOWS = "id long, width int, minhash long, win string"
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters and digits, with their rows."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.cast(texts, pa.large_string())), r"[^\p{L}\p{N}]+", " ")
    lists = pc.split_pattern(plain, " ")
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)


def _ahead(rows: np.ndarray, width: int) -> int:
    return max(0, len(rows) - width + 1)


def minhashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """From hashes of words: for each start of a window of ``width`` words its signature, and whether it lies within one row."""
    n, k = _ahead(rows, width), min(SHINGLE, width)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    m = len(words) - k + 1
    shingles = np.zeros(m, np.uint64)
    for j in range(k):
        shingles = shingles * _MUL + words[j : j + m]
    out = np.zeros(n, np.uint64)
    for p in range(PERMUTATIONS):
        acc = mix(shingles + np.uint64(int(_ADD) * (2 * p + 1) % 2**64))
        least = acc[:n].copy()
        for j in range(1, width - k + 1):
            np.minimum(least, acc[j : j + n], out=least)
        out = out * _MUL + least
    return out, rows[:n] == rows[width - 1 :]


def _windows(classes: list[tuple[int, bool]], wanted=None):
    """Rows (id, width, minhash, words of the window) of each partition (width, whole items only).

    With ``wanted`` only those whose signature is among the items' of their width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, rows = words_of(batch.column("text"))
            if not len(flat):
                continue
            coded = pc.dictionary_encode(flat)
            words = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
            for width, whole in classes:
                least, ok = minhashes(words, rows, width)
                if whole:  # items of exactly this many words
                    ok &= np.bincount(rows, minlength=batch.num_rows)[rows[: len(ok)]] == width
                if wanted is not None:
                    hashes = wanted.value.get(width, np.zeros(0, np.uint64))
                    if not len(hashes):
                        continue
                    at = np.minimum(np.searchsorted(hashes, least), len(hashes) - 1)
                    ok &= hashes[at] == least
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                ids = batch.column("id").take(pa.array(rows[at]))
                if len(at) * 4 < len(flat):
                    names = [" ".join(flat.slice(i, width).to_pylist()) for i in at.tolist()]
                else:
                    listed = flat.to_pylist()
                    names = [" ".join(listed[i : i + width]) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), width, np.int32)), pa.array(least[at].view(np.int64)), pa.array(names, pa.string())], ["id", "width", "minhash", "win"])

    return run


def leaked(lines: DataFrame, line_id: str, line: str, items: DataFrame, item_id: str, item: str, window: int = 10, short_items: int | None = None) -> DataFrame:
    """``line_id, item_id, width, shared`` (distinct shared windows), ``item_windows``: every line with the items it leaks.

    ``short_items``: items of that many words or more, but fewer than ``window``, are searched as wholes; by default
    they are not. ``width`` is the size of the item's partition.
    """
    spark = lines.sparkSession
    corpus = lines.select(F.col(line_id).cast("long").alias("id"), F.col(line).alias("text")).where(F.col("text").isNotNull())
    held_out = items.select(F.col(item_id).cast("long").alias("id"), F.col(item).alias("text")).where(F.col("text").isNotNull())
    classes = [(window, False), *((w, True) for w in range(short_items or window, window))]
    sketch = cut(held_out.mapInArrow(_windows(classes), WINDOWS).distinct(), "items")
    keys = sketch.select("width", "minhash").distinct()
    wanted = None
    if keys.count() <= SKETCH_LIMIT:
        held: dict[int, list[int]] = {}
        for r in keys.toLocalIterator():
            held.setdefault(r.width, []).append(r.minhash)
        wanted = spark.sparkContext.broadcast({w: np.sort(np.array(h, np.int64).view(np.uint64)) for w, h in held.items()})
    found = corpus.mapInArrow(_windows([(w, False) for w, _ in classes], wanted), WINDOWS)
    sizes = sketch.groupBy("id", "width").agg(F.count("*").alias("item_windows")).withColumnsRenamed({"id": "item"})
    right = sketch.select(F.col("id").alias("item"), "width", "minhash", "win")
    return (
        found.distinct().join(right, ["width", "minhash", "win"])
        .groupBy("id", "item", "width").agg(F.count("*").alias("shared"))
        .join(sizes, ["item", "width"])
        .select(F.col("id").alias("line_id"), F.col("item").alias("item_id"), "width", "shared", "item_windows")
    )

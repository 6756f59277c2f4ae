"""Long exact spans shared between records: relative Lempel-Ziv factors against indexed reference blocks.

Every stretch of ``length`` characters belongs to the block of its minimizer, the least hash of its 64-character
substrings. Equal stretches have equal minimizers, so a document needs to be factored only against the blocks of its
own minimizers, wherever in the corpus those lie, and never against all blocks. Steps:

1. Each document is cut at minimizer changes into runs of consecutive stretches (a run's text is one phrase).
2. Blocks in which only one document occurs are dropped by a map-side combined aggregate.
3. Phrases that are equal in two documents are whole factors; no text is compared for them.
4. In each other block one copy of each distinct phrase is fetched: together they are the block's reference text, which
   is indexed by a suffix array. Every phrase is parsed greedily against it: the longest match with a phrase of another
   document, found at the nearest suffixes of other documents and compared character by character, is the next factor
   if it has ``length`` characters or more. The next factor is sought from the first stretch that a factor does not
   hold as a whole, so that stretches across a factor's end are looked up too (the check at factor boundaries).
5. Factors are laid over the documents and united where they overlap or touch.

Blocks of more than ``BLOCK_LIMIT`` distinct phrases or ``CHUNK`` characters (copies of one passage in a large part of the corpus) are not
gathered in a task: their stretches go through a map-side combined aggregate instead, with the same result; there and
for whole phrases equality is that of 128 bits of hash.

Defined cases: null texts and texts shorter than ``length`` share nothing; a span repeated within one document only
is not shared; repeated rows with different ids are; positions count characters, which TESTDATA.md says are single
UTF-16 units; ids must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from latentia.session import cut

GRAM = 64
BLOCK_LIMIT = 4096
CHUNK = 1_500_000
MAX_RUN = 4096
SLICE = 262_144
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
PHRASES = "h long, doc_id long, s int, n int, ctx long"
PARTS = "h long, ctx long, a int, b int"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of one array of code points, by prefix sums modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(base)
        if held is None or len(held[0]) < n:
            size = max(n, 1 << 16)
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, np.uint64(b))
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            held = cls._powers[base] = tuple(made)
        return held[0][:n], held[1][:n]

    def __init__(self, codes: np.ndarray, base: int, seed: int):
        n = len(codes)
        up, self.down = self.powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(seed)) * up[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(x) - width + 1], out[width - have :])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def phrases_of(texts: list[str], length: int) -> tuple[np.ndarray, ...]:
    """Runs of stretches with one minimizer: text number, first stretch, number of stretches, minimizer, phrase hash."""
    whole = "".join(texts)
    codes = code_points(whole)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    gram = min(GRAM, length)
    ends = np.cumsum(lens)
    rolling = Rolling(codes, _B1, 1)
    least = sliding_min(rolling.windows(gram), length - gram + 1)
    m = len(least)
    room = np.repeat(ends, lens)[:m] - np.arange(m)
    inside = room >= length
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new &= inside
    starts = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    n = stop - starts
    if len(n) and n.max() > MAX_RUN:  # one repeated character: the run goes on as several phrases
        times = -(-n // MAX_RUN)
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, stop = np.repeat(starts, times) + k * MAX_RUN, np.repeat(stop, times)
        n = np.minimum(stop - starts, MAX_RUN)
    owner = np.searchsorted(ends, starts, side="right")
    digest = xxhash.xxh3_64_intdigest
    ctx = np.fromiter((digest(whole[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(starts.tolist(), (starts + n - 1 + length).tolist())), np.uint64, len(starts))
    return owner, starts - (ends - lens)[owner], n, least[starts], ctx


def _chunks(texts: list[str | None], length: int) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        if t is not None and len(t) >= length:
            held.append(i)
            size += len(t)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _phrases(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at in _chunks(texts, length):
                owner, s, n, h, ctx = phrases_of([texts[i] for i in at], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[np.array(at)[owner]]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ctx.view(np.int64))], ["h", "doc_id", "s", "n", "ctx"]
                )

    return run


def stretch_keys(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all stretches of all texts: two hashes, the text's number and the position in it."""
    codes = code_points("".join(texts))
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    n = lens - length + 1
    which = np.repeat(np.arange(len(texts)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(lens) - lens)[which] + pos
    return Rolling(codes, _B1, 1).windows(length)[at], Rolling(codes, _B2, 2).windows(length)[at], which, pos


def named(names: np.ndarray, width: int, times: int, length: int | None = None) -> np.ndarray:
    """Ranks of substrings ``times`` as wide from those of ``width`` (``length``: of that width), by their order.

    Equal ranks are equal characters, not equal hashes. Beyond the end there is a rank below all others.
    """
    n, top = len(names), int(names.max(initial=0)) + 2
    key = np.zeros(n, np.int64)
    for k in range(times):
        at = k * width if length is None or k + 1 < times else length - width
        key *= top
        key[: max(0, n - at)] += names[at:] + 1
    return np.unique(key, return_inverse=True)[1].reshape(-1)


class Index:
    """Suffix array of a reference text made of phrases: stretches, and for each of them its nearest foreign suffixes."""

    def __init__(self, texts: list[str], owner: np.ndarray, length: int):
        """``owner``: a number per phrase, equal for phrases of one document."""
        self.length = length
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        # a separator below all characters ends every phrase, else the order of suffixes would not be that of their matches
        self.codes = np.insert(code_points("".join(texts)).astype(np.int64) + 1, np.cumsum(lens), 0)
        self.start = np.cumsum(lens + 1) - lens - 1
        self.end = np.repeat(self.start + lens, lens + 1)  # of each character's phrase
        which = np.repeat(np.arange(len(texts)), lens + 1)
        valid = self.end - np.arange(len(self.codes)) >= length
        rank, width = np.unique(self.codes, return_inverse=True)[1].reshape(-1).astype(np.int64), 1
        fit = lambda: max(2, min(62 // (int(rank.max(initial=0)) + 2).bit_length(), 16))  # noqa: E731  ranks to a key
        while width < length:
            times = min(fit(), -(-length // width))
            rank, width = (named(rank, width, times, length), length) if times * width >= length else (named(rank, width, times), times * width)
        self.at = np.flatnonzero(valid)
        own = owner[which[self.at]]
        order = np.lexsort((own, rank[self.at]))
        r, o = rank[self.at][order], own[order]
        new = np.append(True, r[1:] != r[:-1]) if len(r) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        several = o[first] != o[np.append(first[1:], len(o)) - 1] if len(first) else np.zeros(0, bool)
        shared = np.zeros(len(self.codes), bool)
        shared[self.at[order]] = np.repeat(several, np.diff(np.append(first, len(o))))
        on = np.flatnonzero(shared)
        #: The first shared stretch from each position on.
        self.next_shared = np.append(on, len(self.codes))[np.searchsorted(on, np.arange(len(self.codes)))] if len(self.codes) else on
        while len(on) and width < (lens.max() if len(lens) else 0):  # order of whole suffixes
            rank, width = named(rank, width, 2), 2 * width
        order = on[np.argsort(rank[on], kind="stable")]
        own = owner[which[order]]
        change = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
        run = np.cumsum(change) - 1
        start = np.flatnonzero(change)
        stop = np.append(start[1:], len(own))
        self.before, self.after = np.full(len(self.codes), -1), np.full(len(self.codes), -1)
        if len(order):
            self.before[order] = np.where(start[run] > 0, order[start[run] - 1], -1)
            self.after[order] = np.where(stop[run] < len(order), order[np.minimum(stop[run], len(order) - 1)], -1)

    def match(self, i: int, j: int) -> int:
        """Characters that the text at ``i`` and at ``j`` have in common, within their phrases."""
        n = int(min(self.end[i] - i, self.end[j] - j))
        differ = self.codes[i : i + n] != self.codes[j : j + n]
        k = int(differ.argmax()) if n else 0
        return k if n and differ[k] else n

    def longest(self, i: int) -> int:
        """The longest match of the text at ``i`` in a phrase of another document."""
        return max((self.match(i, int(j)) for j in (self.before[i], self.after[i]) if j >= 0), default=0)

    def factors(self, phrase: int) -> Iterator[tuple[int, int]]:
        """Greedy parse of a phrase: begin and end of each factor of ``length`` characters or more."""
        at = i = int(self.start[phrase])
        end = int(self.end[at])
        while i < end and (i := int(self.next_shared[i])) < end:
            n = self.longest(i)
            if n >= self.length:
                yield i - at, i - at + n
            i += max(1, n - self.length + 1)


def parse_blocks(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[str], length: int):
    """Factors of every phrase against the other phrases of the blocks; lo, hi: least and greatest document of a phrase.

    As phrase number, first and last stretch. Equal stretches have one minimizer, so blocks can share an index.
    """
    owner = np.unique(np.where(lo == hi, lo, np.iinfo(np.int64).min + np.arange(len(lo))), return_inverse=True)[1].reshape(-1)
    index = Index(texts, owner, length)
    out = [(k, a, b - length) for k in range(len(texts)) for a, b in index.factors(k)]
    return np.array(out, np.int64).reshape(-1, 3).T


def _parse(length: int):
    """Over partitions sorted by block; a chunk ends where a block ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def parsed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {c: t.column(c).to_numpy() for c in ("h", "ctx", "lo", "hi")}
            who, a, b = parse_blocks(col["h"], col["lo"], col["hi"], t.column("text").to_pylist(), length)
            yield pa.RecordBatch.from_arrays([pa.array(col["h"][who]), pa.array(col["ctx"][who]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["h", "ctx", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("text").nbytes
            if size > CHUNK:
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                end = int(np.searchsorted(h, h[-1]))  # the last block may go on
                if end:
                    yield from parsed(t.slice(0, end))
                    held = t.slice(end).combine_chunks().to_batches()
                    size = sum(x.column("text").nbytes for x in held)
        if held:
            yield from parsed(pa.Table.from_batches(held))

    return run


def _stretches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, which, pos = stretch_keys(batch.column("text").to_pylist(), length)
            of = {c: batch.column(c).to_numpy()[which] for c in ("h", "ctx", "lo", "hi")}
            yield pa.RecordBatch.from_arrays([*map(pa.array, (of["h"], of["ctx"], of["lo"], of["hi"], k1.view(np.int64), k2.view(np.int64), pos.astype(np.int32)))], ["h", "ctx", "lo", "hi", "k1", "k2", "pos"])

    return run


def _cut_texts(length: int):
    """A document with its phrases becomes the phrases' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text").to_pylist(), batch.column("wanted")
            flat, row = wanted.flatten(), pc.list_parent_indices(wanted).to_numpy()
            s, n = flat.field("s").to_numpy(), flat.field("n").to_numpy()
            cuts = [texts[r][a:e] for r, a, e in zip(row.tolist(), s.tolist(), (s + n - 1 + length).tolist())]
            yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("ctx"), flat.field("lo"), flat.field("hi"), pa.array(cuts, pa.string())], ["h", "ctx", "lo", "hi", "text"])

    return run


def _united(parts: DataFrame) -> DataFrame:
    """Spans of a document united where they overlap or touch."""
    by = Window.partitionBy("doc_id").orderBy("a", "b")
    return (
        parts.withColumn("before", F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("g", F.sum(F.when(F.col("a") <= F.col("before"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "g").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).drop("g")
    )


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """``doc_id, span_start, span_end`` (0-based, end exclusive) of every longest run of shared stretches."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= length)
    phrases = cut(src.mapInArrow(_phrases(length), PHRASES), "phrases")
    blocks = phrases.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("h")
    phrases = cut(phrases.join(blocks, "h", "left_semi"), "shared")
    classes = phrases.groupBy("h", "ctx").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "s", "n")).alias("rep"))
    # blocks with a phrase that only one document has need their texts; size decides how they are compared
    size = (F.count("*") > block_limit) | (F.sum(F.col("rep.n") + length) > CHUNK)
    open_blocks = classes.groupBy("h").agg(size.alias("big"), F.max((F.col("lo") == F.col("hi")).cast("int")).alias("open")).where("open = 1")
    classes = cut(classes.join(open_blocks.select("h", "big"), "h", "left"), "classes")
    whole = classes.where("lo <> hi").select("h", "ctx", F.lit(0).alias("a"), (F.col("rep.n") - 1).alias("b"))
    # phrases meet the slice of the text that they start in, so no list and no text grows with a long document
    part = F.floor(F.col("rep.s") / SLICE).cast("int")
    reps = classes.where("big is not null").select("rep.doc_id", F.struct("h", "ctx", "lo", "hi", (F.col("rep.s") - part * SLICE).alias("s"), "rep.n").alias("p"), part.alias("part"))
    reps = reps.groupBy("doc_id", "part").agg(F.collect_list("p").alias("wanted"))
    slices = reps.join(src, "doc_id").select(F.substring("text", F.col("part") * SLICE + 1, F.lit(SLICE + MAX_RUN + length)).alias("text"), "wanted")
    texts = slices.mapInArrow(_cut_texts(length), "h long, ctx long, lo long, hi long, text string")
    texts = cut(texts.join(classes.where("big").select("h", "big").distinct(), "h", "left"), "texts")
    near = texts.where("big is null").drop("big").repartition("h").sortWithinPartitions("h").mapInArrow(_parse(length), PARTS)
    found = near.unionByName(whole)
    if not texts.where("big").isEmpty():
        each = texts.where("big").drop("big").mapInArrow(_stretches(length), "h long, ctx long, lo long, hi long, k1 long, k2 long, pos int")
        keys = each.groupBy("h", "k1", "k2").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x <> y").drop("x", "y")
        found = found.unionByName(each.join(keys, ["h", "k1", "k2"], "left_semi").select("h", "ctx", F.col("pos").alias("a"), F.col("pos").alias("b")))
    parts = phrases.join(found, ["h", "ctx"]).select("doc_id", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + length).alias("b"))
    return _united(parts)


def shared_amounts(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, shared_chars, shared_share`` for every document, also those that share nothing."""
    sums = spans.groupBy(F.col("doc_id").alias("d")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("c"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long").alias("n_chars"))
    shared = F.coalesce(F.col("c"), F.lit(0)).cast("long")
    return base.join(sums, F.col("d") == F.col("doc_id"), "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).alias("shared_share"))

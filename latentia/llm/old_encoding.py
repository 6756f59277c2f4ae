"""Text decoded with the wrong character encoding: noisy-channel decoding.

A channel is a pair of charsets: bytes written in the first were read in the second, once or twice. For each channel a
word becomes a byte lattice (its characters in the second charset; a U+FFFD, or a character that charset lacks, is a
wildcard) and a Viterbi search finds the likeliest text in the first charset under a letter model of the corpus: states
are the last letter, edges decode one to four bytes, a wildcard may stand for any letter the corpus knows. Repaired and
unrepaired readings are then weighed by corpus word frequencies: a word is garbled where a channel explains it

* in UTF-8 (a multi-byte sequence is seldom valid by chance), if the letter model gains more than a small prior or the
  repaired word is far more frequent, or
* in a single-byte charset, if the repaired word is far more frequent in the corpus, or, where the corpus does not
  know it, if the letter model gains more than the channel's prior and the word itself is rare.

The letter model is trained on word types (not tokens) without C1 controls, U+FFFD and UTF-8 debris; a word's own
contribution is taken out when it is scored. Counts come from all rows. What is broadcast is the letter model, at
most ``MODEL_LIMIT`` letter triples; words and candidates are joined by shuffles.

Defined cases: null words are skipped; ASCII words are never garbled; empty words are clean; a word with U+FFFD is
garbled with no certain original (``restored`` is empty, ``guess`` holds the Viterbi path); repeated rows each count.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latentia.session import cut, default_parallelism

LOST = "�"
SINGLE_BYTE = ("cp437", "cp850", "mac_roman", "cp1252")
READ_AS = ("latin-1", "cp1252", "cp1250", "iso8859-2", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1251")
MODEL_LIMIT = 200_000
WRITTEN = "’‘“”«»–—…•¿¡€£·ªº°§"  # beside letters
ROUNDS = 2
SLACK = 2.0  # what the letter model may hold against a repair that the corpus knows well
PRIOR = 6.0  # log odds against a word having passed a given single-byte channel
UTF8_PRIOR = 2.0  # the same where a multi-byte sequence came out valid, which is rare by chance
UNKNOWN = 3  # a word whose repair the corpus does not know is garbled only if it occurs at most so often
FREQUENT = 5.0  # a repaired word is "far more frequent" from this ratio on
CANDIDATES = "word string, n long, cand string, channel string, gain double, utf8 boolean, lost boolean"
_EDGE = "\x02"
_PAIR = re.compile(r"[^\x00-\x7F]{2}")  # a multi-byte sequence was read as two signs or more
_SIGN_INSIDE = re.compile(r"[A-Za-z][^\x00-\x7F\w’]|[^\x00-\x7F\w’][A-Za-z]")  # a sign beside a letter is likelier debris


def _byte(ch: str, charset: str) -> int | None:
    """The byte that a single-byte charset reads as ``ch``; undefined bytes were read as C1 controls."""
    try:
        return ch.encode(charset)[0]
    except UnicodeEncodeError:
        return ord(ch) if 0x80 <= ord(ch) < 0xA0 else None


def _char(byte: int, charset: str) -> str | None:
    try:
        return bytes([byte]).decode(charset)
    except UnicodeDecodeError:
        return None


def utf8_debris(word: str) -> bool:
    """Whether in some charset's bytes the word holds a valid UTF-8 multi-byte sequence."""
    return any(unread(word, w) is not None for w in READ_AS)


def unread(word: str, wrong: str) -> str | None:
    """The word with every span decoded that is a valid UTF-8 sequence in the bytes of ``wrong``; None if there is none."""
    if not _PAIR.search(word):
        return None
    out, i, n = [], 0, len(word)
    data = [None if c.isascii() else _byte(c, wrong) for c in word]
    hit = False
    while i < n:
        lead = data[i] or 0
        size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
        part = data[i : i + size]
        if size > 1 and len(part) == size and None not in part:
            try:
                out.append(bytes(part).decode("utf-8"))
                i, hit = i + size, True
                continue
            except UnicodeDecodeError:
                pass
        out.append(word[i])
        i += 1
    return "".join(out) if hit else None


def utf8_lattices(word: str, wrong: str) -> Iterator[tuple[int, list[list[tuple[int, list[str]]]]]]:
    """Steps and lattice: every sign as it is, and every span that is a UTF-8 sequence in ``wrong``, at last after up to three steps."""
    units, edges = [(1, c) for c in word], [[(1, [c])] for c in word]
    charset = wrong
    for step in (1, 2, 3):
        seen = "".join(c for _, c in units)
        charset = next((w for w in ((wrong,) if step == 1 else (wrong, *READ_AS)) if unread(seen, w) is not None), None)
        if charset is None:
            return
        merged, i, at = [], 0, 0
        while i < len(units):
            size = next((k for k in (2, 3, 4) if i + k <= len(units) and not any(c.isascii() for _, c in units[i : i + k]) and len(x := unread(seen[i : i + k], charset) or "") == 1), 1)
            width, text = sum(n for n, _ in units[i : i + size]), x if size > 1 else units[i][1]
            if size > 1 and not has_controls(text):
                edges[at].append((width, [text]))
            merged.append((width, text))
            i, at = i + size, at + width
        units = merged
        yield step, edges


@functools.lru_cache(65536)
def swapped(c: str, right: str, wrong: str) -> str | None:
    """What a sign read in ``wrong`` is in ``right``; None if it is the same or no letter or sign of a text."""
    byte = _byte(c, wrong)
    x = _char(byte, right) if byte is not None else None
    return x if x and x != c and (x.isalpha() or x in WRITTEN) else None


def has_controls(word: str) -> bool:
    return any(0x7F <= ord(c) < 0xA0 for c in word)


def plain(word: str) -> bool:
    """Whether all its non-ASCII characters are ones that words are written with."""
    return all(c.isascii() or c.isalpha() or c in WRITTEN for c in word)


class LetterModel:
    """Interpolated letter trigrams over word types."""

    def __init__(self, triples: dict[str, int]):
        self.tri = triples
        self.bi, self.uni, self.ctx2, self.ctx1 = (defaultdict(int) for _ in range(4))
        for t, c in triples.items():
            self.ctx2[t[:2]] += c
            self.bi[t[1:]] += c
            self.ctx1[t[1]] += c
            self.uni[t[2]] += c
        self.total = sum(self.uni.values()) or 1
        self.uni = dict(self.uni)
        self.letters = [c for c, n in sorted(self.uni.items(), key=lambda x: -x[1]) if not c.isascii() and c.isalpha()][:200]

    def logp(self, a: str, b: str, c: str, less: int = 0) -> float:
        """log P(c | a b) with ``less`` counts of the scored word taken out."""
        t, u = max(0, self.tri.get(a + b + c, 0) - less), max(0, self.bi.get(b + c, 0) - less)
        p1 = (max(0, self.uni.get(c, 0) - less) + 1e-3) / (self.total + 100)
        p2 = (u + 4 * p1) / (self.ctx1.get(b, 0) + 4)
        return math.log((t + 4 * p2) / (self.ctx2.get(a + b, 0) + 4))

    def score(self, word: str, own: bool = False) -> float:
        s = _EDGE * 2 + word + _EDGE
        return sum(self.logp(*s[i : i + 3], less=int(own)) for i in range(len(s) - 2))


def lattice(word: str, right: str, wrong: str, letters: list[str]) -> list[list[tuple[int, list[str]]]]:
    """For each position the edges (length, texts): ASCII as it is, decoded bytes, or letters for a wildcard."""
    n, data = len(word), [_byte(c, wrong) if c != LOST else None for c in word]
    edges: list[list[tuple[int, list[str]]]] = [[] for _ in range(n)]
    for i, c in enumerate(word):
        if c.isascii():
            edges[i].append((1, [c]))
            continue
        if c == LOST:
            edges[i].append((1, letters))
        elif c.isalpha():  # a span may be undamaged
            edges[i].append((1, [c]))
        if right != "utf-8":
            if x := swapped(c, right, wrong):
                edges[i].append((1, [x]))
            continue
        for size in (2, 3, 4):
            part = data[i : i + size]
            if len(part) < size or any(p is not None and p < 0x80 for p in part) or all(p is None for p in part):
                continue
            if None not in part:
                try:
                    edges[i].append((size, [bytes(part).decode("utf-8")]))
                except UnicodeDecodeError:
                    pass
            elif all(word[i + k] == LOST for k, p in enumerate(part) if p is None):  # some bytes were lost
                fit = [x for x in letters if len(e := x.encode()) == size and all(p is None or p == e[k] for k, p in enumerate(part))]
                if fit:
                    edges[i].append((size, fit))
    return edges


def viterbi(edges: list[list[tuple[int, list[str]]]], model: LetterModel) -> tuple[float, str] | None:
    """The likeliest text through a lattice; the state is the last two letters; ties fall to the lesser text."""
    n = len(edges)
    best: list[dict[str, tuple[float, str]]] = [{} for _ in range(n + 1)]
    best[0][_EDGE * 2] = (0.0, "")
    for i in range(n):
        for state, (score, text) in best[i].items():
            for size, texts in edges[i]:
                for t in texts:
                    s, at = score, state
                    for ch in t:
                        s += model.logp(at[0], at[1], ch)
                        at = at[1] + ch
                    held = best[i + size].get(at)
                    if held is None or (-s, text + t) < (-held[0], held[1]):
                        best[i + size][at] = (s, text + t)
        best[i] = {} if i else best[i]
        if i + 1 < n and len(best[i + 1]) > 400:  # runs of wildcards: the likeliest states go on
            best[i + 1] = dict(sorted(best[i + 1].items(), key=lambda x: -x[1][0])[:400])
    ends = [(s + model.logp(at[0], at[1], _EDGE), t) for at, (s, t) in best[n].items()]
    return min(ends, key=lambda x: (-x[0], x[1])) if ends else None


def candidates(word: str, model: LetterModel) -> Iterator[tuple[str, str, float, bool, bool]]:
    """Repaired readings: text, channel, gain of the letter model, whether read from UTF-8, whether letters were lost."""
    if LOST in word:
        found = [(*p, f"{r}>{w}") for r, w in (("utf-8", "latin-1"), ("utf-8", "cp1252"), ("cp1252", "cp1252")) if (p := viterbi(lattice(word, r, w, model.letters), model))]
        if found:
            _, text, channel = max(found, key=lambda x: (x[0], x[1]))
            yield text, channel, 0.0, False, True
        else:
            yield "", "lost", 0.0, False, True
        return
    debris, odd, scored = utf8_debris(word), {c for c in word if not c.isascii()}, {}
    keep = model.score(word, own=not debris)  # the model has not learnt from debris
    for wrong in READ_AS if debris else ():
        found = None
        for steps, edges in utf8_lattices(word, wrong):
            path = viterbi(edges, model)
            if path and path[1] != word and (found is None or path[1] != found[0]) and not has_controls(path[1]):
                found = path[1], steps, path[0]
        if found:
            yield found[0], f"utf-8>{wrong} x{found[1]}", found[2] - keep, True, False
    for wrong in READ_AS:
        if not any(c.isascii() and c.isalpha() for c in word):
            continue  # a lone sign
        for right in SINGLE_BYTE:
            if {right, wrong} <= {"cp1252", "latin-1", "iso8859-15"} or right == wrong:
                continue
            table = {c: swapped(c, right, wrong) for c in odd}
            good = {c for c, x in table.items() if x and (x in WRITTEN or x in model.uni)}  # letters the corpus writes
            if not good or not all(c in good or c.isalpha() for c in odd):
                continue  # nothing to repair, or not wholly explained by this channel
            paths = set()
            if len(good) == len(odd):  # every sign decoded
                text = "".join(table.get(c, c) for c in word)
                if text not in scored:
                    scored[text] = model.score(text)
                paths.add((scored[text], text))
            if len(odd) > 1:  # with undamaged spans left as they are
                paths.add(viterbi(lattice(word, right, wrong, model.letters), model))
            for score, text in sorted(paths - {None}):
                if text != word and not has_controls(text):
                    yield text, f"{right}>{wrong}", score - keep, False, False


def _candidates(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = LetterModel(model.value)
        for batch in batches:
            rows = [(w, n, *c) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for c in candidates(w, letters)]
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["word", "n", "cand", "channel", "gain", "utf8", "lost"])

    return run


def _trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter triples of the word types a model may learn from."""
    for batch in batches:
        held: dict[str, int] = defaultdict(int)
        for w in batch.column("word").to_pylist():
            if not w.isascii() and (LOST in w or has_controls(w) or utf8_debris(w) or not plain(w) or _SIGN_INSIDE.search(w)):
                continue
            s = _EDGE * 2 + w + _EDGE
            for i in range(len(s) - 2):
                held[s[i : i + 3]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["t", "c"])


def garbled_words(df: DataFrame, word: str) -> DataFrame:
    """``word, n, restored, guess, channel`` of every distinct garbled word."""
    spark = df.sparkSession
    freq = cut(df.select(F.col(word).alias("word")).where(F.col("word").isNotNull() & (F.col("word") != "")).groupBy("word").agg(F.count("*").alias("n")), "words")
    odd = freq.where(F.length("word") != F.octet_length("word")).repartition(default_parallelism(spark), "word")  # few bytes, much work
    known = freq.select(F.col("word").alias("cand"), F.col("n").alias("n_cand"))
    rare = F.col("n_cand") < FREQUENT * F.col("n")
    clean, taken = freq.select("word"), None
    for _ in range(ROUNDS):  # what one round repairs, the next one's letter model does not learn from
        triples = clean.mapInArrow(_trusted, "t string, c long").groupBy("t").agg(F.sum("c").alias("c")).orderBy(F.col("c").desc(), "t").limit(MODEL_LIMIT)
        model = spark.sparkContext.broadcast({r.t: r.c for r in triples.collect()})
        cands = odd.mapInArrow(_candidates(model), CANDIDATES)
        weighed = cands.join(known, "cand", "left").withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))
        taken = cut(weighed.where(
            F.col("lost") | (F.col("utf8") & (F.col("gain") > UTF8_PRIOR)) | (~rare & (F.col("gain") > -SLACK))
            | (rare & (F.col("n_cand") > 0) & (F.col("n_cand") * FREQUENT >= F.col("n")) & (F.col("gain") > PRIOR))
            | ((F.col("n_cand") == 0) & (F.col("n") <= UNKNOWN) & (F.col("gain") > PRIOR))
        ), "repairs")
        clean = freq.select("word").join(taken.select("word").distinct(), "word", "left_anti")
    # how many words a channel explains best is its weight among rivals; there are as many rows as channels
    first = taken.groupBy("word").agg(F.max_by("channel", F.struct("utf8", ~rare, "gain", "cand")).alias("channel"))
    share = first.groupBy("channel").agg(F.log(F.count("*") + 0.1).alias("weight"))
    ranked = taken.join(F.broadcast(share), "channel", "left").withColumn("total", F.col("gain") + 2 * F.coalesce("weight", F.lit(-2.0)))
    best = ranked.groupBy("word", "n").agg(F.max_by(F.struct("cand", "channel", "lost"), F.struct("utf8", ~rare, "total", "n_cand", "cand")).alias("b"))
    return best.select("word", "n", F.when(F.col("b.lost"), "").otherwise(F.col("b.cand")).alias("restored"), F.col("b.cand").alias("guess"), F.col("b.channel").alias("channel"))


def garbled_rows(df: DataFrame, row_id: str, word: str) -> DataFrame:
    """``row_id, word, restored, guess, channel`` of every garbled row."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(word).alias("word")).where(F.length("word") != F.octet_length("word"))
    return rows.join(garbled_words(df, word).drop("n"), "word").select("row_id", "word", "restored", "guess", "channel")

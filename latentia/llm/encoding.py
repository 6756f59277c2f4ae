"""Text decoded with the wrong character encoding: noisy-channel decoding.

A channel is a pair of charsets: bytes written in the first were read in the second, up to three times. For each channel
a word becomes a byte lattice: every sign as it is, every span that is a UTF-8 sequence in the second charset or a
letter of a single-byte one, and wildcards for lost bytes (U+FFFD), which stand for any letter the corpus knows that
fits the bytes left. A Viterbi search finds the likeliest text. A path is scored by a letter model of the corpus, and
where it spells a word of the corpus by that word's frequency too: the search state is the last two letters and the
place in the trie of corpus words that the lattice can spell (beside a lost letter the last letter only).

A word seen n times is garbled where its best path gains more over the word as it is than the channel's prior:

    letters(path) - letters(word) + frequencies  >  prior(channel)

Where the path spells a word that the corpus has m times, ``frequencies`` is KNOWN if that is far more often
(m >= FREQUENT x n) and 0 if it is about as often (m >= n / FREQUENT). Else it is -REPEATED x log n (less for
words with a sign between letters): a word whose restored form the corpus does not have is the likelier genuine the more
often it occurs, whatever its letters. The prior of UTF-8 is small: a multi-byte sequence is seldom valid by chance.

The letter model is trained on word types (not tokens) without C1 controls, U+FFFD and UTF-8 debris; a word's own
contribution is taken out when it and its readings are scored. The search runs twice: first over the words of which the
corpus has a reading, then over all, with a letter model that has not learnt from what the first search repaired.
Counts come from all rows. What is broadcast is the letter model: triples of an alphabet in which scripts beyond Latin,
Greek and Cyrillic are folded to one sign per 256 code points, checked against ``MODEL_LIMIT``. Words, readings and
frequencies are joined by shuffles.

Defined cases: null words are skipped; ASCII words are never garbled; empty words are clean; a word with U+FFFD is
garbled with no certain original (``restored`` is empty, ``guess`` holds the Viterbi path); repeated rows each count.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latentia.session import cut, default_parallelism

LOST = "\ufffd"
SINGLE_BYTE = ("cp437", "cp850", "mac_roman", "cp1252")
READ_AS = ("latin-1", "cp1252", "cp1250", "iso8859-2", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1251")
ALIKE = {"cp1252", "latin-1", "iso8859-15"}
CHANNELS = tuple((r, w) for w in READ_AS for r in SINGLE_BYTE if r != w and not {r, w} <= ALIKE)
MODEL_LIMIT = 5_000_000
WRITTEN = "’‘“”«»–—…•¿¡€£·ªº°§"  # beside letters
PRIOR = 6.0  # log odds against a word having passed a given single-byte channel
UTF8_PRIOR = 2.0  # the same where a multi-byte sequence came out valid, which is rare by chance
KNOWN = 8.0  # log odds against a wrong reading being a frequent word of the corpus
REPEATED = 12.0  # genuine words repeat, garbled ones have a clean form beside them
REPEATED_SIGN = 1.0  # the same for words with a sign between letters, which are seldom genuine
FREQUENT = 5.0
NEW_LETTER, NEW_SIGN = 0.5, 1e-3  # pseudo-counts of what the model has not seen: a letter, a sign inside a word
REPAIRS = "word string, n long, cand string, channel string, total double, utf8 boolean, lost boolean"
_EDGE = "\x02"
_ODD = re.compile(r"[^\x00-\x7F]+")
_SIGN_INSIDE = re.compile(r"[A-Za-z][^\x00-\x7F\w’]|[^\x00-\x7F\w’][A-Za-z]")  # a sign beside a letter is likelier debris
Edges = list[list[tuple[int, list[str]]]]


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


@functools.lru_cache(65536)
def unread_run(run: str, wrong: str) -> str | None:
    """A run of non-ASCII signs with every span decoded that is a valid UTF-8 sequence in the bytes of ``wrong``; None if there is none."""
    out, i, n = [], 0, len(run)
    data = [_byte(c, wrong) for c in run]
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
        out.append(run[i])
        i += 1
    return "".join(out) if hit else None


@functools.lru_cache(65536)
def debris_run(run: str) -> bool:
    return len(run) > 1 and any(unread_run(run, w) is not None for w in READ_AS)


def utf8_debris(word: str) -> bool:
    """Whether in some charset's bytes the word holds a valid UTF-8 multi-byte sequence."""
    return any(map(debris_run, _ODD.findall(word)))


def unread(word: str, wrong: str) -> str | None:
    """The word with every such span decoded; None if there is none."""
    hit = False

    def put(m: re.Match) -> str:
        nonlocal hit
        x = unread_run(m[0], wrong)
        hit |= x is not None
        return m[0] if x is None else x

    text = _ODD.sub(put, word)
    return text if hit else None


def utf8_lattices(word: str, wrong: str) -> Iterator[tuple[int, str, Edges]]:
    """Steps, whole reading and lattice: every sign as it is, and every span that is a UTF-8 sequence in ``wrong``, at last after up to three steps."""
    units, edges = [(1, c) for c in word], [[(1, [c])] for c in word]
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
        yield step, "".join(c for _, c in units), edges


@functools.lru_cache(65536)
def swapped(c: str, right: str, wrong: str) -> str | None:
    """What a sign read in ``wrong`` is in ``right``; None if it is the same or no letter or sign of a text."""
    byte = _byte(c, wrong)
    x = _char(byte, right) if byte is not None else None
    return x if x and x != c and (x.isalpha() or x in WRITTEN) else None


@functools.lru_cache(65536)
def tables(odd: str) -> tuple[tuple[str, tuple[tuple[str, str], ...]], ...]:
    """The distinct ways in which single-byte channels wholly explain these signs: channel, and each swapped sign with its letter."""
    out: dict[tuple[tuple[str, str], ...], str] = {}
    for right, wrong in CHANNELS:
        swaps = tuple((c, x) for c in odd if (x := swapped(c, right, wrong)))
        left = {c for c in odd} - {c for c, _ in swaps}
        if swaps and all(c.isalpha() for c in left):
            out.setdefault(swaps, f"{right}>{wrong}")
    return tuple((channel, swaps) for swaps, channel in out.items())


def has_controls(word: str) -> bool:
    return any(0x7F <= ord(c) < 0xA0 for c in word)


def plain(word: str) -> bool:
    """Whether all its non-ASCII characters are ones that words are written with."""
    return all(c.isascii() or c.isalpha() or c in WRITTEN for c in word)


def learnt(word: str) -> bool:
    """Whether the letter model learns from a word type."""
    return word.isascii() or not (LOST in word or has_controls(word) or utf8_debris(word) or not plain(word) or _SIGN_INSIDE.search(word))


def folded(word: str) -> str:
    """Scripts beyond Latin, Greek and Cyrillic as one sign per 256 code points."""
    return word if word.isascii() else "".join(c if ord(c) < 0x530 or c in WRITTEN else chr(0x10F000 + (ord(c) >> 8) % 0x1000) for c in word)


class LetterModel:
    """Interpolated letter trigrams over word types."""

    def __init__(self, triples: dict[str, int]):
        self.tri = triples
        self.bi, self.uni, self.ctx2, self.ctx1, self.new2, self.new1 = (defaultdict(int) for _ in range(6))
        for t, c in triples.items():
            self.ctx2[t[:2]] += c
            self.new2[t[:2]] += 1
            self.new1[t[1]] += t[1:] not in self.bi
            self.bi[t[1:]] += c
            self.ctx1[t[1]] += c
            self.uni[t[2]] += c
        self.total = sum(self.uni.values()) or 1
        self.uni = dict(self.uni)
        self.letters = [c for c, n in sorted(self.uni.items(), key=lambda x: (-x[1], x[0])) if not c.isascii() and c.isalpha()]
        self.held: dict[tuple[str, str], float] = {}
        self.rows: dict[str, np.ndarray] = {}
        self.own: set[str] | frozenset[str] = frozenset()

    def logp(self, state: str, c: str) -> float:
        """log P(c | the last two letters); with one letter a bigram."""
        if c in self.own and state[-1] + c in self.own:  # of what the scored word has too, one occurrence is its own
            return self.counted(state, c, 1, int(state + c in self.own))
        v = self.held.get((state, c))
        if v is None:
            v = self.held[state, c] = self.counted(state, c, 0, 0)
        return v

    def counted(self, state: str, c: str, less: int, less3: int) -> float:
        b = state[-1]
        p1 = (max(0, self.uni.get(c, 0) - less) + (NEW_LETTER if c.isalpha() else NEW_SIGN)) / (self.total + 100)
        new = self.new1.get(b, 0) + 1  # as many different letters as follow, so often a new one does
        p2 = (max(0, self.bi.get(b + c, 0) - less) + new * p1) / (self.ctx1.get(b, 0) + new)
        if len(state) == 1:
            return math.log(p2)
        new = self.new2.get(state, 0) + 1
        return math.log((max(0, self.tri.get(state + c, 0) - less3) + new * p2) / (self.ctx2.get(state, 0) + new))

    def without(self, word: str) -> None:
        """Takes the word's own contribution out, for its own score and for those of its readings; an empty word puts it back."""
        s = _EDGE * 2 + folded(word) + _EDGE
        self.own = {s[i : i + k] for k in (1, 2, 3) for i in range(2 if k == 1 else 1 if k == 2 else 0, len(s) - k + 1)} if word else frozenset()

    def row(self, state: str) -> np.ndarray:
        """log P of every letter a wildcard stands for."""
        v = self.rows.get(state)
        if v is None:
            v = self.rows[state] = np.array([self.logp(state, c) for c in self.letters])
        return v

    def change(self, word: str, i: int, x: str) -> float:
        """What the score gains if the letter at ``i`` is ``x``: three triples differ."""
        s, y = _EDGE * 2 + folded(word) + _EDGE, folded(x)
        a, b, c, d = s[i], s[i + 1], s[i + 2], s[i + 3]
        e = s[i + 4] if i + 4 < len(s) else None
        new, old = self.logp(a + b, y) + self.logp(b + y, d), self.logp(a + b, c) + self.logp(b + c, d)
        return new - old + (self.logp(y + d, e) - self.logp(c + d, e) if e else 0.0)

    def around(self, word: str) -> float:
        """Minus the score of all triples that hold a letter beyond ASCII."""
        s = _EDGE * 2 + folded(word) + _EDGE
        return -sum(self.logp(s[i : i + 2], s[i + 2]) for i in range(len(s) - 2) if not s[i : i + 3].isascii())

    def score(self, word: str) -> float:
        s = _EDGE * 2 + folded(word) + _EDGE
        return sum(self.logp(s[i : i + 2], s[i + 2]) for i in range(len(s) - 2))


def lost_lattice(word: str, wrong: str, letters: list[str]) -> Edges:
    """A word with lost bytes, written in UTF-8: signs as they are, decoded spans, and letters that fit where bytes were lost."""
    n, data = len(word), [_byte(c, wrong) if c != LOST else None for c in word]
    edges: Edges = [[] for _ in range(n)]
    for i, c in enumerate(word):
        if c.isascii():
            edges[i].append((1, [c]))
            continue
        edges[i].append((1, letters if c == LOST else [c]))
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


def viterbi(edges: Edges, model: LetterModel, known: dict[str, float]) -> tuple[float, str]:
    """The likeliest text through a lattice; ``known``: what spelling a word of the corpus adds to a path.

    States are the last letters and the text so far as long as it is the beginning of a known word (None elsewhere). A
    wildcard leaves one letter as the state, so its exact search takes as many steps as pairs of letters.
    """
    n = len(edges)
    starts = {w[:k] for w in known for k in range(len(w) + 1)}
    first = (_EDGE * 2, "" if known else None)
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0][first] = (0.0, None)

    def put(i: int, state: tuple, score: float, back: tuple) -> None:
        held = best[i].get(state)
        if held is None or score > held[0]:
            best[i][state] = (score, back)

    for i in range(n):
        here = best[i]
        for size, texts in edges[i]:
            if texts is model.letters and texts:
                states = list(here)
                s = np.array([here[x][0] for x in states])[:, None] + np.array([model.row(x[0]) for x in states])
                for k, (j, v) in enumerate(zip(s.argmax(0).tolist(), s.max(0).tolist())):
                    put(i + size, (texts[k], None), v, (i, states[j], texts[k]))
                for (at, place), (score, _) in here.items():  # what goes on along a known word
                    for c in {w[len(place)] for w in known if len(w) > len(place) and w.startswith(place)} if place is not None else ():
                        put(i + size, (c, place + c), score + model.logp(at, folded(c)), (i, (at, place), c))
                continue
            for t in texts:
                letters = folded(t)
                for (at, place), (score, _) in here.items():
                    s, state = score, at
                    for ch in letters:
                        s += model.logp(state, ch)
                        state = state[-1] + ch
                    to = place + t if place is not None and place + t in starts else None
                    put(i + size, (state, to), s, (i, (at, place), t))
    ends = [(score + model.logp(state[0], _EDGE) + known.get(state[1], 0.0), state) for state, (score, _) in best[n].items()]
    if not ends:
        return -math.inf, ""
    top = max(score for score, _ in ends)
    found = []
    for score, state in ends:
        if score == top:
            out, i = [], n
            while i:
                i, state, t = best[i][state][1]
                out.append(t)
            found.append("".join(reversed(out)))
    return top, min(found)


def readings(word: str) -> set[str]:
    """Every reading in which a channel decodes all it can: at most three a charset for UTF-8 and one a single-byte channel."""
    out = set()
    if utf8_debris(word):
        for wrong in READ_AS:
            out.update(text for _, text, _ in utf8_lattices(word, wrong))
    if any(c.isascii() and c.isalpha() for c in word):
        for _, swaps in tables("".join(sorted({c for c in word if not c.isascii()}))):
            table = dict(swaps)
            out.add("".join(table.get(c, c) for c in word))
    return {t for t in out if t != word and not has_controls(t)}


def repairs(word: str, n: int, known: dict[str, int], model: LetterModel) -> Iterator[tuple[str, str, float, bool, bool]]:
    """Accepted readings: text, channel, gain beyond the prior, whether read from UTF-8, whether letters were lost."""
    against = (REPEATED if plain(word) and not _SIGN_INSIDE.search(word) else REPEATED_SIGN) * math.log(n)
    gains = {t: (KNOWN if c >= FREQUENT * n else 0.0) + against for t, c in known.items() if FREQUENT * c >= n}
    if LOST in word:
        model.without("")
        found = [(*viterbi(lost_lattice(word, w, model.letters), model, gains), f"utf-8>{w}") for w in ("latin-1", "cp1252")]
        score, text, channel = max(found, key=lambda x: (x[0], x[1]))
        yield text, channel, max(score, -1e9), False, True
        return
    debris = utf8_debris(word)
    model.without("" if debris or not learnt(word) else word)
    keep = (model.score(word) if debris or len(_ODD.findall(word)) > 1 or len(max(_ODD.findall(word), key=len)) > 1 else 0.0) + against
    seen = set()
    for wrong in READ_AS if debris else ():
        lattices = list(utf8_lattices(word, wrong))  # the last one holds the spans of all steps
        read = tuple(text for _, text, _ in lattices)
        if not lattices or read in seen:
            continue  # charsets that read these bytes alike are one channel
        seen.add(read)
        score, text = viterbi(lattices[-1][2], model, gains)
        if text and text != word and score - keep > UTF8_PRIOR and not has_controls(text):
            steps = next((k for k, x in enumerate(read, 1) if x == text), len(read))
            yield text, f"utf-8>{wrong} x{steps}", score - keep - UTF8_PRIOR, True, False
    if not any(c.isascii() and c.isalpha() for c in word):
        return  # a lone sign
    # probabilities are at most 1, so a path gains at most what the triples around its changed letters cost now
    most = model.around(word) + max(gains.values(), default=0.0)
    if most <= against + PRIOR:
        return
    odd = {c for c in word if not c.isascii()}
    for channel, swaps in tables("".join(sorted(odd))):
        table = dict(swaps)
        if not all((c in table and (table[c] in WRITTEN or table[c] in model.uni)) or c.isalpha() for c in odd):
            continue  # letters the corpus does not write
        at = [i for i, c in enumerate(word) if c in table]
        if len(at) == 1:  # the only path that changes something
            text = word[: at[0]] + table[word[at[0]]] + word[at[0] + 1 :]
            gain = model.change(word, at[0], table[word[at[0]]]) + gains.get(text, 0.0) - against - PRIOR
            if gain > 0 and not has_controls(text):
                yield text, channel, gain, False, False
            continue
        # a span may be undamaged
        edges: Edges = [[(1, [t]) for t in ([c] if c.isalpha() or c not in table else []) + ([table[c]] if c in table else [])] for c in word]
        score, text = viterbi(edges, model, gains)
        if text and text != word and score - keep > PRIOR and not has_controls(text):
            yield text, channel, score - keep - PRIOR, False, False
        elif text == word:  # the likeliest reading that changes something
            text = "".join(table.get(c, c) for c in word)
            score = model.score(text) + gains.get(text, 0.0)
            if score - keep > PRIOR and not has_controls(text):
                yield text, channel, score - keep - PRIOR, False, False


def _repairs(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = LetterModel(model.value)
        for batch in batches:
            known = [dict(x or ()) for x in batch.column("known").to_pylist()]
            rows = [(w, n, *c) for w, n, k in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), known) for c in repairs(w, n, k, letters)]
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["word", "n", "cand", "channel", "total", "utf8", "lost"])

    return run


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n, t) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for t in (readings(w) if LOST not in w else ())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["word", "n", "text"])


def _trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter triples of the word types a model may learn from."""
    for batch in batches:
        held: dict[str, int] = defaultdict(int)
        for w in batch.column("word").to_pylist():
            if not learnt(w):
                continue
            s = _EDGE * 2 + folded(w) + _EDGE
            for i in range(len(s) - 2):
                held[s[i : i + 3]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["t", "c"])


def garbled_words(df: DataFrame, word: str) -> DataFrame:
    """``word, n, restored, guess, channel`` of every distinct garbled word."""
    spark = df.sparkSession
    freq = cut(df.select(F.col(word).alias("word")).where(F.col("word").isNotNull() & (F.col("word") != "")).groupBy("word").agg(F.count("*").alias("n")), "words")
    odd = freq.where(F.length("word") != F.octet_length("word")).repartition(default_parallelism(spark), "word")  # few bytes, much work
    known = freq.select(F.col("word").alias("text"), F.col("n").alias("c"))
    read = odd.mapInArrow(_readings, "word string, n long, text string").join(known, "text", "left")
    read = read.groupBy("word", "n").agg(F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("text", "c")))).alias("known"))
    # a word with lost bytes may be any word that has other non-ASCII signs in the same places
    shape = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]+", "\x01")
    lost = odd.where(F.col("word").contains(LOST)).withColumn("shape", shape("word"))
    whole = freq.where((F.length("word") != F.octet_length("word")) & ~F.col("word").contains(LOST)).select(shape("word").alias("shape"), F.col("word").alias("text"), F.col("n").alias("c"))
    lost = lost.join(whole.where(F.length("shape") > 3), "shape", "left")
    lost = lost.select("word", "n", F.when(F.col("c").isNotNull(), F.create_map("text", "c")).alias("known"))
    searched = cut(read.unionByName(lost), "lattices").repartition(default_parallelism(spark))
    clean, taken = freq.select("word"), None
    for last in (False, True):  # the letter model of the second round does not learn from what the corpus' own words explain
        triples = cut(clean.mapInArrow(_trusted, "t string, c long").groupBy("t").agg(F.sum("c").alias("c")), "letters")
        if triples.count() > MODEL_LIMIT:
            raise ValueError("an alphabet of so many letter triples cannot be sent to every task")
        model = spark.sparkContext.broadcast({r.t: r.c for r in triples.toLocalIterator()})
        taken = cut((searched if last else searched.where(F.size("known") > 0)).mapInArrow(_repairs(model), REPAIRS), "repairs")
        clean = freq.select("word").join(taken.select("word").distinct(), "word", "left_anti")
    # how many words a channel explains best is its weight among rivals; there are as many rows as channels
    first = taken.where("not lost").groupBy("word").agg(F.max_by("channel", F.struct("utf8", "total", "cand")).alias("channel"))
    share = first.groupBy("channel").agg(F.log(F.count("*") + 0.1).alias("weight"))
    ranked = taken.join(F.broadcast(share), "channel", "left").withColumn("total", F.col("total") + 2 * F.coalesce("weight", F.lit(-2.0)))
    best = ranked.groupBy("word", "n").agg(F.max_by(F.struct("cand", "channel", "lost"), F.struct("utf8", "total", "cand")).alias("b"))
    return best.select("word", "n", F.when(F.col("b.lost"), "").otherwise(F.col("b.cand")).alias("restored"), F.col("b.cand").alias("guess"), F.col("b.channel").alias("channel"))


def garbled_rows(df: DataFrame, row_id: str, word: str) -> DataFrame:
    """``row_id, word, restored, guess, channel`` of every garbled row."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(word).alias("word")).where(F.length("word") != F.octet_length("word"))
    return rows.join(garbled_words(df, word).drop("n"), "word").select("row_id", "word", "restored", "guess", "channel")

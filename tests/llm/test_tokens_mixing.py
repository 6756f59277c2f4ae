"""Containers, mixtures and encoding repair: exact round trips and limits."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from latentia.llm import encoding, mixing, packing
from latentia.llm.tokens import n_tokens

DOCS = "doc_id long, text string, source string, piece int, n_tokens long"


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, s, 7, 7) for i, (t, s) in enumerate(texts)], DOCS).repartition(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold(sizes):
    a = np.sort(np.array(sizes))[::-1]
    w = packing.pack(a, 100)
    load = np.bincount(w, a)
    assert load.max() <= 100 and len(w) == len(a)
    assert w.max() + 1 >= packing.lower_bound(a, 100) >= -(-sum(sizes) // 100)


def test_differencing_balances():
    g = np.random.default_rng(0)
    a = np.sort(g.integers(1, 400, 600))[::-1]
    load = np.bincount(packing.differencing(a, 20), a, 20)
    assert load.max() - load.min() <= 3


def test_containers(spark):
    texts = [("word " * n, "a") for n in range(0, 90)] + [(None, "a"), ("", None), ("long text " * 4000, "b"), ("same", "a"), ("same", "a"), (" " * 300_000, "c")]
    rows = packing.containers(docs(spark, texts), capacity=64, block_windows=8).collect()
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, []).append(r)
    for i, (t, _) in enumerate(texts):
        pieces = sorted(total.get(i, []), key=lambda r: r.piece)
        n = n_tokens(t)
        assert sum(r.n_tokens for r in pieces) == n and [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.first_token for r in pieces] == [64 * k for k in range(len(pieces))] and len(pieces) == -(-n // 64)
    load = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert max(load.values()) <= 64 and sum(load.values()) / (64 * len(load)) > 0.97
    assert packing.containers(docs(spark, texts).limit(0)).count() == 0


def test_mixture(spark):
    g = np.random.default_rng(1)
    texts = [("w " * int(g.integers(1, 60)), s) for s, n in (("a", 900), ("b", 300), ("c", 40)) for _ in range(n)] + [("x y", None), (None, "a"), ("", "b"), ("z", "other")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 4), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    used = mixing.uses(docs(spark, texts), targets)
    rows = used.collect()
    assert len(rows) == len(texts) and {r.uses for r in rows if r.source in (None, "other")} == {0}
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(0 <= r.uses <= cap[r.source] for r in rows if r.source in cap)
    share = {r.source: r.actual_share for r in mixing.shares(used, targets).collect()}
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(share[s] - t / 0.95) < 0.01
    assert sorted((r.doc_id, r.uses) for r in rows) == sorted((r.doc_id, r.uses) for r in mixing.uses(docs(spark, texts, 7), targets).collect())
    mixed = mixing.mixture(used).collect()
    assert len(mixed) == sum(r.uses for r in rows) and [r.shuffle_key for r in mixed] == sorted(r.shuffle_key for r in mixed)
    assert mixing.uses(docs(spark, texts).limit(0), targets).count() == 0
    assert {r.uses for r in mixing.uses(docs(spark, texts), targets.limit(0)).collect()} == {0}


def test_thresholds():
    assert mixing.thresholds(float("inf"), 3) == [-1.0] * 3
    assert mixing.thresholds(1.0, 2) == pytest.approx([0.367879, 0.735759], abs=1e-6)
    assert mixing.thresholds(0.0, 2) == [1.0, 1.0]
    many = mixing.thresholds(900.0, 1000)
    assert many[899] == pytest.approx(0.5, abs=0.02) and many[-1] > 0.99 and many[0] < 1e-300


CLEAN = ["niño", "según", "coördinatie", "café", "región", "año", "ningún", "él", "ideeën", "São", "LERÇÃ", "foto’s", "€", "Brošin"]
CHANNELS = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "iso8859-2"), ("cp437", "latin-1"), ("mac_roman", "cp1252")]


def test_encoding(spark):
    rows, want, k = [], {}, 0
    for w in CLEAN:
        rows += [(k := k + 1, w) for _ in range(40)]
    for right, wrong in CHANNELS:
        for w in CLEAN:
            try:
                bad = w.encode(right).decode(wrong)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if right != "utf-8" and not (set(w) & set("ñúóéáíöë")) or len(w) == 1 or bad == w or bad in CLEAN:
                continue
            rows.append((k := k + 1, bad))
            want[k] = w
    rows.append((k := k + 1, "niño".encode().decode("latin-1").encode().decode("cp1252")))
    want[k] = "niño"
    rows.append((k := k + 1, "seg�n"))
    want[k] = ""
    rows.append((k := k + 1, "según".encode().decode("latin-1").replace("n", "ñ")))  # only a span is damaged
    want[k] = "següñ".replace("ü", "ú")
    rows += [(k + 1, None), (k + 2, ""), (k + 3, "plain"), (k + 4, "Ã" * 3000)]
    df = spark.createDataFrame([(i, w, "x", 1) for i, w in rows], "id long, word string, cand string, n int").repartition(4)
    got = {r.row_id: r.restored for r in encoding.garbled_rows(df, "id", "word").collect()}
    assert got == want
    guess = {r.word: r.guess for r in encoding.garbled_words(df, "word").collect()}
    assert guess["seg�n"] == "según"
    assert encoding.garbled_rows(df.limit(0), "id", "word").count() == 0


def test_clean_words_that_are_valid_utf8_by_chance(spark):
    """Two signs that are a UTF-8 sequence in some charset are repaired only if the letter model gains."""
    words = [(w, 40) for w in CLEAN] + [("Índice", 40), ("Ítaca", 40), ("Íñigo", 5), ("‘één", 5), ("één", 40), ("niÃ±o", 2), ("niÃƒÂ±o", 1)]
    rows = [w for w, n in words for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, word string")
    got = {(r.word, r.restored) for r in encoding.garbled_words(df, "word").collect()}
    assert got == {("niÃ±o", "niño"), ("niÃƒÂ±o", "niño")}


@pytest.mark.parametrize("copies", [2, 10, 100])
def test_unknown_word_is_repaired_however_often_it_occurs(spark, copies):
    """The restored word is not in the corpus; the decision does not hang on the number of rows."""
    stems = ["cami", "ra", "na", "habita", "esta", "rela", "aten", "situa"]
    clean = [a + b for a in stems for b in ("ción", "ones", "mente", "dor", "lón", "río", "ría")] + [w for w in CLEAN if "¢" not in w]
    bad = "acción".encode("cp437").decode("latin-1")
    df = spark.createDataFrame(list(enumerate(clean * 10 + [bad] * copies)), "id long, word string")
    assert {(r.word, r.restored) for r in encoding.garbled_words(df, "word").collect()} == {(bad, "acción")}


def test_lost_letters_are_guessed_by_word_frequencies(spark):
    words = ["camión"] * 5 + ["camiñn"] + ["cami\ufffdn", "\ufffd" * 300, "xx\ufffd\ufffdyy"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = {r.word: (r.restored, r.guess) for r in encoding.garbled_words(df, "word").collect()}
    assert got["cami\ufffdn"] == ("", "camión") and len(got["\ufffd" * 300][1]) == 300 and len(got) == 3

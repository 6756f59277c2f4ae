"""Shared spans against a table of all stretches."""

import random
from collections import defaultdict

import numpy as np
import pytest

from latentia.llm import spans

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, length):
    where = defaultdict(set)
    for d, t in rows:
        for i in range(len(t or "") - length + 1):
            where[t[i : i + length]].add(d)
    out = []
    for d, t in rows:
        on = [i for i in range(len(t or "") - length + 1) if len(where[t[i : i + length]]) > 1]
        for i in on:
            if out and out[-1][0] == d and i <= out[-1][2]:
                out[-1][2] = i + length
            else:
                out.append([d, i, i + length])
    return sorted(map(tuple, out))


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(3, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    pool = [text(r.randint(20, 90)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randint(0, len(p) // 2)
            parts += [text(r.randint(0, 30)), p[a : a + r.randint(50, len(p))]]
        rows.append((i, "".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 9000), (1003, "y" + "x" * 5000), (1004, "=" * 700 + pool[0] + "=" * 700), (1005, rows[3][1]), (1006, rows[3][1])]
    rows += [(2000 + i, text(4) + pool[1] + text(5)) for i in range(40)]  # one passage in a large part of the corpus
    return rows


@pytest.mark.parametrize("limit", [spans.BLOCK_LIMIT, 3])
def test_against_all_stretches(spark, limit):
    rows = corpus(7)
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, spans.shared_spans(df, block_limit=limit).collect()))
    assert got == brute(rows, 200)
    assert len(got) > 30


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, spans.shared_spans(df).collect())) == brute(rows, 200)


def test_empty_and_amounts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spans.shared_spans(none).count() == 0
    p = "ab cd " * 50
    df = spark.createDataFrame([(1, p + "q", "a"), (2, "z" + p, None), (3, None, None)], SCHEMA)
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_amounts(df, spans.shared_spans(df)).collect()}
    assert got == {1: (301, 300), 2: (301, 300), 3: (0, 0)}


def test_factors_are_longest_foreign_matches():
    """Greedy parse against every other document, with and without phrases of several documents."""
    r = random.Random(3)
    for length in (4, 9):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(length, 8 * length))) for _ in range(9)]
        owner = np.array([0, 1, 2, 0, 1, 2, 3, 3, 4])
        index = spans.Index(texts, owner, length)
        for k, t in enumerate(texts):
            others = [u for j, u in enumerate(texts) if owner[j] != owner[k]]
            longest = [max((n for n in range(len(t) - i + 1) if any(t[i : i + n] in u for u in others)), default=0) for i in range(len(t))]
            i, want = 0, []
            while i <= len(t) - length:
                if longest[i] >= length:
                    want.append((i, i + longest[i]))
                i += max(1, longest[i] - length + 1)
            assert list(index.factors(k)) == want

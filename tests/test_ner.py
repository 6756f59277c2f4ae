"""Entity recognition with models over vocabularies whose emissions are no array."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from latentia.operators import features as FT, ner as N, params as P, perceptron as PC
from latentia.plans import ner_queries as Q

WORDS = ["a", "B", "c", "d", "*unk*"]
SENTENCES = [["a", "b", "B", "c"], ["d"], ["A", "zz", "c", "d", "a", "a"]]


@pytest.fixture
def sparse(spark, tmp_path):
    """Few words whose ids go up to nine millions: more than an array of emissions may hold."""
    spark.createDataFrame([(k * 1_800_000 + k, w, 1) for k, w in enumerate(WORDS, 1)], "id long, word string, freq long").write.parquet(f"{tmp_path}/vocab.parquet")
    toks = [(100 * s + i, "f", s, i, w, "B-PER" if i == 1 else "O") for s, ws in enumerate(SENTENCES * 10) for i, w in enumerate(ws)]
    spark.createDataFrame(toks, "token_id long, file_name string, sent_id long, pos int, word string, tag string").write.parquet(f"{tmp_path}/ner2003.parquet")
    return str(tmp_path)


def against_sql(spark, d, name):
    con = duckdb.connect()
    for t in ("vocab", "ner2003"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    kind = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    got, want = kind(map(tuple, Q.QUERIES[name](spark, d).collect())), kind(con.execute(Q.ORACLES[name]).fetchall())
    assert got == want and any(r[-1] > 0 for r in got)


def test_represented_with_sparse_ids(spark, sparse):
    against_sql(spark, sparse, "ner_represented")


def test_emissions_of_a_vocabulary(spark):
    """All decoders give the same with emissions in the vocabulary as with an array; a sentence with a word that lacks them gets nothing."""
    p = P.random_params(3, 5, seed=4)
    rows = [(s, i, w) for s, ws in enumerate(SENTENCES) for i, w in enumerate(ws)]
    toks = spark.createDataFrame(rows, "sent_id long, pos int, word string")
    vocab = [(w, i) for i, w in enumerate(WORDS)]
    held = [(w, i + 10**15, p.E[i, :, 0].tolist()) for w, i in vocab]
    none = P.Params(p.pi, p.T, p.f, np.zeros((0, 3, 1)))
    plain, given = spark.createDataFrame(vocab, "word string, id long"), spark.createDataFrame(held, "word string, id long, e array<double>")
    for method in ("viterbi", "posterior", "posterior_cont", "max_emission"):
        a, b = ({(r.sent_id, r.pos): r[-1] for r in N.represented(toks, v, q, method).collect()} for v, q in ((plain, p), (given, none)))
        assert len(a) == len(rows) and a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    lacking = spark.createDataFrame([(w, i, None if w == "d" else e) for w, i, e in held], "word string, id long, e array<double>")
    got = {(r.sent_id, r.pos): r.rep for r in N.represented(toks, lacking, none).collect()}
    assert {s for (s, _), v in got.items() if v is not None} == {0} and len(got) == len(rows)


def test_types_with_sparse_ids(spark, sparse):
    against_sql(spark, sparse, "ner_type_represented")


def test_experiment_with_sparse_ids(spark, sparse):
    scores = Q.QUERIES["ner_experiment"](spark, sparse).collect()
    assert any(r.type == "PER" and r.n_gold for r in scores)


def test_sentences_across_batches():
    """Batches may end within a sentence: no token is lost and every batch given on holds whole sentences."""
    ids = np.repeat([7, 3, 9, 4], [5, 1, 12, 2])
    table = pa.table({"sent_id": ids, "n": np.arange(len(ids))})
    for size in (1, 2, 3, 5, 20):
        got = list(PC._whole(iter(table.to_batches(max_chunksize=size))))
        assert np.concatenate([b.column("n").to_numpy() for b in got]).tolist() == list(range(len(ids)))
        seen = [x for b in got for x in dict.fromkeys(b.column("sent_id").to_pylist())]
        assert seen == [7, 3, 9, 4]


def test_training_across_batches(spark):
    """Weights and predictions do not depend on how many rows a batch holds."""
    r = random.Random(1)
    toks = [(s, i, r.choice("abcd"), r.choice(["O", "B-X"])) for s in range(40) for i in range(r.randint(1, 7))]
    sent = PC.as_sentences(FT.emission(FT.windowed(spark.createDataFrame(toks, "sent_id long, pos int, word string, tag string"))))
    most, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    for size in (most, "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            w = PC.train(sent, ["B-X", "O"], 2, 2)
            got.append((sorted((x.name, tuple(x.w)) for x in w.collect()), sorted(PC.predict(sent, w, ["B-X", "O"]).collect())))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert [n for n, _ in got[0][0]] == [n for n, _ in got[1][0]] and np.allclose([v for _, v in got[0][0]], [v for _, v in got[1][0]])
    assert got[0][1] == got[1][1] and len(got[0][1]) == len(toks)

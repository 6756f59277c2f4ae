"""Applying models to sequences and trees: one dispatcher over all decoders, and averages per word type."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latentia.operators import chain, treebp
from latentia.operators.em import COUNTS, Counts, _forests, by_length, check_size, given_emissions, ragged, summed
from latentia.operators.params import Params
from latentia.session import ship

CHAIN = ("viterbi", "posterior", "posterior_cont", "max_emission")
TREE = ("max_product", "posterior", "posterior_cont", "max_emission")


def _lists(parts: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    return pa.array([None if p is None else p.tolist() if p.ndim == 1 else [r.tolist() for r in p] for p in parts], kind)


def decode(data: DataFrame, p: Params, method: str = "viterbi", approx: bool = False, ignore_rel: int | None = None) -> DataFrame:
    """``sent_id, score, states`` (or ``reps`` for ``posterior_cont``), in token order.

    Sequences have ``x``, trees ``head, x, rel``; sequences with the emission rows ``e`` of their tokens do not use p.E. The score is the path's log score for viterbi and max_product, else
    the log-likelihood. ``ignore_rel``: nodes of that relation become null in tree output.
    """
    check_size(p)
    ship(data.sparkSession)
    method, trees = method.replace("-", "_"), "head" in data.columns
    if method not in (TREE if trees else CHAIN):
        raise ValueError(f"unknown method {method}")
    cont, sent = method == "posterior_cont", data.sparkSession.sparkContext.broadcast(p)
    kind = pa.list_(pa.list_(pa.float64())) if cont else pa.list_(pa.int32())

    def on_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Params = sent.value
        for batch in batches:
            out: list = [np.zeros(0, np.int32)] * batch.num_rows
            score = np.zeros(batch.num_rows)
            given = given_emissions(batch, q.n)
            for rows, x in by_length(*ragged(batch.column("x"))):
                x, e = x.astype(np.int64), given(rows, x.shape[1])
                if method == "viterbi":
                    s, score[rows] = chain.viterbi(x, q, e)
                elif method == "max_emission":
                    s = q.E[:, :, 0].argmax(1)[x] if e is None else e.argmax(2)
                else:
                    score[rows], g, _ = chain.posteriors(x, q, approx, e)
                    s = g if cont else g.argmax(2)
                for i, r in enumerate(rows.tolist()):
                    out[r] = s[i]
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), pa.array(score), _lists(out, kind)], ["sent_id", "score", "reps" if cont else "states"])

    def on_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Params = sent.value
        for batch in batches:
            out: list = [None] * batch.num_rows
            score = np.zeros(batch.num_rows)
            for rows, fo in _forests(batch):
                if method == "max_emission":
                    s = treebp._emission(q.E, fo.word, fo.rel).argmax(1)
                else:
                    b = treebp.Beliefs(fo, q, approx, maximum=method == "max_product")
                    score[rows] = b.ll
                    s = b.best_states() if method == "max_product" else b.descend()
                    if method == "posterior":
                        s = s.argmax(1)
                each = np.split(s, np.flatnonzero(np.diff(fo.tree)) + 1) if len(fo.tree) else []
                at = np.unique(fo.tree)
                skip = fo.rel == ignore_rel if ignore_rel is not None else None
                masks = np.split(skip, np.flatnonzero(np.diff(fo.tree)) + 1) if skip is not None and len(fo.tree) else [None] * len(each)
                for t, part, mask in zip(at.tolist(), each, masks):
                    held = part.tolist()
                    out[rows[t]] = [None if mask is not None and mask[i] else v for i, v in enumerate(held)]
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), pa.array(score), pa.array(out, kind)], ["sent_id", "score", "reps" if cont else "states"])

    schema = f"sent_id long, score double, {'reps array<array<double>>' if cont else 'states array<int>'}"
    rows = data.select(F.col("sent_id").cast("long").alias("sent_id"), *[c for c in ("x", "head", "rel", "e") if c in data.columns])
    return rows.mapInArrow(on_trees if trees else on_chain, schema)


def backward_scores(data: DataFrame, p: Params) -> DataFrame:
    """``sent_id, score``: log-likelihoods of sequences by a backward pass."""
    check_size(p)
    ship(data.sparkSession)
    sent = data.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for rows, x in by_length(*ragged(batch.column("x"))):
                score[rows] = chain.backward_likelihood(x.astype(np.int64), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), pa.array(score)], ["sent_id", "score"])

    return data.select(F.col("sent_id").cast("long").alias("sent_id"), "x").mapInArrow(run, "sent_id long, score double")


def additive_decode(data: DataFrame, pi: np.ndarray, T: np.ndarray, f: np.ndarray, E: np.ndarray, method: str = "viterbi") -> DataFrame:
    """Sequences ``x`` under additive scores of a linear model (initial, transition, final, emission by symbol).

    ``sent_id, score, states`` for ``viterbi``; ``sent_id, score, reps`` (posteriors; the score is the log partition sum)
    for ``posterior_cont``.
    """
    if method not in ("viterbi", "posterior_cont"):
        raise ValueError(f"unknown method {method}")
    ship(data.sparkSession)
    cont = method == "posterior_cont"
    sent = data.sparkSession.sparkContext.broadcast((pi, T, f, E))
    kind = pa.list_(pa.list_(pa.float64())) if cont else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c, e = sent.value
        for batch in batches:
            out: list = [np.zeros((0, len(a))) if cont else np.zeros(0, np.int32)] * batch.num_rows
            score = np.zeros(batch.num_rows)
            for rows, x in by_length(*ragged(batch.column("x"))):
                em = e[x.astype(np.int64)]
                if cont:
                    score[rows], got = chain.additive_posteriors(a, b, c, em)
                else:
                    got, score[rows] = chain.best_path(a, b, c, em)
                for i, r in enumerate(rows.tolist()):
                    out[r] = got[i]
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), pa.array(score), _lists(out, kind)], ["sent_id", "score", "reps" if cont else "states"])

    schema = f"sent_id long, score double, {'reps array<array<double>>' if cont else 'states array<int>'}"
    return data.select(F.col("sent_id").cast("long").alias("sent_id"), "x").mapInArrow(run, schema)


def type_posteriors(data: DataFrame, p: Params, approx: bool = False, by_rel: bool = False) -> DataFrame:
    """``word_id[, rel], rep, n``: mean posterior per word type (and relation), summed in the tasks first; emission rows ``e`` as in ``decode``."""
    check_size(p)
    ship(data.sparkSession)
    sent = data.sparkSession.sparkContext.broadcast(p)
    trees = "head" in data.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Params = sent.value
        c = Counts(q.n, 1)
        for batch in batches:
            if trees:
                for _, fo in _forests(batch):
                    post = treebp.Beliefs(fo, q, approx).descend()
                    key = fo.word * 65536 + fo.rel if by_rel else fo.word
                    c.words(key, np.hstack([post, np.ones((len(post), 1))]))
            else:
                given = given_emissions(batch, q.n)
                for rows, x in by_length(*ragged(batch.column("x"))):
                    g = chain.posteriors(x.astype(np.int64), q, approx, given(rows, x.shape[1]))[1].reshape(-1, q.n)
                    c.words(x.ravel().astype(np.int64), np.hstack([g, np.ones((len(g), 1))]))
            if len(c.emit) > 50_000:
                yield from c.rows(False)
        yield from c.rows(False)

    got = summed(data.select(*[k for k in ("x", "head", "rel", "e") if k in data.columns]).mapInArrow(run, COUNTS))
    n = F.element_at("vals", -1)
    key = [F.expr("key div 65536").alias("word_id"), F.pmod("key", F.lit(65536)).cast("int").alias("rel")] if by_rel and trees else [F.col("key").alias("word_id")]
    return got.select(*key, F.transform(F.slice("vals", 1, F.size("vals") - 1), lambda v: v / n).alias("rep"), n.cast("long").alias("n"))


def type_decode(data: DataFrame, types: DataFrame, by_rel: bool = False) -> DataFrame:
    """Each token gets its type's mean posterior: ``sent_id, pos, rep``; tokens of unseen types have none."""
    cols = [F.posexplode(F.arrays_zip("x", "rel")).alias("pos", "t")] if by_rel else [F.posexplode("x").alias("pos", "word_id")]
    toks = data.select("sent_id", *cols)
    if by_rel:
        toks = toks.select("sent_id", "pos", F.col("t.x").alias("word_id"), F.col("t.rel").alias("rel"))
    on = ["word_id", "rel"] if by_rel else ["word_id"]
    return toks.join(types.select(*on, "rep"), on).where(~F.exists("rep", F.isnan)).select("sent_id", "pos", "rep")


def token_embeddings(toks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each token with its word's vector; words without one keep null."""
    return toks.join(embeddings.select("word", "rep"), "word", "left")
